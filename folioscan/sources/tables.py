"""Table reads and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, location: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Parquet folder, or a JDBC table when options are given.

    For a parallel JDBC read pass partitionColumn, lowerBound, upperBound and numPartitions."""
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc, dbtable=location).load()
    return spark.read.parquet(location)


def export_all(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables as text rows tagged with `_table`, over the sorted union of their columns; blank where absent."""
    names = sorted({c for df in tables.values() for c in df.columns})
    parts = []
    for table, df in tables.items():
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in names]
        parts.append(df.select(F.lit(table).alias("_table"), *[cell.alias(c) for cell, c in zip(cells, names)]))
    return reduce(DataFrame.unionByName, parts)


def write_export(rows: DataFrame, path: str, split: bool = False) -> None:
    """CSV with a header; `split` writes one folder per table."""
    writer = rows.write.mode("overwrite").option("header", True)
    (writer.partitionBy("_table") if split else writer).csv(path)
