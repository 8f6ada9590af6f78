"""Helpers shared by the operators: per-text work in Arrow batches, byte words, written stages, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize, scratch_path

# Rows handed to Python at once inside a batch, so that very long texts do not pile up.
SLICE = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["LOWER", "SLICE", "UPPER", "components", "drop_path", "map_slices", "map_texts", "materialize", "rooted", "scratch_path"]


def map_texts(df: DataFrame, keep: list[str], text: str, out: str, make: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """Columns `keep` unchanged, then the columns of the DDL `out` computed from `text` (null is read as empty).

    `make` is called once per task and gives the function of one text. Narrow: no shuffle, one slice of rows in memory."""

    def each():
        work = make()
        return lambda texts: [work(value) for value in texts]

    return map_slices(df, keep, text, out, each, SLICE)


def map_slices(df: DataFrame, keep: list[str], text: str, out: str, make: Callable[[], Callable[[list[str]], list[tuple]]],
               rows: int) -> DataFrame:
    """As `map_texts`, for a function of up to `rows` texts at once."""
    added = T.StructType.fromDDL(out)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = work([value or "" for value in part.column(len(keep)).to_pylist()])
                kept = [part.column(i).cast(target.field(i).type) for i in range(len(keep))]
                new = [pa.array([r[i] for r in made], target.field(len(keep) + i).type) for i in range(len(added))]
                yield pa.RecordBatch.from_arrays(kept + new, schema=target)

    return df.select(*keep, F.col(text).alias("text__")).mapInArrow(run, schema)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for every node of `edges (a, b)`; root is the smallest node of its connected component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round is a few grouped minima and joins over
    the edge list, which never grows, written to the shared folder so that lineage stays short. Nothing is gathered."""
    spark = edges.sparkSession
    now = materialize(_oriented(edges), "edges")
    mark, path = _mark(now), None
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        fresh = _oriented(small.unionByName(least.select("a", F.col("m").alias("b"))))
        new_path = scratch_path(spark, "edges")
        fresh.write.parquet(new_path)
        fresh = spark.read.schema(fresh.schema).parquet(new_path)
        new_mark = _mark(fresh)
        if path:
            drop_path(spark, path)
        same, now, mark, path = new_mark == mark, fresh, new_mark, new_path
        if same:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def rooted(rows: DataFrame, key: str, roots: DataFrame, out: str) -> DataFrame:
    """`rows` with the root of `key`, or `key` itself where it has no edge."""
    named = roots.select(F.col("node").alias(key), F.col("root").alias("root__"))
    return rows.join(named, key, "left").withColumn(out, F.coalesce("root__", key)).drop("root__")
