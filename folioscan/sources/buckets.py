"""Keyed tables that change a little at a time.

A table is cut into hash buckets of its key, and a change reads and writes only the buckets its keys fall into: a batch of one
key rewrites one bucket, whatever the table holds. Every write of a bucket is a folder of its own, named by a number; a list of
(bucket, number) rows says which one counts, and a change adds its rows there last. So a change is whole or not there, a stop at any
point leaves the table as it was, and readers keep the files they opened."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .writers import _files, exists

BUCKETS = 16
KEPT = 2  # versions of a bucket that stay for readers


@dataclass(frozen=True)
class KeyedTable:
    """Rows with unique `keys` under `path`. `buckets` should grow with the table; it is fixed by the first change."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count())).cast("int")

    def count(self) -> int:
        if not exists(self.spark, f"{self.path}/facts/_SUCCESS"):
            self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.mode("overwrite").parquet(f"{self.path}/facts")
        return self.spark.read.parquet(f"{self.path}/facts").first()["buckets"]

    def numbers(self) -> dict[int, int]:
        """The version of each bucket that counts; one row a bucket."""
        if not exists(self.spark, f"{self.path}/versions"):
            return {}
        held = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/versions")
        return {r["bucket"]: r["version"] for r in held.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """The table, or the rows of some of its buckets; None before the first change."""
        live = self.numbers()
        if not live:
            return None
        paths = [f"{self.path}/rows/bucket={b}/version={v}" for b, v in sorted(live.items()) if only is None or b in only]
        schema = self.spark.read.parquet(f"{self.path}/shape").schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def near(self, keys: DataFrame) -> DataFrame | None:
        """The rows of the buckets that the keys fall into."""
        return self.read(self.touched(keys))

    def touched(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most as many as there are buckets

    def merge(self, changes: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame | None = None) -> set[int]:
        """Replace the rows of the touched buckets by `fold(their rows, changes)`; gives the buckets.

        `fold` may drop and add rows whose keys are in `changes`, and passes others on. `empty` is the table before the first change where
        its columns are not those of `changes`."""
        changes = materialize(changes, "changes")
        touched, live = self.touched(changes), self.numbers()
        if not touched:
            return touched
        held = self.read(touched) if live else (changes if empty is None else empty).limit(0)
        fresh = materialize(fold(held, changes).withColumn("bucket", self.bucket()), "fresh")
        if not live:
            fresh.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{self.path}/shape")
        number = max(live.values(), default=0) + 1
        filled = {r[0] for r in fresh.select("bucket").distinct().collect()}
        if not filled <= touched:
            raise ValueError("fold made rows of keys that are not in the changes")
        if filled:  # written over where an unfinished try left files under this number
            placed = fresh.withColumn("version", F.lit(number).cast("long")).repartition(len(filled), "bucket")
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{self.path}/rows")
        for b in touched - filled:
            fresh.drop("bucket").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rows/bucket={b}/version={number}")
        self.spark.createDataFrame([(b, number) for b in sorted(touched)], "bucket int, version long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        self._clean(touched)
        return touched

    def upsert(self, changes: DataFrame) -> set[int]:
        """Replace or add whole rows."""
        return self.merge(changes, lambda held, new: held.join(new.select(*self.keys), list(self.keys), "left_anti").select(*new.columns).unionByName(new))

    def _clean(self, touched: set[int]) -> None:
        for b in touched:
            where, fs = _files(self.spark, f"{self.path}/rows/bucket={b}")
            names = sorted((s.getPath().getName() for s in fs.listStatus(where)), key=lambda n: int(n.split("=")[1]))
            for name in names[:-KEPT]:
                old, _ = _files(self.spark, f"{self.path}/rows/bucket={b}/{name}")
                fs.delete(old, True)
