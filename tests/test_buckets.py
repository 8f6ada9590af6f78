"""Keyed tables: a change touches its buckets only, and is whole or not there."""

import os

from folioscan.sources.buckets import KeyedTable

SCHEMA = "id long, name string"


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path + "/rows") for f in fs if f.endswith(".parquet")}


def content(table):
    return {r["id"]: r["name"] for r in table.read().collect()}


def test_one_key_rewrites_one_bucket(spark, folder):
    table = KeyedTable(spark, folder + "/t", ("id",), 8)
    assert table.read() is None
    assert len(table.upsert(spark.createDataFrame([(i, f"n{i}") for i in range(100)], SCHEMA))) == 8
    before = files(folder + "/t")
    touched = table.upsert(spark.createDataFrame([(7, "new")], SCHEMA))
    fresh = files(folder + "/t") - before
    assert len(touched) == 1 and before <= files(folder + "/t")
    assert {f.split("/rows/")[1].split("/")[0] for f in fresh} == {f"bucket={b}" for b in touched}
    assert content(table) == {i: "new" if i == 7 else f"n{i}" for i in range(100)}
    assert table.near(spark.createDataFrame([(7,)], "id long")).count() < 40


def test_rows_can_go_and_come(spark, folder):
    table = KeyedTable(spark, folder + "/t", ("id",), 4)
    table.upsert(spark.createDataFrame([(i, "x") for i in range(6)], SCHEMA))
    gone = spark.createDataFrame([(i, None) for i in range(6)], SCHEMA)
    table.merge(gone, lambda held, new: held.join(new, "id", "left_anti"))
    assert content(table) == {}
    table.upsert(spark.createDataFrame([(3, "y")], SCHEMA))
    assert content(table) == {3: "y"} and table.upsert(spark.createDataFrame([], SCHEMA)) == set()


def test_an_unfinished_change_does_not_count(spark, folder):
    table = KeyedTable(spark, folder + "/t", ("id",), 2)
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], SCHEMA))
    changes = spark.createDataFrame([(1, "half")], SCHEMA)
    version = max(table.numbers().values()) + 1  # files of a change that never named its version
    bucket = next(iter(table.touched(changes)))
    changes.write.parquet(f"{folder}/t/rows/bucket={bucket}/version={version}")
    assert content(table) == {1: "a", 2: "b", 3: "c"}
    table.upsert(spark.createDataFrame([(1, "whole")], SCHEMA))
    assert content(table) == {1: "whole", 2: "b", 3: "c"}


def test_old_versions_go(spark, folder):
    table = KeyedTable(spark, folder + "/t", ("id",), 1)
    for i in range(5):
        table.upsert(spark.createDataFrame([(1, f"v{i}")], SCHEMA))
    assert content(table) == {1: "v4"} and len(os.listdir(folder + "/t/rows/bucket=0")) == 2
