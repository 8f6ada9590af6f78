"""The stored index: same rows as scoring without it, changes touch only their pages, queries only their buckets."""

import os
import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions.text import tokenize
from folioscan.operators import postings as P
from folioscan.operators import search as S

COLUMNS = "chunk_id string, rel_path string, title string, text string"


def corpus(seed=1, pages=40, each=6):
    rng = random.Random(seed)
    words = ["river", "stone", "light", "house", "Über", "数据", "知识库", "a", "of", "### 核心要点", "x_1", "(", "…", "😀"]
    return [(f"d/{p}.md#{i}", f"d/{p}.md", rng.choice(["", "River notes", "知识库", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))))
            for p in range(pages) for i in range(each)]


QUERIES = [(1, "river stone", "river stone"), (2, "知识库 数据", "知识库"), (3, "of the house", "of"), (4, "none such", "none such"), (5, "light", "stone light ho"), (6, "über a", "r ü"), (7, "", ""),
           (8, "a a a", "a a a"), (9, "x_1", "iver notes\nriver")]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string, phrase string")


def tokens(chunks):
    return chunks.withColumn("tokens", tokenize("text"))


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score").collect())


def same(index, chunks, queries, k=5):
    allowed = chunks.where("rel_path like '%1.md'").select("chunk_id")
    assert rows(P.phrase_scores(index, queries)) == rows(S.bm25_phrase(queries, chunks))
    assert rows(P.phrase_scores(index, queries, 2, allowed)) == rows(S.bm25_phrase(queries, chunks, 2, allowed))
    assert rows(P.tfidf_top(index, queries, k)) == rows(S.best(S.tfidf_scores(queries, tokens(chunks)), k))


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 20)
    monkeypatch.setattr(P, "QUERY_BLOCK", 4)


def test_same_scores_as_a_scan(spark, queries, folder, small):
    chunks = spark.createDataFrame(corpus(), COLUMNS)
    index = P.build(spark, f"{folder}/ix", chunks, 4)
    same(index, chunks, queries)
    assert tuple(P.status(index).first()) == (240, chunks.where("trim(text) <> ''").count(), 40, 1)


def test_pages_are_replaced_and_removed(spark, queries, folder, small):
    now = corpus()
    index = P.build(spark, f"{folder}/ix", spark.createDataFrame(now, COLUMNS), 4)
    fresh = [(f"d/{p}.md#{i}", f"d/{p}.md", "River notes", f"stone light house {p} river stone") for p in (3, 4, 77) for i in range(3)]
    changed = spark.createDataFrame([(f"d/{p}.md",) for p in (3, 4, 5, 77)], "rel_path string")
    before = {f for f in files(f"{folder}/ix") if "versions" not in f}
    P.upsert(index, spark.createDataFrame(fresh, COLUMNS), changed)
    assert before <= files(f"{folder}/ix")  # nothing that stays was written again
    now = [r for r in now if r[1] not in ("d/3.md", "d/4.md", "d/5.md")] + fresh
    same(index, spark.createDataFrame(now, COLUMNS), queries)
    P.remove(index, spark.createDataFrame([("d/4.md",), ("d/9.md",), ("gone.md",)], "rel_path string"))
    now = [r for r in now if r[1] not in ("d/4.md", "d/9.md")]
    same(index, spark.createDataFrame(now, COLUMNS), queries)
    assert sorted(map(tuple, index.chunks().collect()), key=repr) == sorted(now, key=repr)


def test_a_change_reads_no_posting_rows(spark, folder, small):
    """What the replaced pages had added to the term counts comes from their own texts."""
    now = corpus()
    index = P.build(spark, f"{folder}/ix", spark.createDataFrame(now, COLUMNS), 4)
    held = {f: open(f, "rb").read() for f in files(f"{folder}/ix/terms")}
    for f in held:
        with open(f, "wb"):
            pass  # emptied: to read it would fail
    fresh = [("d/3.md#0", "d/3.md", "t", "stone stone brook")]
    P.upsert(index, spark.createDataFrame(fresh, COLUMNS), spark.createDataFrame([("d/3.md",), ("d/4.md",)], "rel_path string"))
    P.remove(index, spark.createDataFrame([("d/3.md",), ("d/4.md",), ("d/5.md",)], "rel_path string"))
    for f, data in held.items():
        with open(f, "wb") as out:
            out.write(data)
    left = spark.createDataFrame([r for r in now if r[1] not in ("d/3.md", "d/4.md", "d/5.md")], COLUMNS)
    want = tokens(left).select("chunk_id", F.explode("tokens").alias("term")).groupBy("term").agg(F.count_distinct("chunk_id").alias("df"))
    assert sorted(map(tuple, P.doc_frequency(index).collect())) == sorted(map(tuple, want.collect()))


def test_an_unfinished_change_does_not_count(spark, queries, folder, small):
    now = spark.createDataFrame(corpus(), COLUMNS)
    index = P.build(spark, f"{folder}/ix", now, 4)
    fresh = spark.createDataFrame([("d/1.md#0", "d/1.md", "t", "stone stone")], COLUMNS)
    P._write_segment(index, 1, fresh, 4)  # stopped before its pages were named
    P._gone(index, 1, now)
    same(index, now, queries)
    P.upsert(index, fresh, fresh.select("rel_path"))
    same(index, now.where("rel_path <> 'd/1.md'").unionByName(fresh), queries)


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_an_index_takes_no_more_than_its_text(spark, folder):
    rng = random.Random(4)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    made = [(f"d/{i}.md#0", f"d/{i}.md", "t", " ".join(rng.choice(words) for _ in range(80))) for i in range(2000)]
    P.build(spark, f"{folder}/ix", spark.createDataFrame(made, COLUMNS).coalesce(1), 4)
    held = sum(os.path.getsize(f) for f in files(f"{folder}/ix") if "/docs/" not in f)
    assert held < 1.5 * sum(len(r[3]) for r in made)


def test_numbers_are_coded_and_decoded():
    import numpy as np

    for values in ([], [0], [127, 128, 0, 300, 16383, 16384, 5], [1 << 40, 3, 1 << 21]):
        data, sizes = P.coded(np.array(values, np.int64))
        assert P.decoded(data.tobytes()).tolist() == values and len(data) == sizes.sum()


def test_a_query_reads_only_its_buckets(spark, folder, small):
    index = P.build(spark, f"{folder}/ix", spark.createDataFrame(corpus(), COLUMNS), 32)
    asked = spark.createDataFrame([("riv",), ("ive",)], "gram string")
    held = lambda: sorted(map(tuple, index.rows("grams", asked, "gram").select("gram", "block", "n").collect()))
    found, wanted = held(), {f"bucket={r[0]}" for r in asked.select(P.bucket_of(F.col("gram"), 32)).collect()}
    assert {g for g, *_ in found} == {"riv", "ive"}
    for f in files(f"{folder}/ix/grams"):
        if f.split("/")[-2] not in wanted:
            with open(f, "wb"):
                pass  # emptied: to read it would fail
    assert held() == found


def test_blocks_that_cannot_matter_are_skipped(spark, folder, small):
    rng = random.Random(2)
    kinds = {c: [f"{c}{i}" for i in range(30)] for c in "abcdefgh"}
    made = [(f"{c}/{i}#0", f"{c}/{i}", "t", " ".join(rng.choice(kinds[c]) for _ in range(12)) + (" shared" if i % 9 == 0 else ""), c) for c in kinds for i in range(100)]
    chunks = spark.createDataFrame(made, COLUMNS + ", cluster string")
    index = P.build(spark, f"{folder}/ix", chunks, 4)
    queries = spark.createDataFrame([(i, f"{c}1 {c}2 {c}3 shared", "") for i, c in enumerate(kinds)], "query_id long, text string, phrase string")
    top, report = P.tfidf_top(index, queries, 5, report=True)
    assert rows(top) == rows(S.best(S.tfidf_scores(queries, tokens(chunks)), 5))
    facts = report.collect()
    assert len(facts) == 8 and all(r["scored"] < r["blocks"] for r in facts) and sum(r["scored"] for r in facts) < 0.5 * sum(r["blocks"] for r in facts)


def test_empty_tables(spark, queries, folder):
    chunks = spark.createDataFrame([], COLUMNS)
    index = P.build(spark, f"{folder}/ix", chunks, 2)
    assert P.phrase_scores(index, queries).count() == 0 and P.tfidf_top(index, queries, 3).count() == 0
    P.upsert(index, spark.createDataFrame(corpus(pages=2), COLUMNS), spark.createDataFrame([("d/0.md",), ("d/1.md",)], "rel_path string"))
    same(index, spark.createDataFrame(corpus(pages=2), COLUMNS), queries)
    assert P.tfidf_top(index, queries.limit(0), 3).count() == 0


def test_many_queries_stay_a_table(spark, queries, small, monkeypatch):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(f"c{i}", [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(rng.choice([3, 3, 3, 2, 0]))]) for i in range(60)], "chunk_id string, vector array<float>")
    asked = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3 if i % 5 else 2)]) for i in range(11)] + [(50, None)], "query_id long, vector array<float>")
    chunks = tokens(spark.createDataFrame(corpus(), COLUMNS))
    want = rows(S.vector_scores(asked, vectors, 4)), rows(S.tfidf_top(queries, chunks, 4))
    monkeypatch.setattr(S, "QUERY_BYTES", 8)
    monkeypatch.setattr(S, "QUERY_BLOCK", 4)
    assert (rows(S.vector_scores(asked, vectors, 4)), rows(S.tfidf_top(queries, chunks, 4))) == want
