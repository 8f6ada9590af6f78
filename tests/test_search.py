"""Keyword scores by the scan: same rows as by joins, without a shuffle of pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions.text import tokenize
from folioscan.operators import chunking as K
from folioscan.operators import search as S
from folioscan.plans import common, links, load, retrieval
from folioscan.plans.fixtures import Tables
from tests.oracle import data_dir


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = ["river", "stone", "light", "house", "moss", "a", "of"]
    chunks = [(f"c{i}", rng.choice(["River notes", "t", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), "xyz"[i % 3]) for i in range(300)]
    queries = [(i, " ".join(rng.sample(words, 2)), "xyz"[i % 3]) for i in range(7)]
    chunks = spark.createDataFrame(chunks, "chunk_id string, title string, text string, scope_id string").withColumn("tokens", tokenize("text"))
    return spark.createDataFrame(queries, "query_id long, text string, scope_id string"), chunks


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score").collect())


def test_a_scope_is_scored_by_itself(tables):
    queries, chunks = tables
    assert rows(S.tfidf_top(queries, chunks, 5, "scope_id")) == rows(S.best(S.tfidf_scores(queries, chunks, ["scope_id"]), 5))


def test_a_mix_has_the_rows_it_needs(tables, spark):
    queries, chunks = tables
    hits = spark.createDataFrame([(q, f"c{c}", (c % 7) / 7) for q in range(6) for c in range(q, 300, 41)], "query_id long, chunk_id string, score double")
    every = S.tfidf_scores(queries, chunks)
    some, bounds = S.tfidf_for_mix(queries, chunks, hits, 5, 0.35)
    for use_max in (False, True):
        assert rows(S.hybrid_weighted(some, hits, chunks, 5, use_max=use_max, bounds=bounds)) == rows(S.hybrid_weighted(every, hits, chunks, 5, use_max=use_max))


def test_scaled_scores_are_not_shuffled(spark):
    df = load()["e3_minmax"].run(spark, data_dir("0.001"))
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_word_matches_are_summed_where_the_chunks_lie(tables):
    queries, chunks = tables
    hits = S.matching_postings(queries, chunks).groupBy("chunk_id", "token").agg(F.count("*").alias("tf")).join(S.query_tokens(queries), "token")
    want = hits.groupBy("query_id").agg(F.count("*").alias("pairs"), F.count_distinct("chunk_id").alias("chunks"), F.sum("tf").alias("occurrences"))
    got = S.token_matches(queries, chunks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "chunk_id" not in plan.split("MapInArrow")[0]  # no chunk is shuffled


def test_products_do_not_depend_on_how_words_are_met(tables, monkeypatch):
    queries, chunks = tables
    want = rows(S.tfidf_top(queries, chunks, 5))
    assert want == rows(S.best(S.tfidf_scores(queries, chunks), 5))
    owner, word = np.array([0, 0, 2]), np.array([0, 1, 1])
    weights = S.Weights([{"a": 2.0}, {"b": 3.0, "a": 1.0}])
    light = weights.product(owner, word, np.array([1.0, 2.0, 4.0]), 3)
    monkeypatch.setattr(S, "DENSE_FROM", -1)
    assert light.tolist() == weights.product(owner, word, np.array([1.0, 2.0, 4.0]), 3).tolist() == [[2, 0, 0], [7, 0, 12]]


def test_a_task_keeps_only_what_can_still_be_among_the_best():
    scores, floor = np.array([[3.0, 1.0, 2.0]]), S.Floor(1, 2)
    assert S.keep_best(scores, 2, True, floor=floor)[1].tolist() == [0, 2]
    assert S.keep_best(np.array([[1.5, 2.0, 4.0]]), 2, True, floor=floor)[1].tolist() == [2]
    assert S.keep_best(np.array([[3.0, 2.9]]), 2, True, slack=0.2, floor=floor)[1].tolist() == [0, 1]


def test_a_phrase_is_counted_where_it_is_found(spark):
    texts = spark.createDataFrame([("a", "aaaa b"), ("b", "b aa"), ("c", None), ("d", "x")], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b")], "query_id long, q string")
    got = S.containing(texts, "content", asked, ["chunk_id"], "f").select("query_id", "chunk_id", "f").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 3), (1, "b", 1), (2, "a", 3), (2, "b", 1), (3, "a", 1), (3, "b", 1)]


def test_a_text_is_cut_once(spark):
    from folioscan.operators.chunking import window_chunks

    docs = spark.createDataFrame([(1, "a  b"), (2, " "), (3, None), (4, "x" * 12)], "id long, body string")
    df = window_chunks(docs, ["id"], "body", 10, 2)
    assert sorted(map(tuple, df.collect())) == [(1, 0, "a b"), (4, 0, "x" * 10), (4, 1, "xxxx")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_words_with_and_without_pairs_of_signs(spark):
    df = spark.createDataFrame([("Ab 中 c_1",), ("中文字 x",), (None,), ("",)], "text string").select(tokenize("text").alias("t"))
    assert [r[0] for r in df.collect()] == [["ab", "中", "c_1"], ["中文字", "中文", "文字", "x"], None, []]


def test_words_of_a_chunk_are_counted_without_shuffling_them(tables):
    _, chunks = tables
    chunks = chunks.unionByName(chunks.where("chunk_id < 'c2'"))  # some ids twice
    want = chunks.select("chunk_id", F.explode("tokens").alias("token")).groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))
    got = S.term_frequency(chunks)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "token#" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].split("\n", 1)[1]


def ids(df, column="query_id"):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_a_subgraph_scores_words_and_resolves_links_only_where_they_count(spark, monkeypatch):
    t, asked, linked = Tables(spark, data_dir("0.001")), [], []
    top, resolve = S.tfidf_top, links.G.resolve_links
    monkeypatch.setattr(S, "tfidf_top", lambda queries, *a, **b: asked.append(ids(queries)) or top(queries, *a, **b))
    monkeypatch.setattr(links.G, "resolve_links", lambda found, pages: linked.append(ids(found, "rel_path")) or resolve(found, pages))
    links.nodes(t)
    phrases, every = ids(retrieval.bm25(t)), ids(common.queries(t))
    assert phrases and asked == [every - phrases]  # a query with phrase hits has no other keyword hits
    assert len(linked) == 1 and linked[0] <= ids(links.hits(t), "rel_path")


def test_words_cut_for_the_scan_alone_give_the_same_scores(tables):
    queries, chunks = tables
    few = queries.where("query_id < 2")
    for by in (None, "scope_id"):
        assert rows(S.tfidf_top(few, chunks, 5, by, cut=True)) == rows(S.tfidf_top(few, chunks, 5, by))
    assert rows(S.tfidf_top(queries.where("query_id < 0"), chunks, 5, cut=True)) == []


def test_windows_of_long_texts(spark):
    texts = [("a" * 479 + "é") * 30, "ü" * (16 * 400 + 80), "ü" * (16 * 400 + 81), "x" * 480, "x" * 481, "b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, body string")
    got = K.window_chunks(df, ["i"], "body").collect()
    want = [(i, n, x[n * 400:n * 400 + 480]) for i, x in enumerate(texts) for n in range(1 if len(x) <= 480 else -(-(len(x) - 480) // 400) + 1)]
    assert sorted(map(tuple, got)) == want
