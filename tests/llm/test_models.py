"""Toxicity chain, language fusion and mixing: held-out accuracy, evidence, marginals."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm.langid import BINS, OVERLAP, identify, score_texts, trigram_bins
from folioscan.llm.mixing import mix, rake, tempered
from folioscan.llm.queries import QUERIES
from folioscan.llm.toxicity import best_threshold, score_toxicity, train_chain

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = score_toxicity(docs, train, ["doc_id"]).withColumnRenamed("toxic", "said").join(test.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    rows = got.select("said", "y").collect()
    hits = sum(r["said"] and r["y"] == 1 for r in rows)
    assert sum(r["said"] and r["y"] == 0 for r in rows) <= 0.02 * len(rows)
    assert hits >= 0.6 * sum(r["y"] == 1 for r in rows)


def test_chain_uses_earlier_links():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(10, 200, 12)) for _ in range(600)]
    first = (rng.random(600) < 0.4).astype(float)
    rows = [np.append(r, 3) if f else r for r, f in zip(rows, first)]
    links, cut, held_out = train_chain(rows, {"a": first, "b": first})
    assert links["b"].earlier[0] > 0 and len(links["a"].earlier) == 0 and 0 < cut < 1
    assert ((held_out["b"] >= cut) == first).mean() > 0.97
    assert best_threshold(np.zeros(0), np.zeros(0)) == 0.5


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot " * 3), (2, None), (3, ""), (None, "fine words"), (1, "you idiot " * 3)] + [(i, f"plain words number {i}") for i in range(10, 40)],
                                 "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (99, 1)] + [(i, 0) for i in range(10, 40)], "doc_id long, toxic int")
    rows = score_toxicity(docs, labels, ["doc_id"]).collect()
    assert len(rows) == 35 and not any(r["toxic"] for r in rows if r["doc_id"] in (2, 3))
    assert len({r["p_toxic"] for r in rows if r["doc_id"] == 1}) == 1
    assert not any(r["toxic"] for r in score_toxicity(docs, labels.limit(0), ["doc_id"]).collect())
    assert score_toxicity(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_languages_agree_with_the_corpus(spark):
    rows = QUERIES["op7_language"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert sum(r["detected"] == docs[r["doc_id"]]["lang"] for r in rows) >= 0.99 * len(rows)
    assert all(r["accepted"] for r in rows if docs[r["doc_id"]]["n_chars"] > 200)


def test_evidence_decides_where_the_text_is_silent(spark):
    rng = random.Random(2)
    make = {"xx": "abcde", "yy": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(make[lang]) for _ in range(5)) for _ in range(30)), lang, f"{lang}.example.net", "net") for i in range(200) for lang in [rng.choice(["xx", "yy"])]]
    rows += [(1000, "q", None, "yy.example.net", None), (1001, "q", None, "www.unknown.org", None), (1002, "q", "xx", None, None), (1003, "123 !?", "xx", "xx.example.net", "net"),
             (1004, None, "xx", None, None), (1005, "", None, None, None), (1000, "q", None, "yy.example.net", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, suffix string")
    got = {r["doc_id"]: r for r in identify(docs, ["doc_id"], declared="lang", suffix="suffix", host="source").collect()}
    assert all(got[i]["detected"] == lang and got[i]["accepted"] for i, _, lang, _, _ in rows[:200])
    assert got[1000]["detected"] == "yy" and got[1000]["probability"] > 0.8 and got[1002]["detected"] == "xx"
    assert got[1001]["probability"] < got[1000]["probability"]
    assert [got[i]["detected"] for i in (1003, 1004, 1005)] == ["und"] * 3 and not any(got[i]["accepted"] for i in (1003, 1004, 1005))
    assert identify(docs, ["doc_id"], host="source").count() == len(rows)
    nobody = identify(docs.withColumn("lang", F.lit(None).cast("string")), ["doc_id"])
    assert nobody.where("accepted").count() == 0 and identify(docs.limit(0), ["doc_id"]).count() == 0


def test_rare_languages_are_known_and_strange_texts_are_not(spark):
    rng = random.Random(6)
    make = {"xx": "abcde", "rr": "jklmn", "none": "\u0431\u0432\u0433\u0434\u0435"}
    text = lambda lang: " ".join("".join(rng.choice(make[lang]) for _ in range(5)) for _ in range(30))
    rows = [(i, text("xx"), "xx") for i in range(30_000)] + [(30_000 + i, text("rr"), "rr") for i in range(25)] + [(40_000, text("none"), "xx")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"], host=None).collect()}
    assert all(got[30_000 + i]["detected"] == "rr" and got[30_000 + i]["accepted"] for i in range(25)) and got[0]["detected"] == "xx"
    assert got[40_000]["detected"] == "und" and not got[40_000]["accepted"]


def test_mix_meets_every_marginal(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    share = lambda d, values: spark.createDataFrame(list(values.items()), f"{d} string, share double")
    sources = {r["source"]: 1.0 for r in docs.select("source").distinct().collect()}
    goals = {"mix_source": {s: 1 / len(sources) for s in sources}, "mix_lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    rows = mix(docs, ["doc_id"], targets={d: share(d, v) for d, v in goals.items()}, rounds=15, share=0.5).cache()
    total = rows.agg(F.sum(F.col("weight") * F.col("mix_tokens")), F.sum("mix_tokens"), F.sum(F.col("copies") * F.col("mix_tokens"))).first()
    assert abs(total[0] / total[1] - 0.5) < 1e-6 and abs(total[2] / total[1] - 0.5) < 0.08
    for dim, goal in goals.items():
        for r in rows.groupBy(dim).agg(F.sum(F.col("weight") * F.col("mix_tokens")).alias("t")).collect():
            assert r["t"] / total[0] == pytest.approx(goal[r[dim]], abs=0.004)


def test_mix_goes_on_until_the_marginals_fit(spark):
    rows = [(i, "word " * 10, f"s{i % 3}", f"l{i % 3 if i % 60 else (i // 60) % 3}") for i in range(1800)]  # source and language go together
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    share = lambda d, *values: spark.createDataFrame(list(enumerate(values)), "n long, share double").selectExpr(f"concat('{d[4]}', n) as {d}", "share")
    goals = {"mix_source": share("mix_source", 0.5, 0.3, 0.2), "mix_lang": share("mix_lang", 0.35, 0.35, 0.3)}
    got = mix(docs, ["doc_id"], targets=goals)
    for dim, goal in goals.items():
        sums = got.groupBy(dim).agg(F.sum(F.col("weight") * F.col("mix_tokens")).alias("t")).join(goal, dim).collect()
        whole = sum(r["t"] for r in sums)
        assert all(r["t"] / whole == pytest.approx(r["share"], rel=2e-3) for r in sums)
    with pytest.warns(RuntimeWarning, match="contradict"):
        mix(docs.where("substr(source, 2) = substr(lang, 2)"), ["doc_id"], targets=goals)


def test_mix_reads_long_runs_in_time(spark):
    """A run of letters without an address takes time in proportion to its length."""
    long = "a" * 400_000
    docs = spark.createDataFrame([(1, long), (2, f"{long}@b.c"), (3, f"{long}@b {long}")], "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang")
    mix(docs.limit(0), ["doc_id"]).count()  # the session is warm
    began = time.monotonic()
    got = {r["doc_id"]: (r["mix_topic"], r["mix_tokens"]) for r in mix(docs, ["doc_id"]).collect()}
    assert got == {1: ("prose", 1), 2: ("contact", 1), 3: ("prose", 2)} and time.monotonic() - began < 60


def test_raking_plans_little(spark):
    """A half-round shuffles once: its jobs and plans are what fills the driver's memory."""
    cells = spark.createDataFrame([(f"s{i % 3}", f"l{i % 2}", f"t{i % 5}", i + 1) for i in range(30)], "mix_source string, mix_lang string, mix_topic string, tokens long")
    share = {d: tempered(cells, d, 0.5).cache() for d in ("mix_source", "mix_lang", "mix_topic")}
    group = f"rake-{time.monotonic()}"
    spark.sparkContext.setJobGroup(group, "raking")
    fitted, error = rake(cells, share, 6)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert error < 1e-3 and fitted.count() == 30 and len(jobs) <= 75


def test_mix_of_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (3, "some words here", "s", None), (3, "some words here", "s", None), (None, "under a license", None, "en"), (5, "mail a@b.c ###", "t", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("tokens", F.lit(1))
    got = mix(docs, ["doc_id", "tokens"]).collect()
    assert len(got) == 6 and [r["weight"] for r in got if r["doc_id"] == 1] == [0.0]
    assert len({(r["weight"], r["copies"]) for r in got if r["doc_id"] == 3}) == 1
    assert {r["mix_topic"] for r in got} == {"prose", "legal", "contact"}
    assert mix(docs.limit(0), ["doc_id"]).count() == 0


def test_likelihoods_match_brute_force_on_any_length(spark):
    rng = np.random.default_rng(5)
    texts = ["the quick brown fox", "", "ab", "le renard brun saute par dessus le chien", "the fox and the dog " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    logs = np.log(rng.dirichlet(np.ones(BINS), 3))
    got = {r["doc_id"]: r for r in score_texts(docs, ["doc_id"], "text", logs).collect()}
    for i, text in enumerate(texts):
        bins = trigram_bins(text)
        if got[i]["like__"] is None:
            continue
        like = np.array([sum(logs[j, b] for b in bins[:10**5].tolist()) for j in range(3)]) / OVERLAP if len(bins) <= 10**5 else logs[:, bins].sum(axis=1) / OVERLAP
        assert np.allclose(got[i]["like__"], like - like.max(), rtol=1e-6) and got[i]["vote__"] == int(like.argmax())
