"""Equal-depth blocks, rarest-word answers and active-device sweeps against plain Python."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscan.operators import activity as A
from folioscan.operators import incremental as N
from folioscan.operators.sequences import equal_depth, page_of


def test_blocks_hold_about_as_many_rows(spark):
    """Half of the rows share one date, so dates alone would put them into one sort task."""
    rng = random.Random(4)
    rows = [(i, "2024-05" if i % 2 else f"2024-{1 + rng.randrange(12):02d}", f"f{rng.randrange(10**6):06d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, updated string, filename string")
    cuts = equal_depth(df, F.struct("updated", "filename"), parts=16, sample=2000)
    sizes = [r["count"] for r in df.groupBy(cuts.alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * len(rows) / 16
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[2], r[0]), reverse=True)]
    order = [F.desc("updated"), F.desc("filename"), F.desc("id")]
    for page in (1, 7, 80, 10_000):
        got = page_of(df, cuts, order, page, 50, descending=True).orderBy("position").collect()
        at = (min(page, 80) - 1) * 50
        assert [r["id"] for r in got] == want[at:at + 50] and {r["total"] for r in got} == {4000}
    empty = df.limit(0)
    assert page_of(empty, equal_depth(empty, F.struct("updated")), order, 1, 5).count() == 0


@pytest.mark.parametrize("opening", [1, 64])
def test_rarest_words_find_the_best_answers(spark, monkeypatch, opening):
    monkeypatch.setattr(A, "OPENING_ROWS", opening)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    draw = lambda n: " ".join(["the", "a", *(words[min(199, int(rng.expovariate(0.03)))] for _ in range(n))])
    qa = [(f"s:{i:03d}", draw(rng.randint(0, 6)), draw(rng.randint(0, 12)), int(i % 5 > 0)) for i in range(300)]
    asked = [(i, draw(rng.randint(0, 9)) if i else "the") for i in range(40)] + [(99, ""), (98, "nobody wrote this")]
    got = A.related_qa(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(qa, "id string, question string, answer string, grounded int"), [F.desc("id")])
    split = lambda t: set(re.findall("[a-z0-9_]+", t))
    want = set()
    for q, text in asked:
        scores = [(len(split(text) & split(f"{x} {y}")) + 0.5 * len(split(text) & split(x)), i) for i, x, y, g in qa if g]
        want |= {(q, i, s) for s, i in sorted((s for s in scores if s[0]), reverse=True)[:3]}
    assert {(r["query_id"], r["id"], r["score"]) for r in got.collect()} == want


def test_words_that_all_rows_share_make_no_pairs(spark, monkeypatch):
    """The rows joined grow with the answers, not with answers times questions."""
    monkeypatch.setattr(A, "OPENING_ROWS", 4)
    seen = []
    real = A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, label="": seen.append((label, real(df, label))) or seen[-1][1])
    for n in (100, 400):
        qa = spark.createDataFrame([(f"{i:04d}", f"the of and topic{i} more{i}", "the of and", 1) for i in range(n)], "id string, question string, answer string, grounded int")
        asked = spark.createDataFrame([(i, f"the of and topic{i} more{i} topic{i + 1} topic{i + 2}") for i in range(50)], "query_id long, text string")
        seen.clear()
        got = A.related_qa(asked, qa, [F.desc("id")])
        assert got.where("rank = 1 and cast(id as int) = query_id").count() == 50
        first = next(df for label, df in seen if label == "first")
        assert first.count() == 150


def test_questions_beyond_a_shipped_size_find_the_same(spark, monkeypatch):
    qa = spark.createDataFrame([(f"{i:02d}", f"the topic{i % 7} more{i % 5}", f"word{i % 3}", 1) for i in range(60)], "id string, question string, answer string, grounded int")
    asked = spark.createDataFrame([(i, f"the topic{i} more{i} word1") for i in range(8)], "query_id long, text string")
    found = lambda: sorted(tuple(r) for r in A.related_qa(asked, qa, [F.desc("id")]).select("query_id", "id", "score").collect())
    scans = []
    real = A._overlaps
    monkeypatch.setattr(A, "_overlaps", lambda *a: scans.append(1) or real(*a))
    shipped = found()
    monkeypatch.setattr(A, "many_queries", lambda queries: True)
    assert shipped == found() and len(scans) == 1


def test_active_devices_by_sweep(spark):
    rng = random.Random(1)
    start = dt.datetime(2026, 1, 1)
    beats = [(f"d{rng.randrange(6)}", start + dt.timedelta(days=rng.choice([0, 1, 2, 9, 10, 30]), hours=rng.randrange(24))) for _ in range(60)]
    df = spark.createDataFrame(beats, "device_id string, ts timestamp_ntz")
    for days in (1, 3, 7, 40):
        last = max(t.date() for _, t in beats)
        want = {}
        for i in range((last - start.date()).days + 1):
            day = start.date() + dt.timedelta(days=i)
            active = {d for d, t in beats if 0 <= (day - t.date()).days < days}
            if active:
                want[day] = len(active)
        assert {r["day"]: r["devices"] for r in N.rolling_active(df, days).collect()} == want
        assert {r["day"]: r["devices"] for r in N.rolling_active_sketch(df, days).collect()} == want  # few devices: the sketch is exact
    assert N.rolling_active(df.limit(0)).count() == 0
