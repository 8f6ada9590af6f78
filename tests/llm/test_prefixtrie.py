"""The prefix trie against rebuilt conversations in plain Python."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioscan.llm import prefixtrie
from folioscan.llm.prefixtrie import prefix_trie
from folioscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    turns = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            turns.setdefault(c, []).append((r or "", x or ""))
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    digest = lambda s, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(s)).encode()).hexdigest()
    return sorted(repr((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], digest(s, m))) for s, m in members.items())


def trie(turns, **more):
    conv = F.col("conv")
    return prefix_trie(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, most_head=8, **more)


def rows_of(df):
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_prefix_trie"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("span,ids,salts", [(10, 4096, 1024), (1, 2, 2)])
def test_shared_and_long_conversations(spark, monkeypatch, span, ids, salts):
    for name, value in (("SPAN", span), ("IDS", ids), ("SALTS", salts)):
        monkeypatch.setattr(prefixtrie, name, value)
    rng = random.Random(6)
    rows = []
    for c in [*range(-7, 60), 1000, 1001, 1003]:  # many start alike, in several places
        n = rng.choice([0, 1, 2, 5, 9, 14]) or 1
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello ü", "", "see you"])) for t in range(n)]
    rows += [(2000, t * 3, "user", "same" if t < 40 else f"x{t}") for t in range(60)] + [(2001, t, "user", "same") for t in range(50)] + [(2007, 5, "user", "only")]
    rows += [(70, None, None, None), (70, None, None, None), (70, 3, None, "z"), (70, 3, "a", "y"), (71, None, "b", ""), (None, 1, "user", "no id"), (72, 0, "user", "w" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "'x' as conv", "2 as block")
    assert rows_of(trie(turns)) == brute(rows)
    assert trie(turns.limit(0)).count() == 0


def test_colliding_hashes_are_seen(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {c % 3} {t}") for c in range(40) for t in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefixtrie, "EACH", range(1))
    real, tried = prefixtrie.stored_turns, []

    def weak(*given):  # under the first seed all turns hash alike
        tried.append(given[-1])
        made = real(*given)
        return made.withColumn("e0", F.lit(1).cast("long")) if len(tried) == 1 else made

    monkeypatch.setattr(prefixtrie, "stored_turns", weak)
    monkeypatch.setattr(prefixtrie, "NODE", ["depth", "f0"])
    assert rows_of(trie(turns)) == brute(rows) and len(tried) == 2
