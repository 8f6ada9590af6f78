"""Near-duplicate classes and benchmark leaks against brute force."""

import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscan.llm import similar, simhash
from folioscan.llm.common import components
from folioscan.llm.decontaminate import Finder, edit_distance, edits_allowed, find_leaks
from folioscan.llm.queries import QUERIES
from folioscan.llm.similar import similar_classes

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(points, near):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    points = list(points)
    for i, x in enumerate(points):
        for y in points[:i]:
            if near(x, y):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


def test_query_matches_brute_force(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = {d: brute_fingerprint(t or "") for d, t in text.items()}
    root = roots(set(marks.values()), lambda x, y: (x ^ y).bit_count() <= 4)
    first = {}
    for d, m in marks.items():
        first[root[m]] = min(first.get(root[m], d), d)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {d: (format(m, "016x"), first[root[m]]) for d, m in marks.items()}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(3)
    points = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for bit in rng.sample(range(64), rng.randint(0, 9)):
                x ^= 1 << bit
            points.add(x - (1 << 64) if x >> 63 else x)
    return sorted(points), spark.createDataFrame([(p,) for p in sorted(points)], "fp long")


@pytest.mark.parametrize("limit,crowd", [(4, 4000), (4, 3), (3, 3)])
def test_links_lose_nothing(cloud, limit, crowd):
    points, nodes = cloud
    want = roots(points, lambda x, y: ((x ^ y) & MASK).bit_count() <= limit)
    got = {r["node"]: r["root"] for r in components(simhash.links(nodes, limit, crowd)).collect()}
    assert {p: got.get(p, p) for p in points} == want


def test_thresholds():
    cost, dealt = simhash.deal_thresholds([[1, 5, 9], [100, 200, 300], [1, 2, 50]], 4)
    assert sum(r + 1 for r in dealt) == 5 and cost == 11 and dealt == [2, -1, 1]


def test_odd_rows(spark):
    rows = [(5, "same words here again and again"), (3, "same words here again and again"), (None, "same words here again and again"), (7, ""), (8, None), (9, " \n"), (None, "alone it is"), (11, "x" * 100_000), (3, "other words altogether now")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id"))
    assert sorted(((r["doc_id"] or 0), r["component_id"] or 0) for r in got.collect()) == sorted([(5, 3), (3, 3), (0, 3), (7, 7), (8, 7), (9, 7), (0, 0), (11, 11), (3, 3)])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingle_sets(rows):
    return {d: {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} for d, w in ((d, (t or "").split()) for d, t in rows)}


def families(rng, count, copies, least, most, size=200):
    words, rows = [f"w{i}" for i in range(3000)], []
    for f in range(count):
        base = [rng.choice(words) for _ in range(size)]
        for c in range(copies):
            copy = list(base)
            for at in rng.sample(range(size), rng.randint(least, most) * (c > 0)):
                copy[at] = rng.choice(words)
            rows.append((f * 1000 + c, " ".join(copy)))
    return rows


def check_classes(rows, got, least=0.95):
    """Every class holds together by links of 0.8; `least` of the linked pairs are in one class."""
    sets = shingle_sets(rows)
    near = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    blocks = {}
    for d in sets:
        blocks.setdefault(d // 1000, []).append(d)
    pairs = [(x, y) for b in blocks.values() for x in b for y in b if y < x and near(x, y)]
    assert pairs and sum(got[x] == got[y] for x, y in pairs) >= least * len(pairs)
    want = roots(sorted(sets), lambda x, y: x // 1000 == y // 1000 and near(x, y))
    assert all(want[d] == want[r] for d, r in got.items())  # no false link


def classes_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as keys")
    return {r["doc_id"]: r["component_id"] for r in similar_classes(docs, **more).collect()}


@pytest.mark.parametrize("crowd", [2000, 8])
def test_links_are_verified_on_shingles(spark, crowd):
    """Similarities around 0.8: half of a family's pairs are no link, so keys stay open after the stars."""
    rows = families(random.Random(9), 60, 5, 2, 6)
    check_classes(rows, classes_of(spark, rows, crowd=crowd))


@pytest.mark.parametrize("crowd", [2000, 20])
def test_a_large_family_and_unlike_members_of_one_key(spark, monkeypatch, crowd):
    rng = random.Random(5)
    rows = families(rng, 1, 150, 1, 6) + [(d + 5000, t) for d, t in families(rng, 1, 200, 30, 60)] + [(d + 9000, t) for d, t in families(rng, 20, 2, 1, 2)]
    check_classes(rows, classes_of(spark, rows, crowd=crowd))
    monkeypatch.setattr(similar.Bands, "keys", lambda self, low: np.zeros(self.bands, np.int64))  # all texts share every key
    check_classes(rows, classes_of(spark, rows, crowd=crowd), least=1.0)


def test_no_pair_at_the_similarity_is_lost(spark):
    """One word of 49 changed: 40 of 50 shingles are shared. Bands of minima miss some two in a thousand of such pairs."""
    rng = random.Random(21)
    rows = []
    for f in range(4000):
        base = [f"w{rng.randrange(100_000)}" for _ in range(49)]
        rows += [(2 * f, " ".join(base)), (2 * f + 1, " ".join([*base[:24], "changed", *base[25:]]))]
    got = classes_of(spark, rows)
    assert [f for f in range(4000) if got[2 * f] != got[2 * f + 1]] == []
    assert len(set(got.values())) == 4000


@pytest.mark.parametrize("crowd", [2000, 8])
def test_prefixes_alone_lose_nothing(spark, monkeypatch, crowd):
    monkeypatch.setattr(similar.Bands, "keys", lambda self, low: np.arange(self.bands) + xxhash.xxh64_intdigest(low.tobytes()) // 4)  # no two texts share a band
    rng = random.Random(6)
    rows = families(rng, 40, 5, 2, 6) + [(d + 100_000, t) for d, t in families(rng, 1, 60, 1, 6)] + [(d + 200_000, t) for d, t in families(rng, 30, 4, 1, 2, size=49)]
    rows += [(300_000, "a b c d e f g"), (300_001, "a b  c d e f g"), (301_000, ""), (301_001, " ")]
    check_classes(rows, classes_of(spark, rows, crowd=crowd), least=1.0)


@pytest.mark.parametrize("size", [1, 2, 5, 9, 10, 11, 45, 200])
def test_prefixes_and_bins_of_pairs_at_the_similarity(size):
    rng = np.random.default_rng(size)
    common = np.sort(rng.integers(1 << 40, size=50, dtype=np.uint64))
    for _ in range(200):
        both = rng.integers(1 << 63, size=size, dtype=np.uint64)
        both[:size // 3] = common[:size // 3] if size // 3 <= 50 else both[:size // 3]
        own = [rng.integers(1 << 63, size=rng.integers(0, max(1, size // 8) + 1), dtype=np.uint64) for _ in range(2)]
        x, y = (np.unique(np.concatenate([both, o])) for o in own)
        if similar.alike(x, y, 0.8):
            assert set(similar.prefix(x, common, 0.8).tolist()) & set(similar.prefix(y, common, 0.8).tolist())
            assert similar.maybe_alike(similar.thinned(x), similar.thinned(y), 0.8)
            unlike = np.abs(np.frombuffer(similar.binned(x), np.uint8).astype(int) - np.frombuffer(similar.binned(y), np.uint8)).sum()
            assert unlike <= (len(x) + len(y)) / 9 + 1e-6


def test_odd_texts_have_classes(spark):
    rows = [(1, ""), (2, None), (3, " \n"), (None, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "x" * 100_000), (7, "x" * 100_000), (8, "x " * 100_000), (9, "y " * 100_000 + "z")]
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 5), (1, 1), (2, 1), (3, 1), (5, 5), (6, 6), (7, 7), (7, 7), (8, 8), (9, 9)]
    assert similar_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_class_stays(spark):
    base = [f"w{i * i % 997}" for i in range(300)]
    near = " ".join([*base[:100], "other", *base[101:]])
    rows = [(4, " ".join(base), "a"), (3, near, "b"), (3, "quite another text under the same id", "b"), (3, near, "b"), (3, near, "c"), (None, near, "d"), (None, "a text without an id", "e"),
            (None, "a text without an id", "e"), (9, None, None), (10, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mark__x", F.lit(1))
    kept = similar.keep_one(docs).collect()
    assert sorted(((r["doc_id"] or 0), (r["text"] or "")[:7], r["lang"] or "") for r in kept if r["text"] != near) == [(0, "a text ", "e"), (3, "quite a", "b"), (9, "", "")]
    assert [(r["doc_id"], r["lang"] in ("b", "c")) for r in kept if r["text"] == near] == [(3, True)] and len(kept) == 4
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_leaks_reach_recall_and_are_exact(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 50)))) for i in range(60)] + [(90, ""), (91, None)]
    rows, planted = [], {}
    for d in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if d % 2:
            i = rng.randrange(60)
            piece = items[i][1].split()
            for _ in range(rng.randint(0, edits_allowed(len(piece), 0.8))):
                at, kind = rng.randrange(len(piece)), rng.randrange(3)
                piece[at:at + 1] = [["changed"], [piece[at], "added"], []][kind] if len(piece) > 2 else [piece[at]]
            at = rng.randint(0, len(words))
            words[at:at] = piece
            planted[d] = i
        rows.append((d, " ".join(words)))
    rows += [(300, None), (301, ""), (None, items[0][1]), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as hits")
    found = find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: {h["item_id"]: h for h in r["hits"]} for r in found if r["doc_id"] is not None}
    assert sum(i in got[d] for d, i in planted.items()) / len(planted) >= 0.98
    text = dict(rows)
    number = {w: n for n, w in enumerate(sorted({w for _, t in [*rows, *items] for w in (t or "").split()}))}
    coded = lambda t: np.array([number[w] for w in t.split()], np.int64)
    for d, hits in got.items():
        for i, h in hits.items():
            n = len(items[i][1].split())
            assert edit_distance(coded(items[i][1]), coded(text[d]))[0] <= h["distance"] <= edits_allowed(n, 0.8)
    assert [[h["item_id"] for h in r["hits"]] for r in found if r["doc_id"] is None] == [[0], [0]]
    assert find_leaks(docs, spark.createDataFrame([], "item_id long, text string"), ["doc_id"]).where("size(hits) > 0").count() == 0


def test_every_exact_leak_is_found(spark):
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(r["doc_id"], i) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for i, t in items.items() if t in norm(r["text"])}
    rows = QUERIES["op2_decontaminate"](spark, SF).collect()
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in rows if r["distance"] == 0}


def test_number_of_tables_follows_the_recall():
    items = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(20 + i % 9))) for i in range(40)]
    few, many = Finder(items, 0.8, 0.8), Finder(items, 0.8, 0.99)
    assert 1 <= few.tables < many.tables <= 64


def test_long_items_take_memory_by_blocks(monkeypatch):
    rng, blocks, real = random.Random(11), [], Finder.block_keys
    word = lambda: f"w{rng.randrange(400)}"
    long = [word() for _ in range(3000)]
    items = [(i, " ".join(word() for _ in range(40))) for i in range(49)] + [(99, " ".join(long))]
    monkeypatch.setattr(Finder, "block_keys", lambda self, rows, sizes, tables: blocks.append(len(rows) * int(sizes.max() * 1.6)) or real(self, rows, sizes, tables))
    monkeypatch.setattr("folioscan.llm.decontaminate.CELLS", 20_000)
    start = time.time()
    finder = Finder(items, 0.8, 0.95)
    got = finder.find([" ".join(word() for _ in range(400)) + " " + items[i][1] for i in range(20)])
    assert [[h["item_id"] for h in hits if h["distance"] == 0] for hits, in got] == [[i] for i in range(20)]
    edited = ["start"] * 30 + long[:1000] + ["other"] + long[1001:2000] + long[2001:]
    hits = finder.find([" ".join(edited)])[0][0]
    assert [(h["item_id"], h["distance"]) for h in hits if h["size"] == 3000] == [(99, 2)]
    assert max(blocks) <= 20_000 and time.time() - start < 60
