"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscan.llm.queries import QUERIES
from folioscan.llm.spelling import LONGER, SAME, Tree, letter_counts, near_words, one_edit, rooted_words, spelling_variants

SF = "/root/testdata/sf0.001"


def brute_words(rows):
    seen = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def deletions(w):
    return {w[:i] + w[i + 1:] for i in range(len(w))}


def brute_near(words):
    """All near pairs through masks: one letter blanked (replaced) or taken out (deleted)."""
    masks, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            masks.setdefault((w[:i], w[i + 1:]), []).append(w)
        for d in deletions(w):
            if d in near:
                near[w].add(d)
                near[d].add(w)
    for same in masks.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    return near


def brute(words):
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(brute_words(docs))
    assert rows_of(QUERIES["op13_spelling"](spark, SF)) == want and len({r for _, r, *_ in want.values()}) < len(want)


@pytest.mark.parametrize("cell,sample", [(20, 40), (20, 10_000), (5000, 100)])
def test_cut_cells_lose_no_pair(spark, cell, sample):
    rng = random.Random(7)
    words = set()
    while len(words) < 1500:
        w = "".join(rng.choice("abcdé") for _ in range(rng.randint(5, 7)))
        words.add(w)
    counts = {w: rng.choice([3, 4, 8, 8, 20, 50]) for w in sorted(words)}
    near = brute_near(counts)
    want = {w: (len(x), *min((-counts[y], y) for y in x)) for w, x in near.items() if x}
    got = near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), cell, sample).collect()
    assert {r["word"]: (r["n_near"], -r["near_n"], r["near"]) for r in got} == want


def test_boxes_hold_every_edit():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(8)) for _ in range(400)]
    vectors = letter_counts(words)
    tree = Tree()
    tree.grow(0, vectors, 3)
    for seek in (SAME, LONGER):
        asked = letter_counts([w[:8 - seek] for w in words])
        rows, leaves = tree.reach(asked, seek)
        assert len(set(zip(rows, leaves))) == len(rows) < 0.5 * len(words) * len(set(leaves))
        reached, own = set(zip(rows.tolist(), leaves.tolist())), tree.own(vectors)
        for i in range(400):
            for j in range(400):
                move = vectors[j] - asked[i]
                plus, minus = np.flatnonzero(move > 0), np.flatnonzero(move < 0)
                if np.abs(move).sum() == 2 - seek and len(plus) == 1 and (seek or minus[0] < plus[0]):
                    assert (i, own[j]) in reached


def test_letters_are_compared_in_order():
    code = lambda *ws: np.array([[ord(c) for c in w] for w in ws])
    assert one_edit(code("abcd", "abcd", "abcd", "abcd"), code("abxd", "abcd", "badc", "xbcd")).tolist() == [True, False, False, True]
    assert one_edit(code("abcd", "abcd", "abcd", "aaaa", "abcd"), code("xabcd", "abcdx", "abxcd", "aaaaa", "acbdx")).tolist() == [True, True, True, True, False]


def test_odd_rows(spark):
    data = [(1, "Receive receive RECEIVE receive"), (1, "Receive receive RECEIVE receive"), (2, "recieve receve receve receve"), (None, "recéive recéive recéive"), (4, None), (5, ""),
            (6, "a" * 60_000 + " " + "a" * 60_000), (7, "a" * 60_000), (8, "1234 --- \n"), (9, "Éclair Éclair éclair éclair Éclair éclair")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as run")
    got = rows_of(spelling_variants(docs))
    assert got == brute(brute_words(data)) and got["receve"][0] == "receive" and "a" * 60_000 in got
    assert spelling_variants(docs.limit(0)).count() == 0


def test_roots_follow_the_chain(spark):
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("d", "c"), ("e", None), ("f", "a")], "word string, form string")
    assert {r["word"]: r["root"] for r in rooted_words(forms).collect()} == {"a": "c", "b": "c", "c": "c", "d": "c", "e": "e", "f": "c"}
