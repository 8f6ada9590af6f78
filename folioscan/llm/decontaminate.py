"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A CGK walk (Chakraborty, Goldenberg, Koucky 2016) reads a word sequence with a random walk that advances or repeats by a
shared random function of step and word. Two sequences a few edits apart fall into step again, so edit distance becomes
Hamming distance of the walks. Tables keyed on a few sampled steps then find near windows; the number of tables is the
smallest that reaches the target recall on items edited up to the limit. Every hit is verified by its exact edit distance.

A window is opened wherever a text shares a run of words with an item, at the item's start and of the item's size. By
pigeonhole no passage within the limit lacks such a run: t edits leave the other n - t words in at most t + 1 runs."""

from __future__ import annotations

import math
import random
import warnings
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices
from .licenses import words_of

SAMPLED = 2      # steps per table
WALKS = 8        # independent walks, shared by the tables
REACH = 1.6      # steps per word that are sampled; a walk takes two steps per word on average, so it is still inside the item
MOST_TABLES = 64
CELLS = 1 << 21  # cells of the walks held at once
SEED = 20240607
ROWS = 2048      # texts embedded at once
HITS = "hits array<struct<item_id:long,start:long,distance:long,size:long>>"


def edits_allowed(size: int, similarity: float) -> int:
    return int(math.floor(size * (1 - similarity) + 1e-9))


def run_length(size: int, edits: int) -> int:
    """Words of the longest run that survives any `edits` edits, three at most."""
    return max(1, min(3, -(-(size - edits) // (edits + 1))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def walk(rows: np.ndarray, steps: int, number: int) -> np.ndarray:
    """CGK walk over the rows of word numbers (padded with 0): the word seen at each step."""
    out = np.empty((len(rows), steps), np.int64)
    at, every, last = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.shape[1] - 1
    for step in range(steps):
        seen = rows[every, at]
        out[:, step] = seen
        bit = _mix(seen.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * WALKS + number + 1)) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), last)
    return out


def edit_distance(item: np.ndarray, span: np.ndarray) -> tuple[int, int]:
    """Least edits that turn `item` into some piece of `span`, and where the best piece ends (earliest on ties)."""
    before = np.zeros(len(span) + 1, np.int64)
    ramp = np.arange(len(span) + 1)
    for i, word in enumerate(item.tolist(), 1):
        row = np.empty_like(before)
        row[0] = i
        row[1:] = np.minimum(before[:-1] + (span != word), before[1:] + 1)
        before = np.minimum.accumulate(row - ramp) + ramp
    end = int(before.argmin())
    return int(before[end]), end


class Finder:
    """Index of a block of items: word numbers, shared runs, LSH tables."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float):
        self.similarity = similarity
        self.ids, texts = [], []
        for item_id, text in items:
            words = words_of((text or "").lower())
            if words:
                self.ids.append(item_id)
                texts.append(words)
        self.number: dict[bytes, int] = {}
        for words in texts:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.items = [np.array([self.number[w] for w in words], np.int64) for words in texts]
        self.sizes = np.array([len(i) for i in self.items], np.int64)
        self.edits = np.array([edits_allowed(n, similarity) for n in self.sizes.tolist()], np.int64)
        self.base = len(self.number) + 2
        runs: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for at, (item, edits) in enumerate(zip(self.items, self.edits.tolist())):
            k = run_length(len(item), edits)
            for start, code in enumerate(self.codes(item, k).tolist()):
                runs[k][code].append((at, start))
        self.runs = {k: dict(v) for k, v in runs.items()}
        self.run_codes = {k: np.array(sorted(v), np.int64) for k, v in self.runs.items()}
        rng = random.Random(SEED)
        self.spots = [[rng.random() for _ in range(SAMPLED)] for _ in range(MOST_TABLES)]
        self.tables = self.needed(recall) if self.items else 0
        self.filed: dict[int, list[int]] = defaultdict(list)
        if self.items:
            keys = self.keys(self.items, self.sizes, self.tables)
            for at in range(len(self.items)):
                for key in set(keys[at].tolist()):
                    self.filed[key].append(at)
        self.filed_keys = np.array(sorted(self.filed), np.uint64)

    def codes(self, words: np.ndarray, k: int) -> np.ndarray:
        """One number for each run of k words; -1 where a word is in no item."""
        count = len(words) - k + 1
        if count < 1:
            return np.empty(0, np.int64)
        code, known = np.zeros(count, np.int64), np.ones(count, bool)
        for i in range(k):
            part = words[i:i + count]
            code = code * self.base + part
            known &= part > 0
        return np.where(known, code, -1)

    def keys(self, rows: list[np.ndarray], sizes: np.ndarray, tables: int) -> np.ndarray:
        """Table keys of each row, read as a window for items of the given size. Rows are walked in blocks of like sizes, so that
        memory follows `CELLS` and not the longest item."""
        keys, order, at = np.empty((len(rows), tables), np.uint64), np.argsort(sizes, kind="stable")[::-1], 0
        while at < len(order):
            some = order[at:at + max(1, CELLS // int(sizes[order[at]] * REACH + 2))]
            keys[some] = self.block_keys([rows[i] for i in some.tolist()], sizes[some], tables)
            at += len(some)
        return keys

    def block_keys(self, rows: list[np.ndarray], sizes: np.ndarray, tables: int) -> np.ndarray:
        steps = int(sizes.max() * REACH) + 1
        rows = [r[:steps] for r in rows]
        width = max(len(r) for r in rows) + 1
        padded = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            padded[i, :len(r)] = r
        keys, every = np.empty((len(rows), tables), np.uint64), np.arange(len(rows))
        for number in range(min(WALKS, tables)):
            seen = walk(padded, steps, number)
            for table in range(number, tables, WALKS):
                key = sizes.astype(np.uint64) * np.uint64(MOST_TABLES) + np.uint64(table)
                for spot in self.spots[table]:
                    step = (spot * REACH * sizes).astype(np.int64)
                    key = _mix(key) + seen[every, step].astype(np.uint64)
                keys[:, table] = _mix(key)
        return keys

    def needed(self, recall: float) -> int:
        """Tables that reach the target recall on copies of the items with as many random edits as are allowed."""
        rng = random.Random(SEED + 1)
        pick = list(range(len(self.items)))[:: max(1, len(self.items) // 200)]
        edited, origin = [], []
        for at in pick:
            for _ in range(5):
                words = self.items[at].tolist()
                for _ in range(int(self.edits[at])):
                    spot, kind = rng.randrange(len(words)), rng.randrange(3)
                    if kind == 0:
                        words[spot] = rng.randrange(1, self.base)
                    elif kind == 1:
                        words.insert(spot, rng.randrange(1, self.base))
                    elif len(words) > 1:
                        del words[spot]
                edited.append(np.array(words, np.int64))
                origin.append(at)
        sizes = self.sizes[origin]
        same = self.keys(edited, sizes, MOST_TABLES) == self.keys([self.items[a] for a in origin], sizes, MOST_TABLES)
        reached = np.logical_or.accumulate(same, axis=1).mean(axis=0)
        enough = np.flatnonzero(reached >= recall)
        if not len(enough):
            warnings.warn(f"{MOST_TABLES} tables find {reached[-1]:.3f} of the edited items, not {recall}", stacklevel=2)
        return int(enough[0]) + 1 if len(enough) else MOST_TABLES

    def windows(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item size, start) of the windows that share a run of words with an item, where the text has room for it: a place within
        the limit starts at most `edits` words off and lacks at most `edits` words."""
        found = set()
        for k, wanted in self.run_codes.items():
            codes = self.codes(words, k)
            place = np.searchsorted(wanted, codes)
            place[place == len(wanted)] = 0
            for p in np.flatnonzero(wanted[place] == codes).tolist() if len(wanted) else ():
                for at, offset in self.runs[k][int(codes[p])]:
                    size, edits, start = int(self.sizes[at]), int(self.edits[at]), p - offset
                    if start >= -edits and len(words) - max(start - edits, 0) >= size - edits:
                        found.add((size, start))
        return sorted(found)

    def find(self, texts: list[str]) -> list[tuple[list[dict]]]:
        number = self.number.get
        docs = [np.array([number(w, 0) for w in words_of(t.lower())], np.int64) for t in texts]
        opened = [(d, size, start) for d, words in enumerate(docs) for size, start in self.windows(words)]
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for at in range(0, len(opened), 8192):
            self.verify(docs, opened[at:at + 8192], best)
        return [([{"item_id": self.ids[i], "start": s, "distance": d, "size": int(self.sizes[i])} for i, (d, s) in sorted(b.items())],) for b in best]

    def verify(self, docs: list[np.ndarray], opened: list[tuple[int, int, int]], best: list[dict[int, tuple[int, int]]]) -> None:
        sizes = np.array([size for _, size, _ in opened], np.int64)
        rows = [docs[d][max(start, 0):max(start, 0) + int(size * REACH) + 1] for d, size, start in opened]
        keys = self.keys(rows, sizes, self.tables)
        place = np.searchsorted(self.filed_keys, keys)
        place[place == len(self.filed_keys)] = 0
        w, t = np.nonzero(self.filed_keys[place] == keys)
        for row, at in sorted({(r, i) for r, key in zip(w.tolist(), keys[w, t].tolist()) for i in self.filed[key]}):
            d, size, start = opened[row]
            edits = int(self.edits[at])
            low = max(start - edits, 0)
            if best[d].get(at, (1, 0))[0] == 0:
                continue  # an exact copy is known
            distance, end = edit_distance(self.items[at], docs[d][low:max(start, 0) + size + edits])
            if distance <= edits:
                entry = (distance, max(low + end - size, 0))
                best[d][at] = min(best[d].get(at, entry), entry)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", similarity: float = 0.8,
               recall: float = 0.99, block: int = 20_000) -> DataFrame:
    """`keep` and `hits`: for each row the items it contains within `(1 - similarity) * words` word edits, with the place
    (word number), the least distance and the item's size.

    `benchmark (item_id, text)` is the query set: it goes to the tasks, indexed in blocks of `block` items, and one narrow
    scan of the documents meets every block, without a shuffle: no list of windows or pairs is ever written. Words are
    letters and digits, lower-cased. Items without words match nothing; equal items are each reported. Null and empty texts
    have no hits. Repeated rows get equal hits. Other columns are not read. An empty table gives no rows."""
    items = [(r[0], r[1]) for r in benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").collect()]

    def make():
        finders = [Finder(items[at:at + block], similarity, recall) for at in range(0, len(items), block)]
        return lambda texts: [(sum((hits[0] for hits in row), []),) for row in zip(*[f.find(texts) for f in finders])] \
            if finders else [([],) for _ in texts]

    return map_slices(docs, keep, text, HITS, make, ROWS)
