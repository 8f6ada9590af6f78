"""Spelling variants: words one edit apart, through k-d trees over their letter counts.

One edit moves a word's vector of letter counts by at most two in L1: a replaced letter takes one count off and adds another,
an inserted one adds one. So a word looks for partners of its own length at distance two and of the next length at distance one,
and finds every pair once: from the shorter word, or from the one whose surplus letter comes first.

1. Words are counted over the whole table (a grouped count).
2. A k-d tree for each length cuts the words into cells. Where to cut is learnt from a bounded sample; cells that turn out too
   large when all words are counted are cut again. Cuts decide where words meet, never whether.
3. A word goes to its own cell, and to every cell whose box its edits can reach: crossing a cut upwards takes the added letter,
   downwards the removed one, and each is there once. That bounds the copies of a word by the depth of the tree.
4. Inside a cell a finer tree of the same kind narrows the search to a few words, whose letters are compared in order.
5. Each word's count of near words and best near word are reduced in the cell, then by a grouped aggregate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize

# The letters of a word, after A-Z are lower-cased.
NOT_LETTERS = "[^a-zÀ-ÿ]+"
FIRST, ACCENTED, DIMENSIONS = ord("a"), 0xC0, 26 + 64
ERRORS = 97  # every 97th (document, word) loses a letter
CELL = 4096  # words of a cell that are kept together
LEAF = 16  # words compared one by one
SAMPLE = 100_000  # words that the cuts are learnt from in a round
PAIRS = 1 << 20  # candidates compared at once
SAME, LONGER = 0, 1  # what a word looks for: its own length, the next one

# Random weights make the weighted sum of a vector tell by one difference whether two vectors are one edit apart.
_WEIGHTS = np.random.default_rng(13).integers(1 << 62, size=DIMENSIONS, dtype=np.int64)
_MOVES = [np.sort((_WEIGHTS[None, :] - _WEIGHTS[:, None])[np.triu_indices(DIMENSIONS, 1)]), np.sort(_WEIGHTS)]


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(words: list[str]) -> np.ndarray:
    codes, sizes = letters(words)
    at = np.where(codes < ACCENTED, codes - FIRST, codes - ACCENTED + 26)
    flat = np.bincount(np.repeat(np.arange(len(words)), sizes) * DIMENSIONS + at, minlength=len(words) * DIMENSIONS)
    return flat.reshape(-1, DIMENSIONS).astype(np.int32)


@dataclass
class Tree:
    """A k-d tree: node i sends vectors with `cut[i]` or less at `dim[i]` to `low[i]`, others to `high[i]`; -1 marks a leaf."""

    dim: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    low: list[int] = field(default_factory=lambda: [0])
    high: list[int] = field(default_factory=lambda: [0])

    def grow(self, leaf: int, vectors: np.ndarray, most: float) -> dict[int, np.ndarray]:
        """Cut a leaf until its parts hold `most` vectors at most or are all alike; rows of `vectors` by leaf."""
        parts, open_parts = {}, [(leaf, np.arange(len(vectors)))]
        while open_parts:
            node, rows = open_parts.pop()
            mine = vectors[rows]
            spread = mine.var(axis=0) if len(rows) > max(most, 1) else np.zeros(1)
            if not spread.max() > 0:
                parts[node] = rows
                continue
            d = int(spread.argmax())
            values, counts = np.unique(mine[:, d], return_counts=True)
            cut = int(values[np.abs(np.cumsum(counts)[:-1] - len(rows) / 2).argmin()])
            self.dim[node], self.cut[node] = d, cut
            self.low[node], self.high[node] = len(self.dim), len(self.dim) + 1
            for side in (mine[:, d] <= cut, mine[:, d] > cut):
                open_parts.append((len(self.dim), rows[side]))
                for column, value in ((self.dim, -1), (self.cut, 0), (self.low, 0), (self.high, 0)):
                    column.append(value)
        return parts

    def reach(self, vectors: np.ndarray, seek: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf whose box holds a vector that the row's edits can make.

        An added letter may carry a row over one cut upwards, a removed one (only where `seek` is SAME, and coming before the
        added one) over one cut downwards; after that its count at the cut's letter is known."""
        dim, cut, low, high = (np.array(c) for c in (self.dim, self.cut, self.low, self.high))
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        added, removed = np.full(len(row), -1), np.full(len(row), -1)
        rows, leaves = [], []
        while len(row):
            ended = dim[node] < 0
            rows.append(row[ended])
            leaves.append(node[ended])
            row, node, added, removed = (c[~ended] for c in (row, node, added, removed))
            d, at = dim[node], cut[node]
            value = vectors[row, d] + (added == d) - (removed == d)
            over = value > at
            up = (value == at) & (added < 0) & (removed < d)
            down = (value == at + 1) & (removed < 0) & ((added < 0) | (added > d)) if seek == SAME else np.zeros(len(row), bool)
            own = np.where(over, high[node], low[node])
            node, row = np.concatenate([own, high[node][up], low[node][down]]), np.concatenate([row, row[up], row[down]])
            added, removed = np.concatenate([added, d[up], added[down]]), np.concatenate([removed, removed[up], d[down]])
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (row, node)

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        dim, cut, low, high = (np.array(c) for c in (self.dim, self.cut, self.low, self.high))
        node, rows = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
        while len(rows := rows[dim[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = np.where(vectors[rows, dim[at]] > cut[at], high[at], low[at])
        return node


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3) -> DataFrame:
    """`(word, n)`: words of at least `shortest` letters seen at least `least` times in the whole table. A-Z are lower-cased; where
    the checksum of `<key>:<word>` is a multiple of `ERRORS`, the word loses the letter the checksum points at."""
    runs = F.explode(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), NOT_LETTERS)).alias("run")
    size, check = F.length("run"), F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("check") % F.col("size")).cast("int")
    lossy = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("size")))
    seen = docs.select(F.col(key), runs).where(size >= shortest).select("run", size.alias("size"), check.alias("check"))
    words = seen.select(F.when(F.col("check") % ERRORS == 0, lossy).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= shortest) & (F.col("n") >= least))


def fit_trees(words: DataFrame, cell: int, sample: int) -> dict[int, Tree]:
    """A tree for each length that has more than `cell` words. What reaches the driver: `sample` words a round and one row for
    each cell that is too large."""
    trees: dict[int, Tree] = {}
    size = F.length("word").cast("long")
    while True:
        placed = words.select("word", size.alias("size"), F.lit(0).cast("long").alias("leaf")) if not trees else _placed(words, trees)
        large = {(r["size"], r["leaf"]): r["n"] for r in placed.groupBy("size", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * cell).collect()}
        if not large:
            return trees
        total = sum(large.values())
        share = min(1.0, sample / total)
        found: dict[tuple[int, int], list[str]] = {key: [] for key in large}
        keys = words.sparkSession.createDataFrame(list(large), "size long, leaf long")
        for r in placed.join(F.broadcast(keys), ["size", "leaf"]).where(F.pmod(F.xxhash64("word", F.lit(len(trees))), 1 << 20) < int(share * (1 << 20)) + 1).collect():
            found[r["size"], r["leaf"]].append(r["word"])
        before = sum(len(t.dim) for t in trees.values())
        for (length, leaf), mine in found.items():
            if len(mine) > 1:
                trees.setdefault(length, Tree()).grow(leaf, letter_counts(mine), cell * share)
        if sum(len(t.dim) for t in trees.values()) == before:  # what is left is all alike
            return trees


def _placed(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_pylist()
            sizes = np.fromiter(map(len, mine), np.int64, len(mine))
            leaf = np.zeros(len(mine), np.int64)
            for length in np.unique(sizes):
                if (tree := trees.get(int(length))) is not None:
                    rows = np.flatnonzero(sizes == length)
                    leaf[rows] = tree.own(letter_counts([mine[i] for i in rows]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(leaf)], ["word", "size", "leaf"])

    return words.select("word").mapInArrow(run, "word string, size long, leaf long")


def placed_rows(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """`(size, leaf, kind, word, n)`: kind 0 for a word in its own cell, 1 where it only looks for words of its length, 2 where it
    looks for longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Tree()
        for batch in batches:
            mine = batch.column(0).to_pylist()
            sizes = np.fromiter(map(len, mine), np.int64, len(mine))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for length in np.unique(sizes):
                rows = np.flatnonzero(sizes == length)
                vectors = letter_counts([mine[i] for i in rows])
                for seek in (SAME, LONGER):
                    tree = trees.get(int(length) + seek, whole)
                    row, leaf = tree.reach(vectors, seek)
                    kind = np.full(len(row), 2) if seek else (tree.own(vectors)[row] != leaf).astype(np.int64)
                    out.append((np.full(len(row), length + seek), leaf, kind, rows[row]))
            size, leaf, kind, rows = (np.concatenate([o[i] for o in out]) for i in range(4))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(leaf), pa.array(kind), batch.column(0).take(take), batch.column(1).take(take)],
                                             ["size", "leaf", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "size long, leaf long, kind long, word string, n long")


class Cell:
    """The words of one cell under a fine tree, and what looks for them."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.n = words, counts
        vectors = letter_counts(words)
        self.size = len(words[0])
        self.codes = letters(words)[0].reshape(-1, self.size)
        self.sums = vectors @ _WEIGHTS
        self.tree = Tree()
        parts = self.tree.grow(0, vectors, LEAF)
        self.start, self.held = np.zeros(len(self.tree.dim) + 1, np.int64), np.concatenate([parts.get(i, np.zeros(0, np.int64)) for i in range(len(self.tree.dim))])
        self.start[1:] = np.cumsum([len(parts.get(i, ())) for i in range(len(self.tree.dim))])

    def near(self, words: list[str], seek: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): `words[i]` and the cell's word j are one edit apart."""
        vectors, codes = letter_counts(words), letters(words)[0].reshape(len(words), -1)
        sums = vectors @ _WEIGHTS
        row, leaf = self.tree.reach(vectors, seek)
        sizes = self.start[leaf + 1] - self.start[leaf]
        done, found = np.concatenate([[0], np.cumsum(sizes)]), []
        for low in range(0, int(done[-1]), PAIRS):  # candidates low .. low + PAIRS, numbered over all visited leaves
            number = np.arange(low, min(low + PAIRS, int(done[-1])))
            visit = np.searchsorted(done, number, "right") - 1
            i, j = row[visit], self.held[self.start[leaf[visit]] + number - done[visit]]
            move = self.sums[j] - sums[i]
            at = np.minimum(np.searchsorted(_MOVES[seek], move), len(_MOVES[seek]) - 1)
            i, j = i[_MOVES[seek][at] == move], j[_MOVES[seek][at] == move]
            step = max(1, (1 << 24) // self.size)
            for part in range(0, len(i), step):
                x, y = i[part:part + step], j[part:part + step]
                fits = one_edit(codes[x], self.codes[y])
                found.append((x[fits], y[fits]))
        return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, np.int64),) * 2


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of `a` become those of `b` by one replaced letter, or one inserted where `b` is a letter longer."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    ahead, behind = a != b[:, :size], a != b[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), size)
    last = np.where(behind.any(axis=1), size - 1 - behind[:, ::-1].argmax(axis=1), -1)
    return last < first


def _reduced(words: list[str], n: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> tuple[list[str], list[int], list[int], list[str]]:
    """Per word of `mine`: how many partners, and the best one's count and spelling; both arrays number `words`."""
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    best, total = np.full(len(words), len(words)), np.bincount(mine, minlength=len(words))
    np.minimum.at(best, mine, rank[theirs])
    rows = np.flatnonzero(total)
    top = [order[i] for i in best[rows]]
    return [words[i] for i in rows], total[rows].tolist(), [int(n[i]) for i in top], [words[i] for i in top]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, leaf, kind, word, n) in this order, to partial results (word, n_near, near_n, near)."""
    here, held, cell = None, [], None

    def out(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_reduced(words, n, np.concatenate([i, j]), np.concatenate([j, i])), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                             ["word", "n_near", "near_n", "near"])

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal cell
        words, n = [w for some, _ in held for w in some], np.concatenate([c for _, c in held])
        cell = Cell(words, n)
        for at in range(0, len(words), 2048):
            i, j = cell.near(words[at:at + 2048], SAME)
            yield from out(words, n, i + at, j)

    for batch in batches:
        size, leaf, kind, n = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
        cuts = np.flatnonzero((np.diff(size) != 0) | (np.diff(leaf) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
            if b == a:
                continue
            if here != (size[a], leaf[a]):
                if held and cell is None:
                    yield from close()
                here, held, cell = (size[a], leaf[a]), [], None
            words = batch.column(3).slice(a, b - a).to_pylist()
            if kind[a] == 0:
                held.append((words, n[a:b]))
                continue
            if not held:
                continue  # nobody lives in the cell
            if cell is None:
                yield from close()
            for at in range(0, len(words), 2048):
                some = words[at:at + 2048]
                i, j = cell.near(some, SAME if kind[a] == 1 else LONGER)
                yield from out(cell.words + some, np.concatenate([cell.n, n[a + at:a + at + len(some)]]), i + len(cell.words), j)
    if held and cell is None:
        yield from close()


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """`(word, n_near, near_n, near)` of the words of `words (word, n)` that have a near word: how many, and of those with the
    largest count the one first in code-point order."""
    trees = fit_trees(words, cell, sample)
    parts = max(1, -(-words.count() // cell))
    rows = placed_rows(words, trees).repartition(parts, "size", "leaf").sortWithinPartitions("size", "leaf", "kind")
    part = rows.mapInArrow(_meet, "word string, n_near long, near_n long, near string")
    best = part.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def rooted_words(forms: DataFrame) -> DataFrame:
    """`(word, form, ..., root)`: words without a form first, then round by round those whose form has its root. A form has a bounded number of near
    words and counts at least double from one to the next, so no key is hot and there are few rounds."""
    done = forms.where("form is null").withColumn("root", F.col("word"))
    left, fresh = materialize(forms.where("form is not null"), "forms"), done
    while not left.isEmpty():
        known = fresh.select(F.col("word").alias("form"), "root")
        both = materialize(left.join(known, "form", "left").select(*forms.columns, "root"), "roots")
        fresh, left = both.where("root is not null"), both.where("root is null").drop("root")
        done = done.unionByName(fresh)
    return done


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, ratio: int = 2,
                      cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)`, one row for each word of at least `shortest` letters seen at least `least` times.

    Words one inserted, deleted or replaced letter apart are near. A word's form is its most frequent near word (ties: first in
    code-point order) if that is at least `ratio` times as frequent, otherwise null; its root is where the forms end.
    Null and empty texts have no words; a null key counts as an empty one in the checksum; repeated rows count each time; other
    columns are not read; words of any length take part; an empty table gives no rows."""
    words = materialize(word_counts(docs, key, text, shortest, least), "words")
    near = words.join(near_words(words, cell, sample), "word", "left")
    good = F.col("near_n") >= ratio * F.col("n")
    forms = materialize(near.select("word", F.when(good, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                    F.when(good, F.col("near_n")).alias("form_n")), "near")
    return rooted_words(forms).select("word", "form", "root", "n", "n_near", "form_n")
