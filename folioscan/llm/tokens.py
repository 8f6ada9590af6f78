"""Token counts by a two-tier lookup on the map side.

A SentencePiece BPE model merges neighbouring symbols, and no merge can cross a place that no piece spans. So a text is cut
into pre-tokens at such places, and its count is the sum over them. Frequent pre-tokens are looked up in a compact table that
every task receives; the others are encoded once and kept in a cache of the worker. No pre-token is ever shuffled for the
counts: one narrow pass over the texts.

The table is filled from a bounded sample of rows. It decides how often the model is asked, never what the count is."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

BLANK = "▁"  # how the model writes a space
LONGEST = 24  # characters of a pre-token that the table or a cache may hold
CACHED = 1 << 19  # pre-tokens that a worker keeps besides the table
ROWS = 64  # texts counted at once

_workers: dict[int, "Lengths"] = {}


class Splitter:
    """Where texts may be cut, read off the pieces of the model.

    A run of blanks starts a pre-token, and marks part from other characters: ASCII characters besides letters and digits
    that no piece holds next to one. A model whose pieces go on after a blank inside is refused."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        special = (model.is_control, model.is_byte, model.is_unknown)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(test(i) for test in special)]
        if any(BLANK in p.lstrip(BLANK) for p in pieces) or model.encode(" a", out_type=str)[0][:2] == BLANK + "a":
            raise ValueError("only models whose pieces hold blanks at their start, and that keep every blank, can be cut")
        beside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        marks = {c for c in map(chr, range(128)) if not c.isalnum() and c != " "}
        while bad := {x for pair in beside for x, y in (pair, pair[::-1]) if x in marks and y not in marks and y != BLANK}:
            marks -= bad
        if "\n" not in marks or any("\n" in pair for pair in beside):
            raise ValueError("the model has pieces that hold line ends")
        kind = re.escape("".join(sorted(marks)))
        self.find = re.compile(f"{BLANK}*[^{BLANK}{kind}]+|{BLANK}*[{kind}]+|{BLANK}+").findall

    def __call__(self, text: str) -> list[str]:
        """Pre-tokens of the text as the model reads it: blanks as `BLANK`, and one before the text."""
        return self.find(BLANK + text.replace(" ", BLANK)) if text else []


class Lengths:
    """Token counts of texts. `known` starts as the table and takes in what the model was asked; when that passes `CACHED`
    pre-tokens, the cache starts again from the table and the latest texts."""

    def __init__(self, model: bytes, words: list[str], sizes: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = Splitter(self.model)
        self.table = dict(zip(words, sizes))
        self.known = dict(self.table)
        self.edge = len(self.model.encode("\n"))

    def encode(self, words: list[str]) -> list[int]:
        """The model puts a blank before what it is given: it takes the place of a leading blank, and otherwise a line end,
        which merges with nothing, keeps it apart."""
        given = [w[1:] or BLANK for w in words if w[0] == BLANK] + ["\n" + w for w in words if w[0] != BLANK]
        sizes = iter(self.model.encode(given, num_threads=1))
        first = {w: len(next(sizes)) if len(w) > 1 else (next(sizes), 1)[1] for w in words if w[0] == BLANK}
        rest = {w: len(next(sizes)) - self.edge for w in words if w[0] != BLANK}
        return [first[w] if w[0] == BLANK else rest[w] for w in words]

    def of(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        missing = list(set().union(*split).difference(self.known))
        if len(self.known) - len(self.table) + len(missing) > CACHED:
            self.known = dict(self.table)
            missing = list(set().union(*split).difference(self.known))
        self.known.update(zip(missing, self.encode(missing)))
        counts = [sum(map(self.known.__getitem__, words)) for words in split]
        for w in missing:
            if len(w) > LONGEST:
                del self.known[w]
        return counts


def frequent(docs: DataFrame, text: str, model: bytes, sample_rows: int, table_words: int) -> list[str]:
    """The most frequent short pre-tokens of about `sample_rows` rows drawn from the whole table; at most `table_words`."""
    total = docs.count()
    if not total:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Splitter(sentencepiece.SentencePieceProcessor(model_proto=model)), Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(w for w in split(value.as_py() or "") if len(w) <= LONGEST)
            if len(seen) > 4 * table_words:
                seen = Counter(dict(seen.most_common(table_words)))
        best = seen.most_common(table_words)
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    drawn = docs.select(text).sample(min(1.0, sample_rows / total), seed=12)
    found = drawn.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in found.where("n > 1").orderBy(F.desc("n"), "word").limit(table_words).collect()]


def count_tokens(docs: DataFrame, keep: list[str], model_path: str, text: str = "text", limit: int = 4096,
                 sample_rows: int = 10_000, table_words: int = 1 << 16) -> DataFrame:
    """`keep`, then `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more tokens than `limit`) of every row of `docs`.

    Counts are those of the SentencePiece BPE model at `model_path` (read by the driver) for the whole text, without begin or
    end tokens; strings like `<s>` are ordinary text. Null and empty texts have no tokens. Repeated rows each keep their row,
    null keys are kept, other columns are not read, an empty table gives no rows. The table holds at most `table_words`
    pre-tokens of `LONGEST` characters, a few megabytes; it is taken from about `sample_rows` rows and only saves work."""
    with open(model_path, "rb") as file:
        model = file.read()
    words = frequent(docs, text, model, sample_rows, table_words)
    sizes = bytes(Lengths(model, [], b"").encode(words))
    held = docs.sparkSession.sparkContext.broadcast((model, words, sizes))

    def make():
        key = hash(held.value[:1] + held.value[2:]) ^ hash(tuple(held.value[1]))
        if key not in _workers:
            _workers.clear()  # one table and one cache a worker
            _workers[key] = Lengths(*held.value)
        lengths = _workers[key]

        def work(texts: list[str]) -> list[tuple]:
            counts = lengths.of(texts)
            return [(len(t.encode()), n, n > limit) for t, n in zip(texts, counts)]

        return work

    return map_slices(docs, keep, text, "n_bytes long, n_tokens long, over_limit boolean", make, ROWS)
