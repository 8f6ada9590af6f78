"""A stored inverted index over the chunk table: trigrams for phrases, terms with block maxima for TF-IDF.

Chunks are numbered inside blocks. A posting row is one gram or term in one block: chunk numbers as differences, for terms with
counts, a byte each where they are small. A task cuts the chunks it reads into blocks and packs these as it reads them back, so neither
texts nor postings are shuffled to build an index, and it takes about as much disk as the text. Where a phrase stands is not
stored: its grams name the chunks, whose texts are then read. Posting rows lie in hash buckets of their gram, and a query reads only the
buckets it asks for. Queries stay a table: they are cut into bounded groups that meet the blocks by equal joins, nothing of them passes
through the driver.

An index is a folder of segments, each written by one change. `versions` names the live segment of every page and is written last, so a
change counts once it is whole; a segment that was not finished is written over by the next change. What dead pages contributed to
term counts is kept beside the segment that replaced them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BOOST_MARKERS, contains_any, strip, tokenize
from ..session import materialize
from .search import BM25_B, BM25_K1, IDF_FLOOR, MARKER_BOOST, PLACES, QUERY_BLOCK, TITLE_BOOST, best, occurrences, query_tokens, rounded, searchable
from .sequences import top_rows

BLOCK = 512  # chunks of a block, at most
HELD = 32  # unfinished blocks that a task holds
BUCKETS = 16
CODEC = "zstd"
OPENING = 2  # blocks of a query that are scored first, to learn what the others must reach

GRAM_ROWS = "block long, gram string, n int, chunks binary"
TERM_ROWS = "block long, term string, n int, most double, chunks binary, counts binary"

DOC_ROWS = "block long, at int, chunk_id string, rel_path string, title string, text string, cluster string, marked boolean, phrased boolean, dl long"

SHAPES = {"grams": GRAM_ROWS, "terms": TERM_ROWS}

_machines: dict[int, tuple] = {}


@dataclass(frozen=True)
class Index:
    """The stored tables of one index; made by `build`, changed by `upsert` and `remove`."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        read = self.spark.read
        if name in SHAPES:  # declared: no file is opened to learn it
            read = read.schema(f"{SHAPES[name]}, seg int, bucket int")
        return read.parquet(f"{self.path}/{name}")

    def docs(self) -> DataFrame:
        """Live chunks: those of finished segments whose page was not written again later. Of a single segment all are live, so no text is
        joined to find out."""
        held = self.segments()
        docs = self.table("docs").where(F.col("seg").isin(held))
        if len(held) == 1:
            return docs
        newest = F.max("seg").over(W.partitionBy("rel_path"))
        dead = self.table("versions").select("rel_path", "seg", newest.alias("newest")).where("seg < newest").select("rel_path", F.col("seg").cast("int").alias("seg"))
        return docs.join(dead, ["rel_path", "seg"], "left_anti")

    def chunks(self) -> DataFrame:
        """The chunk table as it was given, live pages only."""
        return self.docs().select("chunk_id", "rel_path", "title", "text")

    def segments(self) -> list[int]:
        """Finished segments; the first is there even if it holds no page."""
        return sorted({0} | {r["seg"] for r in self.table("versions").select("seg").distinct().collect()})

    def rows(self, kind: str, wanted: DataFrame, key: str) -> DataFrame:
        """Posting rows of the `wanted` grams or terms from finished segments, reading no bucket but theirs."""
        held = self.table(kind).where(F.col("seg").isin(self.segments()))
        asked = wanted.select(bucket_of(F.col(key), self.buckets()).alias("bucket"), "*")
        numbers = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most as many as there are buckets
        return held.where(F.col("bucket").isin(numbers)).join(asked, ["bucket", key])

    def buckets(self) -> int:
        return self.table("facts").first()["buckets"]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in seven bits a byte, the upper bit set where more follow; and how many bytes each takes."""
    values = values.astype(np.int64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= 1 << bits
    out, start = np.zeros(int(sizes.sum()), np.uint8), np.cumsum(sizes) - sizes
    for i in range(int(sizes.max(initial=0))):
        some = sizes > i
        out[start[some] + i] = values[some] >> 7 * i & 127 | (sizes[some] > i + 1) << 7
    return out, sizes


def decoded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.int64)
    first = np.append(0, np.flatnonzero(raw[:-1] < 128) + 1)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first)


def _packed(order_key: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal `order_key` (sorted) packed: keys, starts, sizes, and each of `numbers` as an array of binaries."""
    keys, start, sizes = np.unique(order_key, return_index=True, return_counts=True)

    def pack(values: np.ndarray) -> pa.Array:
        data, width = coded(values)
        ends = np.append(0, np.cumsum(width))
        return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends[np.append(start, len(values))].astype("<i4")), pa.py_buffer(data)])

    return keys, start, sizes, *map(pack, numbers)


def _steps(order_key: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Chunk numbers as differences to the one before under the same key; the first as it is."""
    steps = np.diff(chunk, prepend=0)
    fresh = np.flatnonzero(np.diff(order_key, prepend=order_key[:1] - 1))
    steps[fresh] = chunk[fresh]
    return steps


def _gram_rows(block: int, at: list[int], contents: list[str]) -> pa.RecordBatch:
    """Trigrams of the lower-cased contents of one block's chunks, with the chunks that hold them."""
    codes = np.frombuffer("".join(contents).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(contents)), np.fromiter(map(len, contents), np.int64, len(contents)))
    whole = np.flatnonzero(owner[:-2] == owner[2:]) if len(codes) > 2 else np.zeros(0, np.int64)
    gram = codes[whole] | codes[whole + 1] << 21 | codes[whole + 2] << 42
    letters, name = np.unique(gram, return_inverse=True)
    width = max(at) + 1
    pairs = np.unique(name * width + np.array(at, np.int64)[owner[whole]])
    names, _, n, chunks = _packed(pairs // width, _steps(pairs // width, pairs % width))
    spelt = np.stack([letters >> s & 0x1FFFFF for s in (0, 21, 42)], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block)), pa.array([spelt[i:i + 3] for i in range(0, len(spelt), 3)], pa.string()), pa.array(n.astype(np.int32)), chunks],
                                      ["block", "gram", "n", "chunks"])


def _term_rows(block: int, at: list[int], tokens: pa.Array) -> pa.RecordBatch:
    """Terms of one block's chunks with their counts; `most` is the largest weight a chunk gives the term."""
    words = pa.compute.dictionary_encode(tokens.flatten())
    owner = np.repeat(np.array(at, np.int64), np.asarray(tokens.value_lengths().fill_null(0)))
    width = int(owner.max(initial=0)) + 1
    pairs, counts = np.unique(np.asarray(words.indices).astype(np.int64) * width + owner, return_counts=True)
    keys, start, n, chunks, packed = _packed(pairs // width, _steps(pairs // width, pairs % width), counts)
    most = 1 + np.log1p(np.maximum.reduceat(counts, start)) if len(start) else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), words.dictionary.take(pa.array(keys)), pa.array(n.astype(np.int32)), pa.array(most, pa.float64()), chunks, packed],
                                      ["block", "term", "n", "most", "chunks", "counts"])


def _in_blocks(batches: Iterator[pa.RecordBatch], seg: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows `(cluster, ...)` as rows `(block, at, ...)`: a block is full with `size` chunks of one cluster. A task holds `HELD` unfinished blocks' worth
    of rows; beyond, the largest is closed."""
    held: dict[str, list[pa.RecordBatch]] = {}
    counts: dict[str, int] = {}
    made = itertools.count(seg << 44 | TaskContext.get().partitionId() << 24)

    def closed(cluster: str) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held.pop(cluster)).combine_chunks().to_batches()[0]
        n = counts.pop(cluster)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, next(made))), pa.array(np.arange(n, dtype=np.int32)), *rows.columns], ["block", "at", *rows.schema.names])

    for batch in batches:
        names = pa.compute.dictionary_encode(batch.column("cluster"))
        codes = np.asarray(names.indices)
        for code, cluster in enumerate(names.dictionary.to_pylist()):
            mine = batch if len(names.dictionary) == 1 else batch.take(pa.array(np.flatnonzero(codes == code)))
            while mine.num_rows:
                room = size - counts.get(cluster, 0)
                held.setdefault(cluster, []).append(mine.slice(0, room))
                counts[cluster] = counts.get(cluster, 0) + min(room, mine.num_rows)
                mine = mine.slice(room)
                if counts[cluster] == size:
                    yield closed(cluster)
            if sum(counts.values()) > HELD * size:
                yield closed(max(counts, key=counts.get))
    for cluster in sorted(held):
        yield closed(cluster)


def _by_block(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their first column, `make(block, rows)` once for each block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != blocks[a]:
                yield make(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield make(pa.Table.from_batches(held))


def _write_segment(index: Index, seg: int, chunks: DataFrame, buckets: int) -> None:
    """Docs, grams and terms of `chunks` as segment `seg`; written over if an earlier try left it unfinished.

    A block takes chunks of one cluster from one task."""
    if "cluster" not in chunks.columns:
        chunks = chunks.withColumn("cluster", F.lit(""))
    title = F.coalesce("title", F.lit(""))
    content = F.when(title != "", F.concat(title, F.lit("\n"), "text")).otherwise(F.col("text"))
    dl = F.greatest(F.lit(0), F.length(title) - 2) + F.greatest(F.lit(0), F.length(content) - 2)
    rows = chunks.select("chunk_id", "rel_path", "title", "text", F.coalesce(F.col("cluster").cast("string"), F.lit("")).alias("cluster"), contains_any("text", BOOST_MARKERS).alias("marked"),
                         (strip("text") != "").alias("phrased"), dl.cast("long").alias("dl"))
    size = BLOCK
    docs = rows.mapInArrow(lambda b: _in_blocks(b, seg, size), DOC_ROWS)
    docs.write.mode("overwrite").option("compression", CODEC).parquet(f"{index.path}/docs/seg={seg}")
    # Rows of a block lie together; where a file is read in splits, a block may give two rows of one gram, of different chunks.
    stored = index.spark.read.schema(DOC_ROWS).parquet(f"{index.path}/docs/seg={seg}")
    grams = stored.where("phrased").select("block", "at", F.lower(content).alias("content")).mapInArrow(
        lambda b: _by_block(b, lambda t: _gram_rows(t["block"][0].as_py(), t["at"].to_pylist(), t["content"].to_pylist())), GRAM_ROWS)
    terms = stored.select("block", "at", tokenize("text").alias("tokens")).mapInArrow(
        lambda b: _by_block(b, lambda t: _term_rows(t["block"][0].as_py(), t["at"].to_pylist(), t["tokens"].combine_chunks())), TERM_ROWS)
    for rows, key, kind in ((grams, "gram", "grams"), (terms, "term", "terms")):
        placed = rows.withColumn("bucket", bucket_of(F.col(key), buckets)).sortWithinPartitions("bucket", key, "block")
        placed.write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(f"{index.path}/{kind}/seg={seg}")


def build(spark: SparkSession, path: str, chunks: DataFrame, buckets: int = BUCKETS) -> Index:
    """A new index of `chunks (chunk_id, rel_path, title, text)`. With a column `cluster`, chunks of one value (a language, a subject) share
    blocks, which lets more blocks be skipped. `buckets` should grow with the corpus: a bucket is what a query reads at least."""
    index = Index(spark, path.rstrip("/"))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{index.path}/facts")
    _write_segment(index, 0, chunks, buckets)
    _gone(index, 0, chunks.select("rel_path").limit(0))
    pages = index.table("docs").where("seg = 0").select("rel_path").distinct()
    pages.select("rel_path", F.lit(0).cast("long").alias("seg"), F.lit(True).alias("kept")).write.parquet(f"{index.path}/versions")
    return index


def _gone(index: Index, seg: int, pages: DataFrame) -> None:
    """What live chunks of the `pages (rel_path)` that segment `seg` replaces had added to the term counts, from their own texts: no posting row is
    read, so a change costs what its pages hold."""
    if seg == 0:
        counts = pages.select(F.lit("").alias("term"), F.lit(0).cast("long").alias("n"))
    else:
        newest = index.table("versions").join(pages, "rel_path", "left_semi").groupBy("rel_path").agg(F.max("seg").cast("int").alias("seg"))
        dead = index.table("docs").select("rel_path", "seg", "text").join(newest, ["rel_path", "seg"], "left_semi")
        counts = dead.select(F.explode(F.array_distinct(tokenize("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").parquet(f"{index.path}/gone/seg={seg}")


def upsert(index: Index, fresh: DataFrame, changed: DataFrame) -> Index:
    """Replace all chunks of the `changed (rel_path)` pages by those in `fresh`; a page without any disappears. Only these pages are read or
    written. As in the index this mirrors, pages are replaced whole."""
    seg = index.segments()[-1] + 1
    pages = materialize(changed.select("rel_path").distinct(), "changed")
    new = fresh.join(pages, "rel_path", "left_semi").select("chunk_id", "rel_path", "title", "text", *(["cluster"] if "cluster" in fresh.columns else []))
    new = materialize(new, "fresh")
    _write_segment(index, seg, new, index.buckets())
    _gone(index, seg, pages)
    kept = new.select("rel_path").distinct().withColumn("kept", F.lit(True))
    rows = pages.join(kept, "rel_path", "left").select("rel_path", F.lit(seg).cast("long").alias("seg"), F.coalesce("kept", F.lit(False)).alias("kept"))
    rows.write.mode("append").parquet(f"{index.path}/versions")  # from here on the change counts
    return index


def remove(index: Index, paths: DataFrame) -> Index:
    return upsert(index, index.chunks().limit(0), paths)


def status(index: Index) -> DataFrame:
    """One row: live chunks, those the phrase index holds, segments, and pages."""
    return index.docs().agg(F.count("*").alias("chunks"), F.count_if("phrased").alias("phrase_rows"), F.count_distinct("rel_path").alias("pages"),
                            F.count_distinct("seg").alias("segments"))


def doc_frequency(index: Index) -> DataFrame:
    """`(term, df)`: in how many live chunks each term stands, from the posting rows' sizes alone."""
    held = index.segments()
    rows = index.table("terms").where(F.col("seg").isin(held)).groupBy("term").agg(F.sum("n").alias("n"))
    gone = index.table("gone").where(F.col("seg").isin(held)).groupBy("term").agg(F.sum("n").alias("gone"))
    return rows.join(gone, "term", "left").select("term", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("df")).where("df > 0")


# --- phrases ---

def _phrase_chunks(table: pa.Table) -> pa.Table:
    """Posting rows of one block and query group to (query_id, block, at): chunks that hold all grams of a query."""
    held: dict[str, list[np.ndarray]] = {}
    asked: dict[int, set[str]] = {}
    need: dict[int, int] = {}
    for gram, chunks, asks in zip(table["gram"].to_pylist(), table["chunks"].to_pylist(), table["asks"].to_pylist()):
        held.setdefault(gram, []).append(np.cumsum(decoded(chunks)))
        for a in asks:
            asked.setdefault(a["query_id"], set()).add(gram)
            need[a["query_id"]] = a["need"]
    there = np.zeros((len(held), 1 + max(int(c[-1]) for parts in held.values() for c in parts)), bool)
    place = {gram: i for i, gram in enumerate(held)}
    for gram, parts in held.items():
        for c in parts:
            there[place[gram], c] = True
    out = [(q, np.flatnonzero(there[[place[g] for g in grams]].all(axis=0))) for q, grams in asked.items() if len(grams) == need[q]]
    number, at = [np.full(len(c), q, np.int64) for q, c in out], [c for _, c in out]
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    return pa.table({"query_id": pa.array(np.concatenate(number) if number else at, pa.int64()), "block": pa.array(np.full(len(at), table["block"][0].as_py()), pa.int64()),
                     "at": pa.array(at.astype(np.int32), pa.int32())})


def phrase_scores(index: Index, queries: DataFrame, limit: int = 20, allowed: DataFrame | None = None, phrase: str = "phrase") -> DataFrame:
    """`(query_id, chunk_id, score)`: BM25 of each query as one literal phrase, as `search.bm25_phrase`, from the stored index alone.

    A phrase can stand only where all of its trigrams do; of these chunks alone the texts are read, and it is counted in them. 3 x `limit` rows
    are ranked before the `allowed` ones are chosen."""
    asked = materialize(queries.select("query_id", F.lower(strip(phrase)).alias("q")).where(F.length("q") >= 3), "asked")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - 2), lambda i: F.substring("q", i, F.lit(3))))
    cover = asked.select("query_id", grams.alias("grams")).select("query_id", F.size("grams").alias("need"), F.explode("grams").alias("gram"))
    groups = max(1, -(-queries.count() // QUERY_BLOCK))
    asks = cover.groupBy("gram", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("query_id", "need")).alias("asks"))
    met = index.rows("grams", asks, "gram").select("block", "group", "gram", "chunks", "asks")
    found = met.groupBy("block", "group").applyInArrow(_phrase_chunks, "query_id long, block long, at int").join(asked, "query_id")
    named = materialize(found.groupBy("block", "at").agg(F.collect_list(F.struct("query_id", "q")).alias("asks")), "named")
    docs = index.docs()
    texts = searchable(docs.where("phrased"), ["block", "at", "dl"]).join(named, ["block", "at"]).select("chunk_id", "dl", "title", "content", F.explode("asks").alias("a"))
    texts = texts.where(F.col("content").contains(F.col("a.q"))).select(
        "a.query_id", "chunk_id", "dl", (occurrences(F.col("title"), F.col("a.q")) + occurrences(F.col("content"), F.col("a.q"))).alias("f"))
    hits = materialize(texts, "hits")
    seen = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    facts = docs.where("phrased").agg(F.count("*").alias("total"), F.avg("dl").alias("mean")).first()
    total, mean = F.lit(facts["total"]), F.lit(facts["mean"])
    idf = F.log((total - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
    tf = F.col("f") * (BM25_K1 + 1) / (F.col("f") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / mean))
    scored = hits.join(seen, "query_id").select("query_id", "chunk_id", rounded(idf * tf).alias("score"))
    ranked = best(scored, 3 * max(limit, 1), "wide").drop("wide")
    if allowed is not None:
        ranked = ranked.join(allowed, [c for c in ("query_id", "chunk_id") if c in allowed.columns], "left_semi")
    return best(ranked, limit).drop("rank")


# --- terms ---

def _machine(queries: pa.ChunkedArray):
    """Query names in order, and an automaton of their words for titles; kept for the next block of this worker."""
    import ahocorasick

    listed = queries[0].as_py()
    key = hash(tuple((q["query_id"], *q["words"]) for q in listed))
    if key not in _machines:
        words: dict[str, list[int]] = {}
        for i, q in enumerate(listed):
            for w in q["words"]:
                words.setdefault(w, []).append(i)
        machine = ahocorasick.Automaton()
        for w, who in words.items():
            machine.add_word(w, who)
        if len(machine):
            machine.make_automaton()
        _machines.clear()
        _machines[key] = ({q["query_id"]: i for i, q in enumerate(listed)}, machine)
    return _machines[key]


def _term_scores(postings: pa.Table, frame: pa.Table, k: int) -> pa.Table:
    """One block and query group: scores of the block's chunks for the queries that may need it, each query's best `k` and ties."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
    if not postings.num_rows or not frame.num_rows:
        return empty
    place, machine = _machine(frame["queries"])
    wanted = np.array(sorted(place[q] for q in frame["allowed"][0].as_py()))
    row_of = np.full(len(place), -1)
    row_of[wanted] = np.arange(len(wanted))
    at = np.array(frame["at"][0].as_py())
    column = np.full(max(at) + 1, -1)
    column[at] = np.arange(len(at))
    weight, idf = np.zeros((postings.num_rows, len(at))), np.zeros((postings.num_rows, len(wanted)))
    for i, (chunks, counts, asks) in enumerate(zip(postings["chunks"].to_pylist(), postings["counts"].to_pylist(), postings["asks"].to_pylist())):
        chunk, tf = np.cumsum(decoded(chunks)), decoded(counts)
        here = column[chunk[chunk < len(column)]]  # dead chunks have no column
        weight[i, here[here >= 0]] = 1.0 + np.log1p(tf[:len(here)][here >= 0])
        for a in asks:
            if (row := row_of[place[a["query_id"]]]) >= 0:
                idf[i, row] = a["idf"]
    scores = idf.T @ weight
    titles, boosts = frame["titles"][0].as_py(), {}
    for j, title in enumerate(titles):
        if title not in boosts:
            rows = {row_of[q] for _, who in machine.iter(title) for q in who} if len(machine) else set()
            boosts[title] = np.array(sorted(rows - {-1}), np.int64)
        scores[boosts[title], j] *= TITLE_BOOST
    scores[:, np.array(frame["marked"][0].as_py(), bool)] *= MARKER_BOOST
    scores = np.round(scores, PLACES)
    floor = np.partition(scores, -k, axis=1)[:, [-k]] if scores.shape[1] > k else np.zeros((len(scores), 1))
    q, c = np.nonzero((scores >= floor) & (scores > 0))
    names, ids = np.array(list(place)), np.array(frame["ids"][0].as_py(), object)
    return pa.table({"query_id": pa.array(names[wanted[q]], pa.int64()), "chunk_id": pa.array(ids[c], pa.string()), "score": pa.array(scores[q, c], pa.float64())})


@dataclass
class Scoring:
    """The parts of one TF-IDF search: `bounds (query_id, block, bound, place)` of every block that holds a word of a query, and the scoring
    of chosen (query_id, block) pairs."""

    index: Index
    queries: DataFrame
    k: int

    def __post_init__(self):
        index, self.docs = self.index, materialize(self.index.docs().select("block", "at", "chunk_id", "title", "marked"), "live")
        asked = query_tokens(self.queries).withColumnRenamed("token", "term")
        wanted = materialize(asked.select("term").distinct(), "wanted")
        self.rows = index.rows("terms", wanted, "term")
        gone = index.table("gone").where(F.col("seg").isin(index.segments())).groupBy("term").agg(F.sum("n").alias("gone"))
        df = self.rows.groupBy("term").agg(F.sum("n").alias("n")).join(gone, "term", "left").select("term", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("df"))
        idf = F.log(1 + F.lit(self.docs.count()) / (1 + F.col("df")))
        self.weights = materialize(asked.join(df.where("df > 0"), "term").select("query_id", "term", idf.alias("idf")), "weights")
        self.groups = max(1, -(-self.queries.count() // QUERY_BLOCK))
        heads = self.rows.select("block", "term", "most").join(self.weights, "term")
        boost = self.docs.groupBy("block").agg(F.when(F.max("marked"), TITLE_BOOST * MARKER_BOOST).otherwise(TITLE_BOOST).alias("boost"))
        bounds = heads.groupBy("query_id", "block").agg(F.sum(F.col("most") * F.col("idf")).alias("raw")).join(boost, "block")
        self.bounds = bounds.select("query_id", "block", (F.col("raw") * F.col("boost")).alias("bound"))

    def group(self) -> Column:
        return F.pmod(F.xxhash64("query_id"), F.lit(self.groups)).alias("group")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """The best `k` chunks, and ties, of each of `pairs (query_id, block)`."""
        k, sizes = self.k, "query_id long, chunk_id string, score double"
        allowed = pairs.groupBy("block", self.group()).agg(F.collect_list("query_id").alias("allowed"))
        frames = self.docs.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "chunk_id", F.lower(F.coalesce("title", F.lit(""))).alias("title"), "marked"))).alias("d"))
        words = F.struct("query_id", F.array_distinct(tokenize("text")).alias("words"))
        asked = self.queries.select(self.group(), words.alias("q")).groupBy("group").agg(F.sort_array(F.collect_list("q")).alias("queries"))
        frames = allowed.join(frames, "block").join(asked, "group").select(
            "block", "group", "allowed", "queries", F.col("d.at").alias("at"), F.col("d.chunk_id").alias("ids"), F.col("d.title").alias("titles"), F.col("d.marked").alias("marked"))
        asks = self.weights.groupBy("term", self.group()).agg(F.collect_list(F.struct("query_id", "idf")).alias("asks"))
        rows = self.rows.select("block", "term", "chunks", "counts").join(asks, "term").join(allowed.select("block", "group"), ["block", "group"], "left_semi")
        rows = rows.select("block", "group", "chunks", "counts", "asks")
        return rows.groupBy("block", "group").cogroup(frames.groupBy("block", "group")).applyInArrow(lambda p, f: _term_scores(p, f, k), sizes)


def tfidf_top(index: Index, queries: DataFrame, k: int, report: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """`(query_id, chunk_id, score)`: the k best TF-IDF chunks of each query, as `search.tfidf_scores`, without scoring blocks that cannot hold one.

    A block's bound for a query is the sum of its terms' largest weights in the block. The most promising blocks are scored first; where
    they give k chunks, a block whose bound is below the k-th score is skipped. With `report`, also `(query_id, blocks, scored)`."""
    scoring = Scoring(index, queries, k)
    bounds = materialize(top_rows(scoring.bounds, ["query_id"], [F.desc("bound"), F.asc("block")], 1 << 30, "place"), "bounds")
    first = materialize(scoring.scored(bounds.where(F.col("place") <= OPENING).select("query_id", "block")), "opening")
    floor = best(first, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    later = bounds.where(F.col("place") > OPENING).join(floor, "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - 10.0 ** -PLACES)
    later = materialize(later.select("query_id", "block"), "later")
    top = best(first.unionByName(scoring.scored(later)), k).drop("rank")
    if not report:
        return top
    done = later.groupBy("query_id").agg(F.count("*").alias("more"))
    return top, bounds.groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("place") <= OPENING).alias("opened")).join(done, "query_id", "left").select(
        "query_id", "blocks", (F.col("opened") + F.coalesce("more", F.lit(0))).alias("scored"))
