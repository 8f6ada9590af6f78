"""Near-duplicate classes from 64-bit fingerprints, by generalised pigeonhole.

The fingerprint of a text sums the bits of its shingle hashes. Two fingerprints link when few bits differ. For a limit of
t bits, any split of the 64 positions into parts with thresholds r_i that satisfy sum(r_i + 1) = t + 1 has for every linked
pair a part in which at most r_i bits differ (Qin et al. 2018). So:

1. bits that go together over the whole corpus are put into one part, which makes the other parts more selective;
2. thresholds are dealt by dynamic programming over the estimated number of candidates plus the number of probes;
3. each fingerprint is filed under its value of each part and probes all values within the part's threshold;
4. candidates are verified on all 64 bits, and links are closed to components.

Copies share a fingerprint, so links are sought between distinct fingerprints only. Inside one value of a part the
candidates are compared in blocks and leave a spanning forest, never the pairs. A value with more than `crowd` fingerprints
is not compared pairwise: its members are filed under all points within half the limit of them, and two of them share such
a point exactly when they link, so the work there stays in proportion to the members."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_texts, materialize, rooted

BITS = 64
SEED = 42
BLOCK = 1 << 14  # shingles summed at once


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text (A-Z lower-cased, words between ASCII blanks), as a signed number.

    A text with fewer words has one shingle, its whole sequence; one without words has fingerprint zero."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = max(len(words) - shingle + 1, 1)
    size = min(shingle, len(words))
    counts = np.zeros(BITS, np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, last, BLOCK):
        upto = min(at + BLOCK, last)
        values = np.fromiter((hash64(line[starts[i]:starts[i + size] - 1], SEED) for i in range(at, upto)), np.uint64, upto - at)
        counts += np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 4) -> DataFrame:
    """`keep` and `fp`, one row per input row, without a shuffle."""
    return map_texts(docs, keep, text, "fp long", lambda: lambda value: (fingerprint(value, shingle),))


def bit_profile(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits that are set together, over all of them.

    Each task adds up its own matrix; 4096 sums reach the driver whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(values), 8192):
                block = np.unpackbits(values[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += block.T @ block
            seen += len(values)
        if seen:
            yield pa.RecordBatch.from_pydict({"pos": list(range(BITS * BITS + 1)), "n": [*total.ravel().astype(np.int64).tolist(), seen]})

    sums = nodes.select("fp").mapInArrow(run, "pos long, n long").groupBy("pos").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for row in sums:
        flat[row["pos"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Split the positions into `parts` groups of nearly equal width, each grown around the bits most correlated with it."""
    share = together / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    tie = np.abs(share - np.outer(p, p)) / spread
    left, groups = set(range(BITS)), []
    for size in [BITS // parts + (i < BITS % parts) for i in range(parts)]:
        pool = sorted(left)
        group = [max(pool, key=lambda b: (tie[b, pool].sum(), -b))]
        while len(group) < size:
            pool = sorted(left - set(group))
            group.append(max(pool, key=lambda b: (tie[b, group].sum(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def deal_thresholds(costs: list[list[float]], limit: int) -> tuple[float, list[int]]:
    """Thresholds r_i >= -1 (-1: the part is not probed) with sum(r_i + 1) = limit + 1 and the least total cost.

    `costs[i][r]` is the cost of part i at threshold r; an unused part is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, dealt) in best.items():
            for r in range(-1, min(limit - spent, len(cost) - 1) + 1):
                value = total + (cost[r] if r >= 0 else 0.0)
                if spent + r + 1 not in step or value < step[spent + r + 1][0]:
                    step[spent + r + 1] = (value, [*dealt, r])
        best = step
    return best[limit + 1]


def _value(group: list[int]):
    """The bits of a group, packed into the low end of a number."""
    packed = F.lit(0).cast("long")
    for at, bit in enumerate(group):
        packed = packed.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1).cast("long")), at))
    return packed


def plan_parts(nodes: DataFrame, limit: int, widths: tuple[int, ...] = (3, 4, 5), probe_cost: float = 20.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed part: the cheapest deal over several numbers of parts.

    Exact collisions are counted over all fingerprints; candidates at higher thresholds follow from the odds that a bit
    differs. `probe_cost` is the cost of one probe row relative to one verified candidate."""
    n, together = bit_profile(nodes)
    if n < 2:
        return []
    p = np.diag(together) / n
    odds = 2 * p * (1 - p) / np.maximum(p * p + (1 - p) ** 2, 1e-12)
    options = {m: group_bits(n, together, m) for m in widths if m <= limit + 1}
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), _value(g).alias("v"))
                                for m, gs in options.items() for i, g in enumerate(gs)]))
    counts = nodes.select(cells.alias("c")).groupBy("c.m", "c.i", "c.v").count()
    pairs = {(r["m"], r["i"]): r["pairs"] for r in counts.groupBy("m", "i").agg(
        F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    plans = []
    for m, groups in options.items():
        costs = []
        for i, group in enumerate(groups):
            ways = np.zeros(limit + 1)
            ways[0] = 1.0
            for bit in group:
                ways[1:] += ways[:-1] * odds[bit]
            near = np.cumsum(ways) * max(pairs.get((m, i), 0.0), n * (n - 1) / 2 / 2.0 ** len(group))
            probes = np.cumsum([comb(len(group), r) for r in range(limit + 1)]) * n * probe_cost
            costs.append((near + probes).tolist())
        total, dealt = deal_thresholds(costs, limit)
        plans.append((total, [(g, r) for g, r in zip(groups, dealt) if r >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _signatures(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """`(part, key, fp, filed)`: each fingerprint filed under its own value of a part, and probing the values near it."""
    rows = []
    for i, (group, threshold) in enumerate(parts):
        masks = [sum(1 << b for b in c) for r in range(1, threshold + 1) for c in itertools.combinations(range(len(group)), r)]
        rows.append(F.array(F.struct(F.lit(i).alias("part"), _value(group).alias("key"), F.lit(True).alias("filed"))))
        if masks:
            near = F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: F.struct(
                F.lit(i).alias("part"), _value(group).bitwiseXOR(x).alias("key"), F.lit(False).alias("filed")))
            rows.append(near)
    return nodes.select("fp", F.explode(F.concat(*rows)).alias("s")).select("s.part", "s.key", "fp", "s.filed")


def _forest(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key): compare the filed members of each key with all its members, emit a spanning forest."""

    def links(fps: np.ndarray, filed: np.ndarray) -> list[tuple[int, int]]:
        label, found = np.arange(len(fps)), []
        rows = np.flatnonzero(filed)
        for at in range(0, len(rows), 64):
            block = rows[at:at + 64]
            x, y = np.nonzero(np.bitwise_count((fps[block][:, None] ^ fps[None, :]).view(np.uint64)) <= limit)  # counts of absolute values otherwise
            apart = label[block[x]] != label[y]
            for i, j in zip(block[x[apart]].tolist(), y[apart].tolist()):
                low, high = sorted((label[i], label[j]))
                if low != high:
                    label[label == high] = low
                    found.append((int(fps[i]), int(fps[j])))
        return found

    held: list[tuple[np.ndarray, ...]] = []

    def settle(columns: tuple[np.ndarray, ...]) -> tuple[list[tuple[int, int]], int]:
        part, key, fps, filed = columns
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
        found: list[tuple[int, int]] = []
        bounds = [0, *cuts.tolist()]
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1 and filed[a:b].any():
                found += links(fps[a:b], filed[a:b])
        return found, bounds[-1]

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
        whole = tuple(np.concatenate([h[i] for h in held]) for i in range(4))
        found, at = settle(whole)
        held = [tuple(c[at:] for c in whole)]
        if found:
            yield out(found)
    if held and len(held[0][0]) > 1:
        found = links(held[0][2], held[0][3])
        if found:
            yield out(found)


def links(nodes: DataFrame, limit: int = 4, crowd: int = 4000) -> DataFrame:
    """`(a, b)` fingerprints of `nodes (fp)`, all within `limit` bits and joining everything that is linked.

    Not every pair is listed: inside a key a spanning forest stands for its pairs."""
    parts = plan_parts(nodes, limit)
    if not parts:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    rows = materialize(_signatures(nodes, parts), "signatures")
    size = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.count(F.when(F.col("filed"), 1)).alias("f"))
    live = size.where("n > 1 and f > 0").select("part", "key", (F.col("n") > crowd).alias("crowded"))
    busy = rows.join(live, ["part", "key"])
    calm = busy.where("not crowded").select("part", "key", "fp", "filed")
    near = calm.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(
        lambda batches: _forest(batches, limit), "a long, b long")
    crowd_nodes = materialize(busy.where("crowded").select("fp").distinct(), "crowd")
    return near.unionByName(shared_points(crowd_nodes, limit))


def shared_points(nodes: DataFrame, limit: int) -> DataFrame:
    """Links among `nodes` through common points: two fingerprints differ in at most 2r bits exactly when some point is
    within r bits of both, so each point links all that reach it to the smallest one. Rows per fingerprint are fixed.

    For an odd limit one side reaches one bit less: filed points within `limit // 2`, reached from `limit - limit // 2`."""
    low, high = limit // 2, limit - limit // 2
    ring = nodes.select("fp", F.col("fp").alias("point"), F.lit(-1).alias("last"), F.lit(True).alias("near"))
    reached = ring
    for r in range(1, high + 1):
        bits = F.explode(F.sequence(F.col("last") + 1, F.lit(BITS - 1))).alias("last")
        ring = ring.where(F.col("last") < BITS - 1).select("fp", "point", bits).select(
            "fp", F.col("point").bitwiseXOR(F.expr("shiftleft(1L, last)")).alias("point"), "last", F.lit(r <= low).alias("near"))
        reached = reached.unionByName(ring)
    heads = reached.where("near").groupBy("point").agg(F.min("fp").alias("b"))
    return reached.join(heads, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, limit: int = 4,
                    crowd: int = 4000) -> DataFrame:
    """`(key, fp, component_id)`, one row per input row; `component_id` is the smallest key reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows each keep their own row. A null key
    takes part in links but names no component unless all keys of it are null. Other columns are not read. An empty table
    gives no rows."""
    marked = materialize(fingerprints(docs, [key], text, shingle), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), limit, crowd))
    classed = rooted(nodes, "fp", roots, "root")
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classed.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")
