"""Ordered per-key computations that stay parallel when one key holds most of the rows.

A plain window puts a whole key in one task. Here each key is cut into blocks by a monotone
expression of the order column (a day, an id range); the window runs inside (key, block), block
totals are combined per key (a few rows), and the two are joined on (key, block). Both the window
and the join hash on the same columns, so the rows are shuffled once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = "__block"


def id_block(column: str, width: int = 65536) -> Column:
    return F.floor(F.col(column) / F.lit(width))


def day_block(column: str) -> Column:
    return F.date_trunc("DAY", F.col(column))


def running(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
            sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
            inclusive: bool = True) -> DataFrame:
    """Running sums and maxima per key in ascending `order`; `inclusive=False` leaves out the row itself.

    `maxes` accepts structs, so a running "latest value" is a running maximum of (order, value)."""
    sums, maxes = sums or {}, maxes or {}
    tagged = df.withColumn(BLOCK, block)
    local_frame = (W.partitionBy(*keys, BLOCK).orderBy(*order)
                   .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    local = tagged.select(
        "*",
        *[F.sum(c).over(local_frame).alias(f"__local_{n}") for n, c in sums.items()],
        *[F.max(c).over(local_frame).alias(f"__local_{n}") for n, c in maxes.items()])
    totals = tagged.groupBy(*keys, BLOCK).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxes.items()])
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, BLOCK,
        *[F.sum(n).over(earlier).alias(f"__before_{n}") for n in sums],
        *[F.max(n).over(earlier).alias(f"__before_{n}") for n in maxes])
    joined = local.join(offsets, [*keys, BLOCK], "left")
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"__before_{n}"), F.lit(0)) + F.coalesce(F.col(f"__local_{n}"), F.lit(0))).alias(n)
          for n in sums],
        *[F.greatest(F.col(f"__before_{n}"), F.col(f"__local_{n}")).alias(n) for n in maxes])


def neighbour(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
              fields: Sequence[str], name: str, following: bool = True) -> DataFrame:
    """Add struct `name` with `fields` of the next (or previous) row of the same key; NULL at the end."""
    tagged = df.withColumn(BLOCK, block)
    packed = F.struct(*[F.col(f) for f in fields])
    at = F.struct(*[F.col(o) for o in order])
    inner = W.partitionBy(*keys, BLOCK).orderBy(*order)
    step = F.lead if following else F.lag
    edge = F.min_by(packed, at) if following else F.max_by(packed, at)
    across = W.partitionBy(*keys).orderBy(BLOCK)
    edges = (tagged.groupBy(*keys, BLOCK).agg(edge.alias("__edge"))
             .select(*keys, BLOCK, step("__edge").over(across).alias("__outer")))
    return (tagged.withColumn("__inner", step(packed).over(inner))
            .join(edges, [*keys, BLOCK], "left")
            .select(*df.columns, F.coalesce("__inner", "__outer").alias(name)))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark prunes to k per task before the shuffle (window group limit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1, "__first").drop("__first")


def page_of(df: DataFrame, block: Column, order: Sequence[Column], page: int, size: int,
            max_size: int = 100, descending: bool = False) -> DataFrame:
    """Rows of one page of a total order, with the paging facts on each row.

    `block` must follow `order`. Block counts locate the page, so only the blocks that overlap it are
    sorted; a deep page costs no more than the first and nothing is gathered on the driver.
    A page past the end becomes the last one."""
    page, size = max(1, page), max(1, min(size, max_size))
    tagged = df.withColumn(BLOCK, block)
    along = F.desc(BLOCK) if descending else F.asc(BLOCK)
    counts = tagged.groupBy(BLOCK).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy(along).rowsBetween(W.unboundedPreceding, -1))
    spans = counts.select(
        BLOCK, "__n", F.coalesce(before, F.lit(0)).alias("__skip"),
        F.sum("__n").over(W.partitionBy()).alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    spans = spans.withColumn("pages", pages).withColumn("page", F.least(F.lit(page), pages))
    start = (F.col("page") - 1) * size
    wanted = spans.where((F.col("__skip") < start + size) & (F.col("__skip") + F.col("__n") > start))
    ranked = tagged.join(wanted, BLOCK).withColumn(
        "position", F.col("__skip") + F.row_number().over(W.partitionBy(BLOCK).orderBy(*order)))
    return (ranked.where((F.col("position") > start) & (F.col("position") <= start + size))
            .select(*df.columns, F.col("position").cast("bigint"), F.col("total").cast("bigint"),
                    F.col("page").cast("bigint"), F.col("pages").cast("bigint")))


def equal_depth(df: DataFrame, key: Column, parts: int = 64, sample: int = 10_000) -> Column:
    """A block number that follows `key` (a struct of plain fields) and gives each block about as many rows, ties of single fields
    included. Cuts come from a sample of about `sample` keys; they decide the size of blocks only."""
    total = df.count()
    drawn = df.select(key.alias("k")).sample(min(1.0, sample / max(total, 1)), seed=5).orderBy("k").collect()
    at = sorted({len(drawn) * i // parts for i in range(1, parts)}) if drawn else []
    names = df.select(key.alias("k")).schema["k"].dataType
    cuts = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(drawn[i]["k"], names.fields)]) for i in at]
    return F.size(F.filter(F.array(*cuts), lambda c: c <= key)) if cuts else F.lit(0)


def qa_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn that is directly followed by an assistant turn, as one question/answer row."""
    paired = neighbour(turns, ["session_id"], id_block("turn", 4096), ["turn"], ["role", "content"], "next")
    return (paired.where((F.col("role") == "user") & (F.col("next.role") == "assistant"))
            .select(F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("id"), "session_id", "turn",
                    F.col("content").alias("question"), F.col("next.content").alias("answer")))
