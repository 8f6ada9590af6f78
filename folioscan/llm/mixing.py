"""Mix a corpus to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are summed into cells of source, language and topic. Raking scales the cells until their token sums match every
target marginal; its state is the cells with one factor for each of their dimensions. Documents are then sampled with the calibrated rate
of their cell."""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, scratch_path

# Topics by what a text holds, the first that fits; a text without any is prose. Each has a literal that every
# match holds: most texts fail it byte by byte. An address needs one character before its @: a longer run adds no match.
TOPICS = (("legal", "icen", "[Ll]icen[sc]e"), ("contact", "@", "[A-Za-z0-9.]@[a-z0-9]+[.]"), ("markup", "", "[#*$%&]{3}"))
PROSE = "prose"
STALLED = 0.999  # a round that leaves more of the residual than this shows targets that contradict each other
WORD = r"[^ \t\n\r]+"


def topic_of(text: Column) -> Column:
    out, body = F.lit(PROSE), F.coalesce(text, F.lit(""))
    for name, literal, pattern in reversed(TOPICS):
        out = F.when(body.contains(literal) & body.rlike(pattern), name).otherwise(out)
    return out


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """`(dim, share)`: target shares in proportion to a power of the observed tokens; below 1 the rare gain."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
    return sums.select(dim, (F.col("p") / sums.agg(F.sum("p")).scalar()).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float = 1e-3) -> tuple[DataFrame, float]:
    """`cells (dims..., tokens)` with `factor`: tokens * factor have the target shares in every dimension; and the residual, the
    largest error of a share relative to its target.

    The cells carry each dimension's target share and factor along. A half-round sums them under the other dimensions' factors,
    one aggregate with map-side sums, and writes them with the new factors of one dimension: one shuffle and one join each, so
    that the driver plans little. There are at least `rounds`, and then as many as bring the residual down to `tolerance`; where
    a round no longer lowers it, the targets contradict each other, which is left to the caller. Values without a target get
    factor 0; a value whose cells are all empty keeps its target unmet and is not in the residual."""
    spark = cells.sparkSession
    state, path = cells, None
    for dim, target in targets.items():
        state = state.join(target.select(dim, F.col("share").cast("double").alias(f"s_{dim}")), dim, "left")
    state = state.select(*cells.columns, *[f"s_{d}" for d in targets], *[F.when(F.col(f"s_{d}").isNotNull(), 1.0).otherwise(0.0).alias(f"f_{d}") for d in targets])

    def weight(under: list[str]) -> Column:
        return reduce(lambda out, d: out * F.col(f"f_{d}"), under, F.col("tokens").cast("double"))

    def written(df: DataFrame) -> DataFrame:
        nonlocal path
        old, path = path, scratch_path(spark, "factors")
        df.write.parquet(path)
        if old:
            drop_path(spark, old)
        return spark.read.schema(df.schema).parquet(path)

    def residual() -> float:
        values = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), F.col(f"s_{d}").alias("share")) for d in targets]))
        masses = state.select(values.alias("v"), weight(list(targets)).alias("w")).groupBy("v.dim", "v.value").agg(F.sum("w").alias("mass"), F.max("v.share").alias("share"))
        ratio = F.col("mass") / F.col("share")
        sides = masses.where("mass > 0").groupBy("dim").agg(F.min(ratio).alias("low"), F.max(ratio).alias("high"), (F.sum("mass") / F.sum("share")).alias("mean"))
        rows = [r for r in sides.collect() if r["mean"]]
        return max((abs(r[side] / r["mean"] - 1) for r in rows for side in ("low", "high")), default=0.0)

    state = written(state)
    done, error, before = 0, math.inf, math.inf
    while done < rounds or tolerance < error < STALLED * before:
        for dim in targets:
            mass = F.sum(weight([other for other in targets if other != dim]))
            sums = state.groupBy(dim).agg(mass.alias("mass"), F.max(f"s_{dim}").alias("share")).where("mass > 0")
            fresh = sums.select(dim, (F.col("share") / F.col("mass")).alias("fresh"))
            state = written(state.drop(f"f_{dim}").join(fresh, dim, "left").withColumn(f"f_{dim}", F.coalesce("fresh", F.lit(0.0))).drop("fresh"))
        done += 1
        if done >= rounds:
            before, error = error, residual()
    factor = reduce(lambda out, d: out * F.col(f"f_{d}"), targets, F.lit(1.0))
    return state.select(*cells.columns, factor.alias("factor")), error


def mix(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
        targets: dict[str, DataFrame] | None = None, powers: tuple[float, float, float] = (0.5, 0.7, 0.9), share: float = 0.5,
        rounds: int = 6, seed: int = 0, tolerance: float = 1e-3) -> DataFrame:
    """`keep` and `mix_source`, `mix_lang`, `mix_topic`, `mix_tokens`, `weight`, `copies`, one row per input row.

    `targets` gives `(mix_source | mix_lang | mix_topic, share)` tables; a missing one is tempered by its entry of `powers`.
    `weight` is the expected number of copies, scaled so that the sample holds `share` of the tokens; `copies` is drawn from
    it: the whole part, and one more if a uniform number hashed from `seed` and the key falls below the rest. Rows with equal
    keys are drawn alike. Null source, language or text count as an empty value; a text without words has no tokens, adds
    nothing to a marginal and has weight 0. Raking goes on, after `rounds` at least, until every share is within `tolerance` of
    its target; a warning gives the residual where targets contradict each other. Names in `keep` must differ from those made
    here. An empty table gives no rows. The texts are read, not shuffled."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    dims = ("mix_source", "mix_lang", "mix_topic")
    marked = docs.select(*keep, F.col(key).alias("key__"), blank(source).alias("mix_source"), blank(lang).alias("mix_lang"),
                         topic_of(F.col(text)).alias("mix_topic"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("mix_tokens"))
    cells = materialize(marked.groupBy(*dims).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    goals = {d: (targets or {}).get(d) or tempered(cells, d, p) for d, p in zip(dims, powers)}
    raked, error = rake(cells, goals, rounds, tolerance)
    if error > tolerance:
        warnings.warn(f"the mixing targets contradict each other: a share is {error:.2%} off its target", RuntimeWarning, stacklevel=2)
    scale = raked.agg((F.sum(F.col("tokens").cast("double")) * share / F.sum(F.col("tokens") * F.col("factor"))).alias("scale"))
    rates = raked.select(*dims, (F.col("factor") * scale.scalar()).alias("weight"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key__").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    out = marked.join(rates, list(dims), "left").withColumn(
        "weight", F.when(F.col("mix_tokens") > 0, F.round(F.coalesce("weight", F.lit(0.0)), 9)).otherwise(0.0))
    copies = (F.floor("weight") + F.when(drawn < F.col("weight") - F.floor("weight"), 1).otherwise(0)).cast("long")
    return out.select(*keep, *dims, "mix_tokens", "weight", copies.alias("copies"))
