"""URL rules and listed hosts through Bloom filter cascades, with DataFrame functions only.

A cascade over a known universe of keys is exact (Larisch et al. 2017): level 0 holds the listed keys; level 1 holds the
unlisted keys of the universe that level 0 wrongly accepts; level 2 the listed keys that level 1 wrongly accepts; and so on
until nothing is left. A key is listed when the first level that rejects it is an odd one. The universe is every key that
any url of the corpus asks for, so no url meets a false answer, and rows are judged by bit tests without a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_path, scratch_path

# Filters of one cascade that may be held by every executor; beyond it membership is settled per distinct host by a join.
MOST_BYTES = 256 << 20


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: DataFrame  # one row: the filter as array<bigint>


def host_of(url: Column) -> Column:
    """What stands after the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and every domain above it, longest first; an empty host has none."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (domain, path prefix) a rule could name for this url, as text; prefixes of the given lengths only."""
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    return F.flatten(F.transform(suffixes(host), lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _spots(key: Column, level: int, bits: int, hashes: int) -> Column:
    """Positions of a key by double hashing, as an array; each level has its own hash functions."""
    span = F.lit(1 << 40).cast("long")  # sums stay far from overflow
    first, step = F.pmod(F.xxhash64(F.lit(2 * level), key), span), F.pmod(F.xxhash64(F.lit(2 * level + 1), key), span)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda i: F.pmod(first + step * i, F.lit(bits).cast("long")))


def build_filter(keys: DataFrame, count: int, level: int, rate: float) -> Level:
    """Bloom filter of `keys (key)` with the given rate of false answers: bits are set per 64-bit word by grouped ors."""
    bits = max(64, 64 * math.ceil(count * math.log2(1 / rate) / math.log(2) / 64))
    hashes = max(1, min(16, round(bits / max(count, 1) * math.log(2))))
    spots = keys.select(F.explode(_spots(F.col("key"), level, bits, hashes)).alias("spot"))
    word, bit = F.shiftright("spot", 6), F.expr("shiftleft(1L, cast(spot % 64 as int))")
    words = spots.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    dense = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word")).join(words, "word", "left")
    row = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))),
                                lambda w: w["bits"]).alias("words"))
    return Level(bits, hashes, row)


def accepts(key: Column, words: Column, level: int, spec: Level) -> Column:
    """Whether the filter in column `words` has all bits of the key."""
    return F.forall(_spots(key, level, spec.bits, spec.hashes), lambda spot: F.getbit(
        F.element_at(words, (F.shiftright(spot, 6) + 1).cast("int")), F.pmod(spot, F.lit(64)).cast("int")) == 1)


def build_cascade(universe: DataFrame, listed: Column, rate: float = 0.01) -> list[Level]:
    """Levels of the cascade for the rows of `universe (key, ...)` where `listed` holds. Keys must be distinct.

    The keys that a level must tell apart are written to the shared folder; they shrink by `rate` from level to level."""
    spark = universe.sparkSession
    levels: list[Level] = []
    inside, outside, paths = universe.where(listed).select("key"), universe.where(~listed).select("key"), []
    count = inside.count()
    while count:
        at = len(levels)
        spec = build_filter(inside, count, at, rate)
        path = scratch_path(spark, "bloom")
        spec.words.write.parquet(path)
        spec = Level(spec.bits, spec.hashes, spark.read.schema("words array<bigint>").parquet(path))
        levels.append(spec)
        wrong = outside.withColumn("words__", spec.words.scalar()).where(accepts(F.col("key"), F.col("words__"), at, spec)).select("key")
        paths.append(scratch_path(spark, "false"))
        wrong.write.parquet(paths[-1])
        inside, outside = spark.read.schema("key string").parquet(paths[-1]), inside
        count = inside.count()
    for path in paths:
        drop_path(spark, path)
    return levels


def listed_in(levels: list[Level], names: list[str], key: Column) -> Column:
    """Membership of a key; the filters stand in the columns `names`."""
    answer = F.lit(False)
    for at in reversed(range(len(levels))):
        answer = accepts(key, F.col(names[at]), at, levels[at]) & ~answer
    return answer


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: Column | None = None, url: str = "url",
               rate: float = 0.01, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`pages` without columns of the names made here, plus `host`, `path`, `rule`, `verdict`, `listed`.

    `rules` are (verdict, host, path prefix), a parameter of a few hundred entries at most. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest wins (`rule`, host and path together). Without a rule the
    verdict is block when the host or a domain above it satisfies `blocked`, a condition on the column `domain` that lists
    the domains of the corpus to block, else allow. Null urls and urls without `://` have empty host and path and no rule, and are allowed.
    Repeated rows each get their verdict. An empty table gives no rows."""
    spark = pages.sparkSession
    made = ("host", "path", "rule", "verdict", "listed")
    kept = [c for c in pages.columns if c not in made]
    split = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    keys = keys_of(F.col("host"), F.col("path"), lengths)
    asked = split.groupBy("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).agg(F.lit(1).alias("one"))
    rule_keys = asked.select(F.explode(keys).alias("key")).distinct()
    domains = asked.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    verdict_keys = {v: [h + p for verdict, h, p in rules if verdict == v] for v in ("allow", "block")}
    path = scratch_path(spark, "keys")
    universe = rule_keys.select("key", F.lit("rule").alias("kind")).unionByName(domains.select("key", F.lit("domain").alias("kind")))
    universe.write.parquet(path)
    universe = spark.read.schema("key string, kind string").parquet(path)
    of_rules, of_domains = universe.where("kind = 'rule'"), universe.where("kind = 'domain'")
    is_blocked = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
    names_listed = of_domains.withColumn("domain", F.col("key"))
    n_listed = names_listed.where(is_blocked).count()
    fits = n_listed * math.log2(1 / rate) / math.log(2) / 8 * (1 + 4 * rate) < most_bytes

    cascades = {v: build_cascade(of_rules, F.col("key").isin(verdict_keys[v]), rate) for v in verdict_keys}
    if fits:
        cascades["domain"] = build_cascade(names_listed, is_blocked, rate)
    filters = {(c, i): f"{c}_{i}__" for c, levels in cascades.items() for i in range(len(levels))}
    held = split
    for (c, i), name in filters.items():
        held = held.withColumn(name, cascades[c][i].words.scalar())
    within = lambda c, key: listed_in(cascades[c], [filters[c, i] for i in range(len(cascades[c]))], key)
    ruled = F.filter(keys, lambda k: within("allow", k) | within("block", k))
    longest = F.array_max(F.transform(ruled, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    out = held.withColumn("rule", longest)
    if fits:
        out = out.withColumn("listed", F.exists(suffixes(F.col("host")), lambda d: within("domain", d)))
    else:  # the list is too long to be held everywhere: settle each distinct host by a join, then name the rows' hosts
        hosts = asked.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
        bad = hosts.join(names_listed.where(is_blocked).select("key"), "key").select("host").distinct()
        out = out.join(bad.withColumn("listed", F.lit(True)), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    by_rule = F.when(F.col("rule").isNull(), None).when(within("block", F.col("rule")), "block").otherwise("allow")
    verdict = F.coalesce(by_rule, F.when(F.col("listed"), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).select(*kept, *made)
