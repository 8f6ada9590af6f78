"""Language identification by Bayesian evidence fusion.

The text's likelihood under each language (hashed character trigrams, counted over the whole corpus by declared language)
is combined with the declared markup language, the address suffix and a prior of the host. All counts are grouped
aggregates over every row. Host priors are smoothed hierarchically: host by registered domain, domain by the corpus; a
row's own vote is taken out of its host's and domain's counts, so the text is not heard twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize

BINS = 1 << 13
OVERLAP = 3.0  # neighbouring trigrams share letters: their evidence counts for a third
UNKNOWN = "und"
STRANGE = 4.6  # log odds against a text in no known language, log(99)


def trigram_bins(text: str) -> np.ndarray:
    """Hashed trigrams of a lower-cased text; anything but letters is a blank, and blanks only stand at the edges."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = ((chars >= 97) & (chars <= 122)) | (chars >= 0xAA)
    chars = np.concatenate([[np.uint64(32)], np.where(letter, chars, np.uint64(32)), [np.uint64(32)]]).astype(np.uint64)
    if len(chars) < 3:
        return np.empty(0, np.int64)
    middle = chars[1:-1] != 32
    mixed = (chars[:-2] * np.uint64(0x9E3779B97F4A7C15) + chars[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + chars[2:] * np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed[middle] >> np.uint64(51)).astype(np.int64)


def languages_of(docs: DataFrame, declared: Column, least_share: float, least_rows: int) -> list[str]:
    """Declared languages that the given number of rows carry, or the given share of a small table."""
    counts = docs.select(declared.alias("l")).groupBy("l").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = min(float(least_rows), least_share * max(total, 1))
    return sorted(r["l"] for r in counts.where(F.col("l").isNotNull() & (F.col("n") >= least)).collect())


def profiles(docs: DataFrame, text: str, declared: Column, languages: list[str]) -> np.ndarray:
    """Log probabilities (languages x bins) of trigrams, counted over all rows. Tasks add up their own counts."""
    at = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BINS), np.int64)
        for batch in batches:
            for value, name in zip(batch.column(0), batch.column(1)):
                row = at.get(name.as_py())
                if row is not None:
                    counts[row] += np.bincount(trigram_bins(value.as_py() or ""), minlength=BINS)
        flat = counts.ravel()
        spots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"spot": spots.astype(np.int64), "n": flat[spots]})

    counts = np.full(len(languages) * BINS, 0.5)
    rows = docs.select(F.col(text), declared.alias("l")).mapInArrow(run, "spot long, n long").groupBy("spot").agg(F.sum("n").alias("n"))
    for r in rows.collect():
        counts[r["spot"]] += r["n"]
    counts = counts.reshape(len(languages), BINS)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def score_texts(docs: DataFrame, keep: list[str], text: str, logs: np.ndarray) -> DataFrame:
    """`keep`, the log likelihoods `like__` of the languages (best 0) and the best one's number `vote__`; null without letters
    and where trigrams drawn evenly explain the text better than any language, by odds of `STRANGE`."""

    def make():
        def score(value: str) -> tuple:
            bins = trigram_bins(value)
            if not len(bins):
                return None, None
            times = np.bincount(bins, minlength=BINS)  # as long as the table, however long the text
            held = np.flatnonzero(times)
            like = (logs[:, held] * times[held]).sum(axis=1) / OVERLAP
            if -len(bins) * np.log(BINS) / OVERLAP - like.max() > STRANGE:
                return None, None
            like -= like.max()
            return like.tolist(), int(like.argmax())
        return score

    return map_texts(docs, keep, text, "like__ array<double>, vote__ long", make)


def fuse(scored: DataFrame, keep: list[str], languages: list[str], declared: str | None = None, suffix: str | None = None,
         host: str | None = None, least_p: float = 0.5, strength: float = 20.0, trust: float = 10.0) -> DataFrame:
    """`keep` and `detected`, `probability`, `text_language`, `accepted` for rows of `score_texts`.

    Votes are summed per host, domain, declared language and suffix with map-side sums; the sums, one row per value, are
    joined back and a frequent value is left to the skew handling of the join."""
    n, null = len(languages), F.lit(None).cast("string")
    of = lambda c: F.lower(F.col(c)) if c else null
    labels = F.split(of(host), r"\.")
    domain = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, F.size(labels) - 1, 2), "."))
    facts = {"declared__": of(declared), "suffix__": of(suffix), "host__": of(host), "domain__": domain}
    cells = materialize(scored.where("vote__ is not null").select(*[c.alias(name) for name, c in facts.items()], F.col("vote__").alias("vote")).groupBy(
        *facts, "vote").agg(F.count("*").alias("n")), "votes")
    votes = [F.sum(F.when(F.col("vote") == i, F.col("n")).otherwise(0)).cast("double") for i in range(n)]
    total = [r or 0.0 for r in cells.agg(*votes).first()]
    known = [F.lit((x + 1.0) / (sum(total) + n)) for x in total]
    held = scored.select(*keep, "like__", "vote__", *[c.alias(name) for name, c in facts.items()])
    for by in facts:
        held = held.join(cells.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*votes).alias(f"{by}votes")), by, "left")

    def at(by: str, i: int) -> Column:
        """Votes of a value for language i without the row's own."""
        own = F.when(F.col("vote__") == i, 1.0).otherwise(0.0)
        return F.greatest(F.coalesce(F.col(f"{by}votes")[i] - own, F.lit(0.0)), F.lit(0.0))

    def whole(by: str) -> Column:
        votes = F.aggregate(F.col(f"{by}votes"), F.lit(0.0), lambda acc, x: acc + x)
        return F.greatest(F.coalesce(votes - F.when(F.col("vote__").isNotNull(), 1.0).otherwise(0.0), F.lit(0.0)), F.lit(0.0))

    def prior(i: int) -> Column:
        by_domain = (at("domain__", i) + strength * known[i]) / (whole("domain__") + strength)
        return (at("host__", i) + strength * by_domain) / (whole("host__") + strength)

    def evidence(by: str, i: int) -> Column:
        """log P(value | language i), up to a constant of the value."""
        seen = (at(by, i) + trust * known[i]) / (whole(by) + trust)
        return F.when(F.col(f"{by}votes").isNotNull(), F.log(seen) - F.log(known[i])).otherwise(0.0)

    logp = [F.col("like__")[i] + F.log(prior(i)) + evidence("declared__", i) + evidence("suffix__", i) for i in range(n)]
    fused = held.select(*keep, "vote__", F.array(*logp).alias("logp__"))
    top, names = F.array_max("logp__"), F.array(*[F.lit(x) for x in languages])
    chance = 1.0 / F.aggregate("logp__", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    letters = F.col("vote__").isNotNull()
    chosen = fused.select(
        *keep, F.when(letters, F.element_at(names, F.array_position("logp__", top).cast("int"))).otherwise(UNKNOWN).alias("detected"),
        F.when(letters, chance).otherwise(0.0).alias("probability"),
        F.when(letters, F.element_at(names, (F.col("vote__") + 1).cast("int"))).otherwise(UNKNOWN).alias("text_language"))
    return chosen.withColumn("accepted", (F.col("detected") != UNKNOWN) & (F.col("probability") >= least_p))


def identify(docs: DataFrame, keep: list[str], text: str = "text", declared: str | None = "lang", suffix: str | None = None,
             host: str | None = "source", languages: list[str] | None = None, least_share: float = 0.001, least_p: float = 0.5,
             strength: float = 20.0, trust: float = 10.0, least_rows: int = 20) -> DataFrame:
    """`keep`, `detected`, `probability`, `text_language` and `accepted`, one row per input row.

    `languages` are those to choose from, by default all that at least `least_rows` rows declare, or `least_share` of a small
    table's. `strength` is the
    weight, in rows, of the domain in a host's prior and of the corpus in a domain's; `trust` smooths the tables of
    declared language and suffix the same way. A row is accepted if its text has a letter and one language reaches
    `least_p`. Missing or null evidence is left out; a text without letters or in no known
    language gives `und` and is rejected, as is any text when no language is known. Ties go to the language that comes first by name. Repeated rows get equal results. `keep` must not
    hold the four names made here. An empty table gives no rows. Texts are read three times (profiles, votes, result) and
    shuffled only if a table of votes is too large for Spark to broadcast."""
    languages, logs = train(docs, text, declared, languages, least_share, least_rows)
    if not languages:
        return docs.select(*keep, F.lit(UNKNOWN).alias("detected"), F.lit(0.0).alias("probability"), F.lit(UNKNOWN).alias("text_language"),
                           F.lit(False).alias("accepted"))
    facts = {"declared__in": declared, "suffix__in": suffix, "host__in": host}
    read = docs.select(*keep, F.col(text).alias("text__in"), *[F.col(c).alias(name) for name, c in facts.items() if c])
    scored = score_texts(read, [c for c in read.columns if c != "text__in"], "text__in", logs)
    return fuse(scored, keep, languages, *[name if c else None for name, c in facts.items()], least_p, strength, trust)


def train(docs: DataFrame, text: str, declared: str | None, languages: list[str] | None = None, least_share: float = 0.001,
          least_rows: int = 20) -> tuple[list[str], np.ndarray]:
    """Languages and their profiles, from the declared languages of all rows."""
    said = F.lower(F.col(declared)) if declared else F.lit(None).cast("string")
    languages = sorted(languages) if languages else languages_of(docs, said, least_share, least_rows)
    return languages, profiles(docs, text, said, languages) if languages else np.zeros((0, BINS))
