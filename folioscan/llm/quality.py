"""Line-first cleaning: judge every line, remove those that fail, then reject texts that lost too much of themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# What web navigation and boilerplate say, lower case.
NAVIGATION = ("about", "archive", "back", "blog", "categories", "contact", "faq", "help", "home", "login", "logout", "menu",
              "more", "news", "next", "previous", "register", "search", "share", "sitemap", "skip", "tags", "top")
BOILERPLATE = ("accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in to",
               "lorem ipsum", "powered by", "privacy policy", "read more", "sign up", "subscribe to", "terms of service",
               "terms of use", "use of cookies")
SYMBOLS = "#*$%&|<>"
ENDINGS = (".", "!", "?", "…", ":", ";", "。", "！", "？", '"', "”", "»", ")")
BLANKS = " \t\n\x0b\x0c\r"

OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_punctuation long, "
       "n_navigation long, n_boilerplate long, kept_chars long, clean_text string")


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """How many words stand in a run of `window` words that occurs at least twice in the list."""
    spots = len(words) - window + 1
    if spots < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    runs = np.lib.stride_tricks.sliding_window_view(ids, window)
    keys = np.zeros(spots, np.uint64)
    for i in range(window):  # equal runs have equal keys
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + spots].astype(np.uint64) + np.uint64(1)
        keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    twins = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    if not len(twins):
        return 0
    marked = np.zeros(spots, bool)
    if (runs[order[twins]] == runs[order[twins + 1]]).all():
        marked[order[twins]] = marked[order[twins + 1]] = True
    else:  # different runs met under one key
        first: dict[tuple, int] = {}
        for at in np.unique(np.concatenate([order[twins], order[twins + 1]])).tolist():
            seen = first.setdefault(tuple(runs[at]), at)
            if seen != at:
                marked[seen] = marked[at] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(marked)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def line_fault(line: str, repeated: bool, short: int = 4, symbol_share: float = 0.1) -> str | None:
    """Which rule a line with words fails: boilerplate (a set phrase, or a repeat of an earlier line), navigation (a menu),
    punctuation (too many symbols, or a stub of fewer than `short` words without an ending); None if it passes."""
    low = line.lower()
    if repeated or any(phrase in low for phrase in BOILERPLATE):
        return "boilerplate"
    words = low.split()
    bare = [w.strip(".,:;|/»›>·-[]()") for w in words]
    named = sum(w in NAVIGATION for w in bare)
    parts = low.count("|") + low.count("»") + low.count("›") + low.count("·")
    if len(words) <= 12 and named >= max(2, sum(1 for w in bare if w) * 0.6) or parts >= 3 and len(words) <= 4 * parts:
        return "navigation"
    chars = sum(map(len, words))
    if sum(line.count(c) for c in SYMBOLS) > symbol_share * chars:
        return "punctuation"
    if len(words) < short and not line.rstrip().endswith(ENDINGS):
        return "punctuation"
    return None


def measure(text: str, short: int = 4, symbol_share: float = 0.1) -> tuple:
    """The columns of `OUT` for one text."""
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    counts = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    seen: set[str] = set()
    lines, repeats, kept, kept_chars = 0, 0, [], 0
    for line in text.split("\n"):
        size = len(line) - sum(line.count(c) for c in BLANKS)
        if not size:
            kept.append(line)
            continue
        lines += 1
        again = line in seen
        repeats += again
        seen.add(line)
        fault = line_fault(line, again, short, symbol_share)
        if fault:
            counts[fault] += 1
        else:
            kept.append(line)
            kept_chars += size
    return (len(words), chars, sum(text.count(c) for c in SYMBOLS), repeats, repeated_words(words), lines, counts["punctuation"],
            counts["navigation"], counts["boilerplate"], kept_chars, "\n".join(kept))


def clean_lines(docs: DataFrame, keep: list[str], text: str = "text", least_words: int = 20, most_repeat: int = 30,
                most_lost: float = 0.5, short: int = 4, symbol_share: float = 0.1) -> DataFrame:
    """`keep`, the measures of each text, `clean_text` without the failing lines, `base_failed` and `kept`.

    `base_failed`: fewer than `least_words` words, or more than `most_repeat` percent of them in repeated 8-word runs.
    `kept`: not failed, and at most the share `most_lost` of the word characters stood in removed lines.
    Null and empty texts have no words and fail. Each row is judged alone: repeated rows and ties get equal results, other
    columns are not read, an empty table gives no rows. No shuffle."""
    found = map_texts(docs, keep, text, OUT, lambda: lambda value: measure(value, short, symbol_share))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeat)
    lost = F.col("word_chars") - F.col("kept_chars") > F.col("word_chars") * most_lost
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)
