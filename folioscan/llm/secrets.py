"""Secret scan: fixed patterns, and strings in a sensitive context that zstandard cannot compress.

The compressor is primed with a dictionary of identifiers, counted over the contexts of the whole corpus. The novelty of a
candidate is what it adds to the compressed size of the code around it: words and known identifiers add a few bytes,
random keys add nearly their own length."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ("assign", "access", "hex", "novel")
# The base patterns; only ASCII letters fold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
SENSITIVE = re.compile(r"(?:password|passwd|pwd|secret|token|api_?key|access_?key|private_?key|auth|bearer|credential|signature)", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
NAME = re.compile(r"[A-Za-z0-9_-]*")
IDENTIFIER = re.compile(r"[A-Za-z]{3,40}")
REACH = 48   # a candidate starts at most this far after a sensitive word or the name that holds it, or ends so far before one
AROUND = 160  # characters of code on each side that the novelty is measured against
REDACTED = "[secret]"

OUT = "base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>, redacted string"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping per kind, in code points; by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Long strings of key characters, with a letter and a digit, close to a sensitive word: those that follow the word itself, and
    all strings close behind the name that holds it or close before it."""
    found, done, named, starts, ends = [], 0, 0, [], []
    keyed = lambda spot: any(c.isdigit() for c in spot[0]) and any(c.isalpha() for c in spot[0])
    for word in SENSITIVE.finditer(text):
        at = word.end()
        starts.append(word.start())
        if at > named:  # words of one name share its end, so a name is read once
            named = NAME.match(text, at).end()
        ends.append(named)
        if at < done or not CANDIDATE.search(text, at, at + REACH + 16):  # inside a string already seen, or none in reach
            continue
        spot = CANDIDATE.search(text, at)
        done = spot.end()
        if spot.start() <= at + REACH and keyed(spot):
            found.append(spot.span())
    if not starts:
        return found
    taken = set(at for _, at in found)  # a string that the word is part of ends where its rest does
    for spot in CANDIDATE.finditer(text):
        start, end = spot.span()
        behind, ahead = bisect_right(ends, start), bisect_left(starts, end)
        if end not in taken and keyed(spot) and (behind and start - ends[behind - 1] <= REACH or ahead < len(starts) and starts[ahead] - end <= REACH):
            found.append((start, end))
    return sorted(found)


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """The code before and after, without further copies of the candidate itself."""
    value = text[start:end]
    return text[max(0, start - AROUND):start].replace(value, " "), text[end:end + AROUND].replace(value, " ")


def identifier_words(text: str) -> tuple[list[str]]:
    """Words of the identifiers around and among the candidates of a text; long strings rich in digits give none, so a key
    that is copied into many texts does not become a known word."""
    plain = lambda m: " " if sum(c.isdigit() for c in m[0]) * 10 >= len(m[0]) else m[0]
    return (sorted({w for start, end in candidates(text) for w in IDENTIFIER.findall(CANDIDATE.sub(plain, text[max(0, start - AROUND):end + AROUND]))}),)


def identifier_dictionary(docs: DataFrame, text: str, entries: int) -> bytes:
    """The `entries` identifiers found in the contexts of most texts, the most common last, as zstandard likes it.

    Counted over all rows with map-side sums; only the top list, of fixed length, reaches the driver."""
    words = map_texts(docs, [], text, "words array<string>", lambda: identifier_words).select(F.explode("words").alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(entries).collect()
    return b" ".join(r["word"].encode() for r in reversed(top))


def novelty(primer: bytes) -> Callable[[str, int, int], float]:
    """Marginal compressed bytes of text[start:end] between its surroundings, per character."""
    primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer) >= 8 else None
    packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)

    def score(text: str, start: int, end: int) -> float:
        before, after = surroundings(text, start, end)
        without = len(packer.compress((before + after).encode()))
        return (len(packer.compress((before + text[start:end] + after).encode())) - without) / (end - start)

    return score


def scanner(primer: bytes, least: float) -> Callable[[str], tuple]:
    score = novelty(primer)

    def scan(text: str) -> tuple:
        base = base_spans(text)
        novel = [("novel", s, e) for s, e in candidates(text) if score(text, s, e) >= least]
        spans = sorted(base + novel, key=lambda s: (s[1], KINDS.index(s[0])))
        as_rows = lambda found: [{"kind": k, "start": s, "end": e} for k, s, e in found]
        return as_rows(base), as_rows(spans), redact(text, spans)

    return scan


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced."""
    parts, done = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= done:
            parts += [text[done:start], REDACTED]
        done = max(done, end)
    return "".join(parts) + text[done:]


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text", least: float = 0.5, entries: int = 4096) -> DataFrame:
    """`keep`, `base` and all `spans` (kind, start, end in code points, end exclusive), and the `redacted` text.

    A candidate is reported as `novel` when it adds at least `least` bytes per character. Null and empty texts have no
    spans; the redacted text of a null is empty. Rows are judged alone but for the identifier dictionary (at most `entries`
    words, ties by word), so repeated rows get equal results. Other columns are not read. An empty table gives no rows. Two
    scans, and a shuffle of identifiers near candidates only."""
    primer = identifier_dictionary(docs, text, entries)
    return map_texts(docs, keep, text, OUT, lambda: scanner(primer, least))
