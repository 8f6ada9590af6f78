"""Document text to chunk rows.

A document becomes an array of chunks inside its own row (sections, then paragraphs, then windows), and one
`posexplode` gives ordinals. Nothing is shuffled, so documents can be chunked wherever they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    BLANK, col, context_prefix, is_html_table, is_markdown_table, is_table_block, let, lines_of, normalize_text, squeeze, strip, tokenize,
)

# What is a heading, and the rule line under a table's header.
HEADING = rf"(?md)^#{{1,4}}{BLANK}+(.+)$"
TABLE_RULE = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
HELD, TABLE = "\u0001", "\u0002"
WINDOW_GROUP = 16  # windows that are cut from one piece of the text: a character is found by counting from the start
STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(STRINGS)


def section_array(text) -> Column:
    """(heading, body) of each part between level 1 to 4 headings; text before the first has an empty heading."""
    parts = F.split(normalize_text(text), rf"(?md)(?=^#{{1,4}}{BLANK}+.+$)")
    pairs = F.transform(parts, lambda p: F.when(
        p.rlike(rf"^#{{1,4}}{BLANK}+\S"),
        F.struct(strip(F.regexp_extract(p, HEADING, 1)).alias("heading"),
                 strip(F.regexp_replace(p, rf"(?d)^#{{1,4}}{BLANK}+.+", "")).alias("body"))
    ).otherwise(F.struct(F.lit("").alias("heading"), strip(p).alias("body"))))
    return F.filter(pairs, lambda s: s["body"] != "")


def split_sections(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(section_array(text)).alias("ord", "section")).select(
        *keys, "ord", "section.heading", "section.body")


def paragraph_array(body) -> Column:
    """Blank-line separated parts; an HTML table stays whole."""
    marked = F.regexp_replace(col(body), r"(?is)(<table\b.*?</table>)", f"{HELD}{TABLE}$1{HELD}")
    parts = F.flatten(F.transform(F.split(marked, HELD), lambda p: F.when(
        p.startswith(TABLE), F.array(F.substring(p, 2, 1 << 30))).otherwise(F.split(p, rf"\n{BLANK}*\n"))))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def merged_array(parts: Column, min_len: int) -> Column:
    """Join a short part with the next while both are plain text and the result stays small."""
    def step(acc: Column, part: Column) -> Column:
        joins = ((F.length(acc["buf"]) < min_len)
                 & (F.length(acc["buf"]) + F.length(part) + 2 <= min_len * 3)
                 & ~is_table_block(acc["buf"]) & ~is_table_block(part))
        return (F.when(acc["buf"] == "", F.struct(acc["out"].alias("out"), part.alias("buf")))
                .when(joins, F.struct(acc["out"].alias("out"), F.concat(acc["buf"], F.lit("\n\n"), part).alias("buf")))
                .otherwise(F.struct(F.array_append(acc["out"], acc["buf"]).alias("out"), part.alias("buf"))))

    start = F.struct(no_strings().alias("out"), F.lit("").alias("buf"))
    return F.aggregate(parts, start, step,
                       lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.array_append(a["out"], a["buf"])))


def _pack(rows: Column, size: Column | int, wrap: Callable[[Column], Column], glue: str) -> Column:
    """Fill blocks row by row up to `size`, each block wrapped with its header; a row is never cut."""
    def step(acc: Column, row: Column) -> Column:
        wider = F.when(acc["n"] == 0, row).otherwise(F.concat(acc["buf"], F.lit(glue), row))
        full = (acc["n"] > 0) & (F.length(wrap(wider)) > size)
        flushed = F.array_append(acc["out"], strip(wrap(acc["buf"])))
        return (F.when(~full, F.struct(acc["out"].alias("out"), wider.alias("buf"), (acc["n"] + 1).alias("n")))
                .when(F.length(wrap(row)) > size, F.struct(F.array_append(flushed, strip(wrap(row))).alias("out"),
                                                           F.lit("").alias("buf"), F.lit(0).alias("n")))
                .otherwise(F.struct(flushed.alias("out"), row.alias("buf"), F.lit(1).alias("n"))))

    start = F.struct(no_strings().alias("out"), F.lit("").alias("buf"), F.lit(0).alias("n"))
    return F.aggregate(rows, start, step, lambda a: F.when(a["n"] == 0, a["out"]).otherwise(
        F.array_append(a["out"], strip(wrap(a["buf"])))))


def md_table_array(text, size: Column | int) -> Column:
    """Split a Markdown table between rows, repeating the header and its rule on every piece."""
    def split(lines: Column) -> Column:
        ruled = (F.size(lines) >= 2) & strip(F.get(lines, F.lit(1))).rlike(TABLE_RULE)
        n = F.when(ruled, 2).otherwise(1)
        head = F.array_join(F.slice(lines, F.lit(1), n), "\n")
        body = F.slice(lines, n + 1, F.greatest(F.lit(0), F.size(lines) - n))
        return F.when(F.size(body) == 0, F.array(head)).otherwise(
            let(head, lambda h: _pack(body, size, lambda rows: F.concat(h, F.lit("\n"), rows), "\n")))

    lines = F.filter(lines_of(text), lambda s: strip(s) != "")
    return F.when(F.length(col(text)) <= size, F.array(strip(text))).otherwise(let(lines, split))


def html_table_array(text, size: Column | int) -> Column:
    """Split an HTML table between `<tr>` rows, repeating the first row on every piece."""
    whole = strip(text)
    rows = F.regexp_extract_all(whole, F.lit(r"(?is)(<tr\b.*?</tr>)"), F.lit(1))
    tag = F.regexp_extract(whole, r"(?i)(<table\b[^>]*>)", 1)
    opening = F.when(tag == "", "<table>").otherwise(tag)

    def split(found: Column) -> Column:
        head = F.concat(opening, F.get(found, F.lit(0)))
        body = F.slice(found, F.lit(2), F.size(found) - 1)
        return let(head, lambda h: _pack(body, size, lambda r: F.concat(h, r, F.lit("</table>")), ""))

    return F.when(F.length(whole) <= size, F.array(whole)).otherwise(
        let(rows, lambda found: F.when(F.size(found) < 2, F.array(whole)).otherwise(split(found))))


def plain_windows(text, size: int, overlap: int) -> Column:
    """Fixed windows over squeezed text; each starts size - overlap after the one before, the last ends at the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap

    def grouped(flat: Column, last: Column) -> Column:
        def group(g: Column) -> Column:
            first = g * WINDOW_GROUP
            return let(F.substring(flat, first * step + 1, F.lit(WINDOW_GROUP * step + overlap)), lambda piece: F.transform(
                F.sequence(F.lit(0), F.least(last - first, F.lit(WINDOW_GROUP - 1))), lambda i: F.substring(piece, i * step + 1, F.lit(size))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(last / WINDOW_GROUP).cast("int")), group))

    def cut(flat: Column) -> Column:
        last = F.when(F.length(flat) <= size, 0).otherwise(F.ceil((F.length(flat) - size) / step)).cast("int")
        return F.when(flat == "", no_strings()).otherwise(let(last, lambda n: grouped(flat, n)))

    return let(squeeze(text), cut)


def window_array(text, size: int, overlap: int) -> Column:
    return (F.when(is_html_table(text), html_table_array(text, size))
            .when(is_markdown_table(text), md_table_array(text, size))
            .otherwise(plain_windows(text, size, overlap)))


def window_chunks(docs: DataFrame, keys: list[str], text: str, size: int = 480, overlap: int = 80) -> DataFrame:
    # posexplode_outer: plain posexplode adds a size test that would squeeze and cut every text twice.
    return docs.select(*keys, F.posexplode_outer(plain_windows(text, size, overlap)).alias("ord", "text")).where(F.col("text").isNotNull())


def document_array(text, title=None, size: int = 480, overlap: int = 80) -> Column:
    """All chunks of one document: headings become a prefix, small paragraphs merge, tables split by row."""
    min_para = max(120, size // 4)

    def pieces(section: Column) -> Column:
        prefix = F.when(section["heading"] == "", "").otherwise(F.concat(F.lit("【"), section["heading"], F.lit("】\n")))

        def one(prefix: Column) -> Column:
            room = F.greatest(F.lit(80), F.lit(size) - F.length(prefix))
            paras = merged_array(paragraph_array(section["body"]), min_para)
            return F.flatten(F.transform(paras, lambda p: (
                F.when(is_html_table(p), F.transform(html_table_array(p, room), lambda t: F.concat(prefix, t)))
                .when(is_markdown_table(p), F.transform(md_table_array(p, room), lambda t, i: F.when(
                    i == 0, strip(F.concat(prefix, t))).otherwise(strip(t))))
                .when(F.length(prefix) + F.length(p) <= size, F.array(strip(F.concat(prefix, p))))
                .otherwise(window_array(F.concat(prefix, p), size, overlap)))))

        return let(prefix, one)

    def whole(clean: Column) -> Column:
        titled = clean
        if title is not None:
            name = F.coalesce(col(title), F.lit(""))
            titled = F.when((clean == "") | (name == "") | F.substring(clean, 1, 80).contains(name), clean).otherwise(
                F.concat(name, F.lit("\n\n"), clean))
        return let(titled, lambda t: let(
            F.flatten(F.transform(section_array(t), pieces)),
            lambda found: F.when(F.size(found) > 0, found).when(t == "", no_strings()).otherwise(
                window_array(t, size, overlap))))

    return F.filter(let(normalize_text(text), whole), lambda p: strip(p) != "")


def chunk_documents(docs: DataFrame, keys: list[str], text: str = "text", title: str | None = None,
                    size: int = 480, overlap: int = 80) -> DataFrame:
    size, overlap = max(200, min(2000, size)), max(0, min(400, overlap))
    overlap = min(overlap, size - 1)
    return docs.select(*keys, F.posexplode(document_array(text, title, size, overlap)).alias("ord", "text"))


def chunk_parent_child(docs: DataFrame, keys: list[str], text: str = "text", title: str | None = None,
                       parent: int = 960, child: int = 320, overlap: int = 80) -> DataFrame:
    """Small chunks for matching, each with the larger chunk it was cut from."""
    child = max(120, min(child, parent))
    inner = max(0, min(overlap, child // 2))
    parents = docs.select(*keys, F.posexplode(document_array(text, title, parent, overlap)).alias("p", "parent_text"))
    cut = document_array("parent_text", None, child, inner)
    return parents.select(*keys, "p", "parent_text", F.posexplode(
        let(cut, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array("parent_text")))).alias("c", "text"))


def chunk_rows(pages: DataFrame, parent: int = 960, child: int = 320, overlap: int = 80) -> DataFrame:
    """Index rows of pages (rel_path, title, body): chunk, tokens, heading prefix and parent columns.

    Ordinals count all pieces of a page in order, including those dropped for having no token."""
    child = max(120, min(child, parent))
    inner = max(0, min(overlap, child // 2))
    full = F.when(F.coalesce("title", F.lit("")) == "", F.col("body")).when(
        F.substring("body", 1, 50).contains(F.col("title")), F.col("body")).otherwise(
        F.concat("title", F.lit("\n"), "body"))
    family = F.transform(document_array(full, "title", parent, overlap), lambda p, i: let(
        document_array(p, None, child, inner),
        lambda c: F.transform(F.when(F.size(c) > 0, c).otherwise(F.array(p)), lambda t: F.struct(
            strip(t).alias("text"), strip(p).alias("parent_text"), i.alias("p")))))
    keep = [c for c in pages.columns if c not in ("title", "body")]
    rows = pages.select(*keep, "title", F.posexplode(F.flatten(family)).alias("ord", "piece"))
    return rows.select(
        F.concat("rel_path", F.lit("#"), F.col("ord").cast("string")).alias("chunk_id"), *keep, "title",
        F.col("ord").cast("bigint").alias("ord"), F.col("piece.text").alias("text"), tokenize("piece.text").alias("tokens"),
        F.when(F.col("piece.parent_text") != F.col("piece.text"), F.col("piece.parent_text")).alias("parent_text"),
        F.concat("rel_path", F.lit("#p"), F.col("piece.p").cast("string")).alias("parent_id"),
        context_prefix("title", "piece.text").alias("context_prefix"),
    ).where(F.size("tokens") > 0)


def pack_sentences(text, limit: int = 500) -> Column:
    """Whole sentences packed up to `limit`; sentence marks are kept."""
    flat = squeeze(text)
    marked = F.regexp_replace(flat, r"([。！？!?；;])", f"{HELD}$1{HELD}")

    def step(acc: Column, seg: Column) -> Column:
        wider = F.concat(acc["buf"], seg)
        full = (F.length(wider) > limit) & (acc["buf"] != "")
        return F.when(full, F.struct(F.array_append(acc["out"], strip(acc["buf"])).alias("out"), seg.alias("buf"))
                      ).otherwise(F.struct(acc["out"].alias("out"), wider.alias("buf")))

    segments = F.filter(F.split(marked, HELD), lambda s: s != "")
    packed = F.aggregate(segments, F.struct(no_strings().alias("out"), F.lit("").alias("buf")), step,
                         lambda a: F.when(strip(a["buf"]) == "", a["out"]).otherwise(
                             F.array_append(a["out"], strip(a["buf"]))))
    return F.when(F.length(flat) <= limit, F.array(flat)).otherwise(packed)
