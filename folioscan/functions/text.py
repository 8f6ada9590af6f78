"""Text expressions. Every function takes and returns a Column, so the work stays in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and markers that decide results.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # the same, as a pattern
CJK = r"\x{4e00}-\x{9fff}"
SPACES_PATTERN = r"[,，、;；\s]+"  # between aliases
TOKEN_PATTERN = rf"[{CJK}]+|[a-zA-Z0-9_]+"
ANALYSIS_MARKERS = ("## 分析提炼", "### 核心要点", "### 可引用事实")
BOOST_MARKERS = ("分析提炼", "### 核心要点")
SENTENCE_END = rf"(?<=[。！？!?；;]){BLANK}*|\n+"
QUESTION_WORDS = r"(?i)^(请问|请|什么是|是什么|如何|怎么|为什么|为何)\s*"
UNTITLED = "untitled"


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value) -> Column:
    """Trim all Unicode blanks; touches the ends only, unlike a regular expression."""
    return F.btrim(col(value), F.lit(BLANKS))


def squeeze(value) -> Column:
    """Every run of blanks becomes one space, none at the ends."""
    spaced = F.translate(col(value), BLANKS, " " * len(BLANKS))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def replace(value, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(col(value), pattern, by)


def lines_of(value) -> Column:
    return F.split(F.regexp_replace(col(value), r"\r\n?", "\n"), "\n")


def normalize_text(value) -> Column:
    return strip(replace(replace(value, r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def tokenize(value) -> Column:
    """Words and CJK runs; a CJK run of two or more also gives its bigrams, so a two-character run appears twice."""
    runs = tokenize_plain(value)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    paired = F.flatten(F.transform(runs, lambda r: F.when(
        r.rlike(rf"^[{CJK}]{{2,}}\z"), F.concat(F.array(r), pairs(r))).otherwise(F.array(r))))
    return F.when(col(value).rlike(rf"[{CJK}]{{2}}"), paired).otherwise(runs)


def tokenize_plain(value) -> Column:
    return F.regexp_extract_all(F.lower(col(value)), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def context_prefix(title, piece) -> Column:
    heading = strip(F.regexp_extract(col(piece), r"^【(.+?)】\n", 1))
    title = strip(F.coalesce(col(title), F.lit("")))
    return F.when((heading != "") & (title != ""), F.concat(title, F.lit(" > "), heading)).otherwise(
        F.when(title != "", title).otherwise(heading))


def embed_input(prefix, text) -> Column:
    clean = strip(F.coalesce(col(prefix), F.lit("")))
    return F.when(clean != "", F.concat(clean, F.lit("\n"), col(text))).otherwise(col(text))


def text_hash(value, length: int = 24) -> Column:
    return F.substring(F.sha2(col(value), 256), 1, length)


# Markdown marks and what takes their place, in this order.
MARKDOWN_MARKS = (
    (r"(?s)```.*?```", " "), (r"`[^`]+`", " "), (r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (rf"(?md)^#{{1,6}}{BLANK}+", ""), (rf"(?md)^>{BLANK}?", ""), (rf"(?md)^{BLANK}*[-*+]{BLANK}+", ""), (rf"(?md)^{BLANK}*\d+\.{BLANK}+", ""),
    (r"\|", " "), (r"-{3,}", " "),
)


def strip_markdown(value) -> Column:
    out = col(value)
    for pattern, by in MARKDOWN_MARKS:
        out = F.regexp_replace(out, pattern, by)
    return squeeze(out)


def split_sentences(value) -> Column:
    return F.filter(F.transform(F.split(col(value), SENTENCE_END), strip), lambda s: F.length(s) >= 4)


def hashtags(value) -> Column:
    pattern = r"(?m)(?:\A|[\s(（])#([\p{L}\p{M}\p{N}_-]+)"
    return F.array_distinct(F.regexp_extract_all(col(value), F.lit(pattern), F.lit(1)))


def slugify(value, size: int = 80) -> Column:
    clean = F.replace(squeeze(replace(value, r'[<>:"/\\|?*]')), F.lit(" "), F.lit("-"))
    cut = F.substring(clean, 1, size)
    return F.when(cut == "", UNTITLED).otherwise(cut)


# What ends an address in running text, and the marks that a bare question drops.
URL_PATTERN = r"https?://[^\s\)\]\"']+"
QUESTION_MARKS = r"[？?。！!；;，,、\s]+"


def first_url(value) -> Column:
    return F.regexp_extract(col(value), URL_PATTERN, 0)


def first_line_title(value, default: str = "粘贴文本") -> Column:
    lines = F.filter(F.transform(lines_of(value), strip), lambda s: s != "")
    title = F.substring(F.regexp_replace(F.get(lines, F.lit(0)), r"^#+\s*", ""), 1, 80)
    return F.coalesce(title, F.lit(default))


def page_title(meta_title, body, stem) -> Column:
    heads = F.filter(F.transform(lines_of(body), strip), lambda s: s.startswith("# "))
    meta = F.when(col(meta_title) != "", col(meta_title))
    return F.coalesce(meta, strip(F.substring(F.get(heads, F.lit(0)), 3, 1 << 30)), col(stem))


# Words that suggest a page type, tested in this order.
CONCEPT_WORDS = ("原理", "方法", "流程", "架构", "闭环")
ENTITY_WORDS = ("工具", "产品", "平台", "接口")


def contains_any(value, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | col(value).contains(word)
    return out


def guess_type(text, name, comparison_word: str = "对比", concept_words=CONCEPT_WORDS, entity_words=ENTITY_WORDS,
               opening: tuple[int, int] | None = None) -> Column:
    """Page type by what its text and name hold; `opening` keeps the comparison word and the link to so many first characters."""
    cut = (lambda i: F.substring(col(text), 1, opening[i])) if opening else (lambda i: col(text))
    low = F.lower(F.concat(col(text), col(name)))
    return (F.when(low.contains(" vs ") | cut(0).contains(comparison_word), "comparison")
            .when(cut(1).rlike("https?://"), "source")
            .when(contains_any(low, concept_words), "concept")
            .when(contains_any(low, entity_words), "entity").otherwise("note"))


def page_hint(text) -> Column:
    """Number of the first page or slide marker; NULL when absent or zero."""
    found = F.regexp_extract(col(text), r"(?i)---\s*(?:第(\d+)页|幻灯片\s*(\d+))\s*---", 0)
    n = F.regexp_extract(found, r"(\d+)", 1).try_cast("int")
    return F.when(n > 0, n)


def slide_hint(text) -> Column:
    return F.regexp_extract(col(text), r"(?i)---\s*幻灯片\s*(\d+)\s*---", 1).try_cast("int")


def source_label(page, slide) -> Column:
    return (F.when(col(page) > 0, F.format_string("第 %d 页", col(page)))
            .when(col(slide) > 0, F.format_string("幻灯片 %d", col(slide))).otherwise("打开原文"))


def memo_date(stamp) -> Column:
    raw = strip(stamp)
    return F.when(F.length(raw) >= 10, F.substring(raw, 1, 10)).otherwise("")


def memo_time(stamp) -> Column:
    raw = strip(stamp)
    return F.when(F.length(raw) >= 16, F.substring(raw, 12, 5)).otherwise("")


def query_variants(text, extra=None, limit: int = 6) -> Column:
    """The query, then cleaner forms of it, then extra texts: distinct, in order, at most `limit`."""
    q = strip(text)
    bare = strip(replace(q, QUESTION_MARKS, " "))
    words = F.regexp_extract_all(q, F.lit(rf"([{CJK}]{{2,}}|[A-Za-z0-9_]{{3,}})"), F.lit(1))
    keywords = F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 8), " "))
    forms = F.array(q, bare, replace(bare, QUESTION_WORDS), keywords)
    if extra is not None:
        forms = F.concat(forms, F.coalesce(col(extra), F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(forms, lambda s: s.isNotNull() & (s != ""))), 1, limit)


def is_analysis_chunk(text, markers=ANALYSIS_MARKERS) -> Column:
    return contains_any(text, markers)


def excerpt(text, size: int = 400) -> Column:
    """Body lines joined by spaces until they pass `size`, then cut and marked."""
    lines = F.filter(F.transform(lines_of(text), strip),
                     lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("来源:"))
    joined = F.array_join(lines, " ")
    cut = F.when(F.length(joined) > size, F.concat(F.substring(joined, 1, size), F.lit("…"))).otherwise(joined)
    return F.when(cut == "", "（无摘要）").otherwise(cut)


def section_items(body, heading: str, limit: int, skip_headings: bool = True) -> Column:
    """Bullet texts under a level-3 heading, up to the next heading of level 1 to 3."""
    block = F.regexp_extract(col(body), rf"(?ms)^###\s*{heading}[ \t]*$(.*?)(?=^#{{1,3}}\s+|\z)", 1)
    items = F.transform(lines_of(block), lambda s: strip(replace(strip(s), r"^[-•* ]+")))
    keep = (lambda s: (s != "") & ~s.startswith("#")) if skip_headings else (lambda s: s != "")
    return F.slice(F.filter(items, keep), 1, limit)


def normalize_items(value, limit: int = 12) -> Column:
    """Split on semicolons and newlines, drop bullet marks, keep the first distinct items."""
    items = F.transform(F.split(col(value), "[;；\n]"), lambda s: replace(strip(s), r"^[-•* ]+|[-•* ]+\z"))
    return F.slice(F.array_distinct(F.filter(items, lambda s: s != "")), 1, limit)


def merge_tags(first, second, limit: int = 12) -> Column:
    clean = F.filter(F.transform(col(first), strip), lambda s: s != "")
    more = F.filter(col(second), lambda s: s != "")
    return F.slice(F.array_distinct(F.concat(clean, more)), 1, limit)


def squash_distance(score) -> Column:
    s = col(score)
    return F.when(s > 1, F.least(F.lit(1.0), 1.0 / (1.0 + s))).otherwise(s)


def version_key(value) -> Column:
    """Three comparable numbers of a dotted version; zeros where absent."""
    raw = strip(value)
    part = lambda i: F.coalesce(
        F.nullif(F.regexp_extract(raw, r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?", i), F.lit("")), F.lit("0")).cast("int")
    return F.array(part(1), part(2), part(3))


def is_markdown_table(block) -> Column:
    """At least two lines with a pipe, and at least half of the lines. Text without a pipe is settled first."""
    lines = F.filter(F.split(col(block), r"\r?\n"), lambda s: strip(s) != "")
    pipes = F.size(F.filter(lines, lambda s: s.contains("|")))
    return F.when(~col(block).contains("|"), False).otherwise(
        (pipes >= 2) & (pipes >= F.greatest(F.lit(2), F.floor(F.size(lines) / 2))))


def is_html_table(block) -> Column:
    low = F.lower(col(block))
    return F.when(~col(block).contains("<"), False).otherwise(
        low.contains("<table") & low.contains("</table>")
        & (low.contains("<tr") | low.contains("<th") | low.contains("<td")))


def is_table_block(block) -> Column:
    return is_markdown_table(block) | is_html_table(block)


def normalize_path(value) -> Column:
    return F.regexp_replace(strip(F.replace(col(value), F.lit("\\"), F.lit("/"))), r"^/+", "")


def base_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))
