"""Page, asset, folder and scope operators, and corpus health reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    BLANK, base_name, extension, is_markdown_table, let, lines_of, memo_date, normalize_path, section_items,
    split_sentences, strip,
)
from .chunking import document_array
from .graph import CONTENT_DIRS
from .search import containing
from .sequences import first_rows, id_block, running, top_rows

# What counts as content, which files are read and how they are labelled.
HIDDEN_DIRS = ("inbox-processed", ".extracted")
CATEGORIES = {
    "documents": (".pdf", ".ppt", ".pptx", ".xls", ".xlsx", ".doc", ".docx", ".txt", ".md"),
    "images": (".png", ".jpg", ".jpeg"),
    "audio": (".mp3",),
    "video": (".mp4",),
}
MIME = {
    ".pdf": "application/pdf",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".mp3": "audio/mpeg",
    ".mp4": "video/mp4",
}
EXTERNAL = "@external:"
UNTAGGED = "(无标签)"


def top_dir(path="rel_path") -> Column:
    return F.split(F.col(path), "/")[0]


def supported(path) -> Column:
    return extension(path).isin(*MIME)


def category(path) -> Column:
    ext = extension(path)
    out = F.lit("documents")
    for name, exts in CATEGORIES.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def mime(path) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))


def watchable(path="path") -> Column:
    """Files a watcher picks up: supported, outside processed folders, not an index file."""
    parts = F.split(F.col(path), "/")
    hidden = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in HIDDEN_DIRS]))
    index_file = (extension(path) == ".json") & F.array_contains(parts, ".rag")
    return ~hidden & (base_name(path) != "manifest.json") & ~index_file & supported(path)


def filter_pages(pages: DataFrame, type_: str | None = None, status: str | None = None) -> DataFrame:
    if type_:
        pages = pages.where(F.col("type") == type_)
    return pages.where(F.col("status") == status) if status else pages


def chunk_page_asset(chunks: DataFrame, pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Chunk with its page and original file: the chunk's own asset, then the page's, then the asset naming the page."""
    page = pages.select("rel_path", F.col("asset_path").alias("page_asset"), F.col("tags").alias("page_tags"),
                        F.col("rel_path").alias("wiki_page"))
    owner = assets.where(F.col("wiki_page") != "").groupBy(F.col("wiki_page").alias("rel_path")).agg(
        F.max("rel_path").alias("owner_asset"))
    named = assets.select(F.col("rel_path").alias("asset_path"), F.col("filename").alias("asset_filename"))
    blank = F.lit("")
    joined = (chunks.withColumnRenamed("asset_path", "own_asset").withColumnRenamed("tags", "own_tags")
              .join(page, "rel_path", "left").join(owner, "rel_path", "left"))
    path = F.coalesce(F.nullif("own_asset", blank), F.nullif("page_asset", blank), "owner_asset", blank)
    tags = F.when(F.size(F.coalesce("own_tags", F.array().cast("array<string>"))) > 0, F.col("own_tags")).otherwise(
        F.coalesce("page_tags", F.array().cast("array<string>")))
    rows = joined.select("chunk_id", "rel_path", "title", "text", F.coalesce("wiki_page", blank).alias("wiki_page"),
                         path.alias("asset_path"), tags.alias("tags"))
    return rows.join(named, "asset_path", "left").withColumn("asset_filename", F.coalesce("asset_filename", blank))


def search_library(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of every row whose title, text, paths, file name or tags hold the query, ignoring case.

    One scan of the rows for any number of queries."""
    hay = F.lower(F.concat_ws(" ", "title", "text", "rel_path", "asset_path", "asset_filename", F.array_join("tags", " ")))
    asked = queries.select("query_id", F.lower(strip("q")).alias("q"))
    return containing(rows.select("chunk_id", "rel_path", hay.alias("hay")), "hay", asked, ["chunk_id", "rel_path"]).select(
        "query_id", "chunk_id", "rel_path")


def _suffixes(path: Column) -> Column:
    """What follows each slash of a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))


def _prefixes(path: Column) -> Column:
    """What stands before each slash of a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def _keys(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))


def scope_filter(chunks: DataFrame, scope: DataFrame) -> DataFrame:
    """(scope_id, chunk_id) pairs inside each scope path.

    Every way a path can match (same, suffix, prefix, base name, title) becomes an equality on derived keys, so no
    nested loop is needed: the chunk lists the suffixes and prefixes of its paths, the scope those of its own."""
    s = normalize_path("path")
    base = base_name(s)
    wanted = scope.where(s != "").select("scope_id", F.explode(F.array_distinct(F.concat(
        _keys("path", F.array(s)), _keys("inside", _suffixes(s)), _keys("base", F.array(base)),
        _keys("title", F.array(base)),
        F.when(s.startswith(EXTERNAL), _keys("path", F.array(F.regexp_replace(s, "/+$", "")))).otherwise(
            F.filter(_keys("path", F.array(s)), lambda x: F.lit(False)))))).alias("k"))
    wanted = wanted.where("k.key <> ''").select("scope_id", "k.kind", "k.key").distinct()

    def path_keys(path: Column) -> Column:
        folders = F.when(path.contains("/"), F.array(base_name(path))).otherwise(F.array().cast("array<string>"))
        return F.concat(_keys("path", F.concat(F.array(path), _suffixes(path), _prefixes(path))),
                        _keys("inside", F.array(path)), _keys("base", folders))

    rel, asset = normalize_path("rel_path"), normalize_path(F.coalesce("asset_path", F.lit("")))
    mine = F.array_distinct(F.concat(
        path_keys(rel), F.filter(path_keys(asset), lambda k: asset != ""),
        _keys("title", F.array(strip(F.coalesce("title", F.lit("")))))))
    rows = chunks.select("chunk_id", F.explode(mine).alias("k")).select("chunk_id", "k.kind", "k.key")
    return rows.join(wanted, ["kind", "key"]).select("scope_id", "chunk_id").distinct()


def expand_scope(scope: DataFrame, pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Scope paths plus the page of each listed asset and the asset of each listed page."""
    base = scope.select("scope_id", normalize_path("path").alias("path")).where("path <> ''")
    linked = assets.where("wiki_page <> ''")
    legs = [
        base.join(linked.select(F.col("rel_path").alias("path"), normalize_path("wiki_page").alias("other")), "path"),
        base.join(pages.where("asset_path <> ''").select(F.col("rel_path").alias("path"), normalize_path("asset_path").alias("other")), "path"),
        base.join(linked.select(F.col("wiki_page").alias("path"), normalize_path("rel_path").alias("other")), "path"),
    ]
    more = [leg.select("scope_id", F.col("other").alias("path")) for leg in legs]
    return reduce(DataFrame.unionByName, [base, *more]).distinct()


def folder_scope(wanted: list[str], pages: DataFrame, assets: DataFrame, dirs: DataFrame) -> DataFrame:
    """Paths of pages, assets (with their pages) and linked folders that carry one of the folder ids."""
    ids = F.array(*[F.lit(i) for i in wanted]) if wanted else F.array().cast("array<string>")
    has = lambda df: df.where(F.arrays_overlap("folder_ids", ids))
    clean = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    return reduce(DataFrame.union, [
        has(pages).select(clean(F.col("rel_path")).alias("path")),
        has(assets).select(clean(F.col("rel_path"))),
        has(assets).where("wiki_page <> ''").select(clean(F.col("wiki_page"))),
        has(dirs).where(strip("path") != "").select(F.concat(F.lit(EXTERNAL), clean(F.col("path")))),
    ]).distinct()


def scope_union(paths: DataFrame, folder_paths: DataFrame) -> DataFrame:
    return paths.select("path").union(folder_paths.select("path")).where(strip("path") != "").distinct()


def normalize_folder_ids(ids, valid) -> Column:
    """Known ids in their first-seen order; both sides are arrays."""
    clean = F.array_distinct(F.filter(F.transform(F.col(ids), strip), lambda x: x != ""))
    return F.filter(clean, lambda x: F.array_contains(valid, x))


def external_chunks(chunks: DataFrame, dirs: DataFrame, q: str = "") -> DataFrame:
    """Chunks of linked folders whose title or path holds `q`, with the longest registered root that leads their path."""
    rows = chunks.where(F.col("rel_path").startswith(EXTERNAL))
    title = F.coalesce(F.nullif("title", F.lit("")), "rel_path")
    low = q.strip().lower()
    if low:
        rows = rows.where(F.lower(title).contains(low) | F.lower("rel_path").contains(low))
    keyed = rows.select("chunk_id", "rel_path", title.alias("title"), F.substring("text", 1, 200).alias("preview"),
                        F.explode_outer(_prefixes(F.substring("rel_path", len(EXTERNAL) + 1, 1 << 30))).alias("root"))
    roots = dirs.select(F.regexp_replace("path", "/+$", "").alias("root"), F.col("path").alias("external_path"))
    found = keyed.join(roots, "root", "left")
    return found.groupBy("chunk_id", "rel_path", "title", "preview").agg(
        F.coalesce(F.max_by("external_path", F.length("external_path")), F.lit("")).alias("external_path"))


def is_flash_memo(path="rel_path") -> Column:
    name = F.lower(base_name(F.col(path)))
    return F.coalesce("memo", F.lit(False)) | (name.startswith("memo-") & name.endswith(".md"))


def memo_timeline(pages: DataFrame, date: str = "", tag: str = "", flash_only: bool = True) -> DataFrame:
    stamp = F.coalesce(F.nullif("updated", F.lit("")), "created")
    rows = pages.where(top_dir() == "notes")
    if flash_only:
        rows = rows.where(is_flash_memo())
    if date:
        rows = rows.where(memo_date(stamp) == date.strip()[:10])
    if tag:
        name = tag.strip().lstrip("#")
        rows = rows.where(F.array_contains("tags", name) | F.col("body").contains(f"#{name}"))
    return rows.withColumn("date_key", memo_date(stamp))


def memo_time_of() -> Column:
    """Seconds of a memo's time; both formats are read and an unreadable time counts as zero."""
    stamp = strip(F.coalesce(F.nullif("updated", F.lit("")), "created"))
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm"))),
                      F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd"))), F.lit(0))


def memo_order() -> list[Column]:
    """Pinned first, then newest, then by path."""
    return [F.desc(F.coalesce("pinned", F.lit(False))), memo_time_of().desc(), F.asc("rel_path")]


def memo_key() -> Column:
    """A struct that sorts as `memo_order`."""
    return F.struct((~F.coalesce("pinned", F.lit(False))).alias("a"), (-memo_time_of()).alias("b"), F.col("rel_path").alias("c"))


def recent_pages(pages: DataFrame, limit: int = 20) -> DataFrame:
    when = F.coalesce(F.nullif("updated", F.lit("")), F.nullif("created", F.lit("")), F.lit("1970-01-01"))
    return (pages.where(top_dir() != "inbox").withColumn("changed", when)
            .orderBy(F.desc("changed"), "rel_path").limit(limit))


def page_stats(pages: DataFrame) -> DataFrame:
    """Counts by type, status and folder, and in all, in one pass."""
    rows = pages.where(top_dir() != "inbox").select("type", "status", top_dir().alias("dir"))
    grouped = rows.groupingSets([(), ("type",), ("status",), ("dir",)], "type", "status", "dir").agg(
        F.count("*").alias("pages"), F.grouping("type").alias("a"), F.grouping("status").alias("b"), F.grouping("dir").alias("c"))
    level = F.when(F.col("a") == 0, "type").when(F.col("b") == 0, "status").when(F.col("c") == 0, "dir").otherwise("all")
    return grouped.select(level.alias("level"), F.coalesce("type", "status", "dir", F.lit("")).alias("key"), "pages")


def tag_index(pages: DataFrame) -> DataFrame:
    """One row per (tag, page) with the page count of the tag; untagged pages under their own heading.

    Rows, not lists: a tag may cover a large part of the corpus. Sort by tag and title to print."""
    rows = pages.where(top_dir() != "inbox").select(
        F.explode(F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit(UNTAGGED)))).alias("tag"),
        "rel_path", "title", "type", "status")
    return rows.join(rows.groupBy("tag").agg(F.count("*").alias("tag_pages")), "tag")


def distinct_tags(pages: DataFrame) -> DataFrame:
    """Tags in order of their first page (by path) and place on it."""
    rows = pages.select("rel_path", F.posexplode("tags").alias("at", "tag")).where("tag <> ''")
    return rows.groupBy("tag").agg(F.min(F.struct("rel_path", "at")).alias("first")).select(
        "tag", F.col("first.rel_path").alias("rel_path"), F.col("first.at").alias("at"))


def draft_summary(pages: DataFrame, limit: int = 30) -> DataFrame:
    """The first drafts by path, each row carrying the totals."""
    drafts = pages.where((F.col("status") == "draft") & (top_dir() != "inbox"))
    totals = drafts.agg(F.count("*").alias("n"), F.count_if(F.size("links") == 0).alias("m"))
    return (drafts.select("rel_path", "title", "type", F.size("links").alias("links_count"))
            .orderBy("rel_path").limit(limit)
            .select("*", totals.select("n").scalar().alias("draft_total"), totals.select("m").scalar().alias("no_links_total")))


# The issues that are reported of extracted text.
LONE_BAR, CUT_CELL = "疑似表行被切断（管道符不成对）", "疑似表单元格被截断"
TOO_SHORT, TABLE_LOST = "提取文本过短，可能解析失败或扫描件未 OCR", "原文提及表格但未见 Markdown 表结构"


def parse_quality(docs: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Signals and issues of extracted text: too short, broken or cut table rows, tables lost in extraction."""
    body = F.coalesce(F.col(text), F.lit(""))
    pieces = document_array(body, name, 480, 80)

    def bad_row(line: Column) -> Column:
        s = strip(line)
        rule = (s == "") | s.startswith("|---") | s.rlike(r"^[|\-: ]*$")
        lone = (F.regexp_count(s, F.lit(r"\|")) < 2) & s.startswith("|")
        cut = s.rlike(r"\|[^|\n]*$") & ~s.endswith("|")
        return F.when(rule, 0).when(lone, 1).when(cut, 2).otherwise(0)

    def first_fault(piece: Column) -> Column:
        faults = F.filter(F.transform(lines_of(piece), bad_row), lambda n: n > 0)
        return F.coalesce(F.get(faults, F.lit(0)), F.lit(0))

    rows = docs.select(*docs.columns, pieces.alias("__pieces")).withColumn(
        "__tables", F.filter("__pieces", is_markdown_table)).withColumn("__faults", F.transform("__tables", first_fault))
    has_table = body.rlike(r"(?m)第\d+页-表格|^\|.+\|") | (F.size("__tables") > 0)
    none = F.array().cast("array<string>")
    issue = lambda cond, message: F.when(cond, F.array(F.lit(message))).otherwise(none)
    issues = F.concat(
        F.transform(F.filter("__faults", lambda n: n > 0), lambda n: F.when(
            n == 1, LONE_BAR).otherwise(CUT_CELL)),
        issue(F.length(strip(body)) < 40, TOO_SHORT),
        issue(has_table & (F.size("__tables") == 0) & ~body.contains("|"), TABLE_LOST))
    return rows.select(*docs.columns, F.length(body).alias("chars"), F.size("__pieces").alias("chunks"),
                       F.size("__tables").alias("table_chunks"), has_table.alias("has_table_signal"),
                       body.rlike(r"(?i)OCR").alias("has_ocr_signal"), issues.alias("issues"))


def sentences(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(split_sentences(text)).alias("n", "sentence"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Element n // 2 of the sorted values of each group, from a histogram; no group is collected or sorted whole."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    cum = running(counts, [group], id_block(value, 4096), [value], sums={"cum": F.col("c")})
    total = counts.groupBy(group).agg(F.sum("c").alias("n"))
    return (cum.join(total, group).where(F.col("cum") > F.floor(F.col("n") / 2))
            .groupBy(group).agg(F.min(value).alias("median")))


def style_metrics(docs: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Sentence, paragraph and structure figures of each group of documents."""
    body = F.col(text)
    said = sentences(docs, [group], text).withColumn("len", F.length("sentence"))
    per_sentence = said.groupBy(group).agg(
        F.count("*").alias("sentence_count"), F.sum("len").alias("__len"),
        F.count_if(F.col("sentence").rlike("[?？]")).alias("__q"), F.count_if(F.col("sentence").rlike("[!！]")).alias("__e"))
    count = lambda pattern: F.sum(F.regexp_count(body, F.lit(pattern)))
    paras = F.size(F.filter(F.split(body, rf"\n{BLANK}*\n"), lambda p: strip(p) != ""))
    per_doc = docs.groupBy(group).agg(
        F.sum(paras).alias("paragraph_count"),
        (count(rf"(?md)^{BLANK}*[-*+]{BLANK}") + count(rf"(?md)^{BLANK}*\d+\.{BLANK}")).alias("__lists"), count(rf"(?md)^#{{1,6}}{BLANK}").alias("__heads"),
        count(r"(?md)^\|.+\|$").alias("table_row_count"),
        F.sum(F.size(F.split(F.regexp_replace(body, r"\n\z", ""), "\n"))).alias("__lines"), F.sum(F.length(body)).alias("chars"))
    rows = per_sentence.join(per_doc, group).join(upper_median(said, group, "len"), group)
    n, p = F.col("sentence_count"), F.greatest(F.col("paragraph_count"), F.lit(1))
    return rows.select(
        group, "sentence_count", F.bround(F.col("__len") / n, 1).alias("avg_sentence_len"),
        F.col("median").cast("bigint").alias("median_sentence_len"), p.alias("paragraph_count"),
        F.bround(n / p, 1).alias("avg_paragraph_sentences"),
        F.bround(F.col("__lists") / F.greatest(F.col("__lines"), F.lit(1)), 3).alias("list_line_ratio"),
        F.bround(F.col("__heads") / p, 2).alias("heading_density"), "table_row_count",
        F.bround(F.col("__q") / n, 3).alias("question_ratio"), F.bround(F.col("__e") / n, 3).alias("exclaim_ratio"), "chars")


# Connectors counted, and what may open a sentence.
CONNECTORS = ("因此", "所以", "但是", "然而", "此外", "同时", "首先", "其次", "总之", "换言之", "例如", "也就是说")
STARTER = r"^([\x{4e00}-\x{9fff}A-Za-z「『（(]{1,8})"


def top_starters(docs: DataFrame, group: str, text: str = "text", k: int = 6, first: int | None = None) -> DataFrame:
    """Most frequent openings of the sentences; `first` keeps to so many sentences of each document."""
    said = sentences(docs, [group], text)
    opened = (said if first is None else said.where(F.col("n") < first)).select(
        group, F.regexp_extract("sentence", STARTER, 1).alias("starter")).where("starter <> ''")
    counts = opened.groupBy(group, "starter").agg(F.count("*").alias("uses"))
    return top_rows(counts, [group], [F.desc("uses"), F.asc("starter")], k)


def connector_counts(docs: DataFrame, group: str, text: str = "text", words: Sequence[str] = CONNECTORS, k: int = 8) -> DataFrame:
    """Uses of each connector per group, the most frequent first, zero left out."""
    body = F.col(text)
    uses = [((F.length(body) - F.length(F.replace(body, F.lit(w), F.lit("")))) / len(w)).cast("bigint") for w in words]
    sums = docs.groupBy(group).agg(*[F.sum(u).alias(f"w{i}") for i, u in enumerate(uses)])
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("at"), F.col(f"w{i}").alias("uses")) for i, w in enumerate(words)])
    rows = sums.select(group, F.inline(pairs)).where("uses > 0")
    return top_rows(rows, [group], [F.desc("uses"), F.asc("at")], k)


def style_summary(metrics: DataFrame) -> DataFrame:
    """Plain-language reading of the style figures."""
    avg = F.col("avg_sentence_len")
    pace = F.when(avg <= 18, "短句为主、节奏紧凑").when(avg <= 32, "句长适中、叙述与说明并重").otherwise("偏长句、适合展开论述")
    said = lambda *pairs: F.array_join(F.array_compact(F.array(*[F.when(c, m) for c, m in pairs])), "；")
    structure = said((F.col("list_line_ratio") >= 0.15, "常用条目式列举"), (F.col("heading_density") >= 0.4, "小节标题分层清晰"),
                     (F.col("table_row_count") >= 3, "习惯用表格做对比或清单"))
    tone = said((F.col("question_ratio") >= 0.08, "偶用设问引导"), (F.col("exclaim_ratio") >= 0.05, "语气略带强调"))
    line = lambda head, body: F.when(body != "", F.concat(F.lit(head), body, F.lit("。")))
    first = F.concat(F.lit("句长特征："), pace, F.lit("（均句长约 "), F.format_string("%.1f", avg), F.lit(" 字）。"))
    return metrics.withColumn("summary", F.concat_ws("\n", first, line("结构习惯：", structure), line("语气习惯：", tone)))


def page_score() -> Column:
    """Worth of a page as a style sample."""
    size = F.length(strip("body"))
    base = (F.least(size / F.lit(800.0), F.lit(3.0)) + F.when(F.col("status") == "published", 1.5).otherwise(0.0)
            + F.when(F.col("type").isin("note", "concept", "comparison"), 1.0).when(F.col("type") == "source", 0.3).otherwise(0.0))
    return F.when(size < 120, 0.0).otherwise(base * F.when(F.col("rel_path").startswith("inbox/"), 0.5).otherwise(1.0))


def sample_pages(pages: DataFrame, group: str, limit: int = 18, prefix: Column | None = None) -> DataFrame:
    """Best pages of each group; after half the places only pages from prefixes not seen yet.

    Two ranked cuts: the first half by score, then the best page of every other prefix."""
    half = limit // 2
    scored = pages.withColumn("page_score", F.round(page_score(), 6)).where("page_score > 0").withColumn(
        "prefix", top_dir() if prefix is None else prefix)
    order = [F.desc("page_score"), F.asc("rel_path")]
    head = top_rows(scored, [group], order, half).drop("rank").withColumn("__part", F.lit(0))
    leaders = first_rows(scored, [group, "prefix"], order)
    rest = leaders.join(head.select(group, "prefix").distinct(), [group, "prefix"], "left_anti").withColumn("__part", F.lit(1))
    return top_rows(head.unionByName(rest), [group], [F.asc("__part"), *order], limit).drop("__part")


def excerpt_budget(docs: DataFrame, group: str, rank: str, budget: int = 12000, each: int = 900, least: int = 200) -> DataFrame:
    """Titled excerpts in rank order until the budget is used; the last is cut if enough room is left."""
    block = F.concat(F.lit("### "), F.col("title"), F.lit("\n"), F.substring(strip("body"), 1, each))
    blocks = docs.where(strip("body") != "").select(group, rank, "title", block.alias("block"))
    before = running(blocks, [group], id_block(rank, 1024), [rank], sums={"used": F.length("block")}, inclusive=False)
    room = F.lit(budget) - F.col("used")
    fits = F.length("block") <= room
    return before.where(fits | (room >= least)).select(
        group, rank, "title", "used", F.when(fits, F.col("block")).otherwise(F.expr(f"substring(block, 1, cast({budget} - used as int))")).alias("block"))


def assumption_table(pages: DataFrame, limit: int | None = None, heading: str = "核心假设", fallback: str = "核心要点",
                     scan_mark: str = "矛盾扫描") -> DataFrame:
    """Assumptions of each page: the front-matter list, else the section's items, else two key points.

    All of them, unordered; with `limit` the first by path and place."""
    rows = pages.where(~((F.col("type") == "comparison") & F.col("title").contains(scan_mark)))
    none = F.array().cast("array<string>")
    listed = F.filter(F.transform(F.coalesce("assumptions", none), strip), lambda s: s != "")
    section = section_items("body", heading, 8)
    points = F.when(F.col("type").isin("concept", "comparison", "note"), section_items("body", fallback, 2, False)).otherwise(none)
    items = F.when(F.size(listed) > 0, listed).when(F.size(section) > 0, section).otherwise(points)
    found = rows.select("rel_path", "title", F.posexplode(items).alias("n", "assumption")).withColumn("assumption", F.substring("assumption", 1, 400))
    return found if limit is None else found.orderBy("rel_path", "n").limit(limit)


# Label keywords; the order of the labels does not matter, ties go to the smaller name.
CLASS_RULES = {
    "output_rules": ("规则", "话术", "模板", "禁用", "禁止", "语气", "风格"),
    "customer_questions": ("faq", "问答", "客户问", "常见问题", "咨询"),
    "case_materials": ("案例", "成交", "复盘", "示范", "样例"),
    "products_services": ("产品", "服务", "方案", "报价", "功能", "参数"),
    "enterprise_basics": ("公司简介", "企业", "制度", "流程", "组织", "介绍"),
}
CLASS_DEFAULT = "enterprise_basics"


def classify(docs: DataFrame, name: str, text: str, rules: dict[str, Sequence[str]] = CLASS_RULES,
             default: str = CLASS_DEFAULT, opening: int | None = None) -> DataFrame:
    """Label each file by keyword hits in its name and text, with up to two related labels; `opening` keeps to so many
    characters of the text."""
    body = F.col(text) if opening is None else F.substring(text, 1, opening)
    blob = F.lower(F.concat(F.col(name), F.lit(" "), body))
    hits = [F.struct((-reduce(Column.__add__, [(blob.contains(w.lower()) | F.col(name).contains(w)).cast("int") for w in words]))
                     .alias("neg"), F.lit(key).alias("key")) for key, words in sorted(rules.items())]
    ranked = docs.withColumn("__r", F.array_sort(F.array(*hits)))
    top = F.get("__r", F.lit(0))
    related = F.transform(F.filter(F.slice("__r", 2, 2), lambda h: h["neg"] < 0), lambda h: h["key"])
    return ranked.select(*docs.columns, F.when(top["neg"] < 0, top["key"]).otherwise(default).alias("primary_category"),
                         related.alias("related_categories"), (top["neg"] == 0).alias("uncertain"))


def classify_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("primary_category").agg(F.count("*").alias("files"), F.count_if("uncertain").alias("uncertain"))


def triage(facts: DataFrame) -> DataFrame:
    """Work items from a one-row table of counts, highest priority first.

    facts: inbox, drafts, orphans, open_questions, chunks, pages, qa, archived_qa."""
    items = [
        ("inbox", F.col("inbox") > 0, F.col("inbox"), 9), ("drafts", F.col("drafts") >= 5, F.col("drafts"), 6),
        ("orphans", F.col("orphans") >= 3, F.col("orphans"), 5), ("gaps", F.col("open_questions") > 0, F.col("open_questions"), 7),
        ("index", (F.col("chunks") == 0) & (F.col("pages") > 0), F.col("pages"), 8),
        ("memory", (F.col("qa") > 0) & (F.col("archived_qa") == 0), F.col("qa"), 4),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("due"), n.cast("bigint").alias("n"), F.lit(p).alias("priority"))
                     for k, c, n, p in items])
    level = F.when(F.col("priority") >= 7, "high").when(F.col("priority") >= 4, "watch").otherwise("low")
    return facts.select(F.inline(rows)).where("due").drop("due").withColumn("level", level).orderBy(F.desc("priority"))


def replace_prefix(store: DataFrame, prefixes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drop stored rows whose path starts with a prefix and add the re-read rows.

    Each path lists its own leading parts, so the test is an equi join; prefixes end at a path separator."""
    folders = prefixes.select(F.regexp_replace("prefix", "/+$", "").alias("folder")).distinct()
    doomed = (store.select("rel_path").distinct()
              .select("rel_path", F.explode(F.concat(F.array("rel_path"), _prefixes(F.col("rel_path")))).alias("folder"))
              .join(folders, "folder", "left_semi").select("rel_path").distinct())
    return store.join(doomed, "rel_path", "left_anti").unionByName(fresh)

