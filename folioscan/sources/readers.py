"""File sources: pages, inventories, logs, nested session documents and raw HTML rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions import parsing as X
from ..functions.text import base_name, col, strip
from ..functions.urls import host
from ..operators.corpus import CONTENT_DIRS, category, mime, supported, top_dir


def relative(path, root: str) -> Column:
    """Path below `root`, for paths that may carry a scheme such as file:."""
    clean = F.regexp_replace(F.url_decode(F.replace(col(path), F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/+", "/")
    return F.substring(clean, len(root.rstrip("/")) + 2, 1 << 30)


def page_rows(files: DataFrame) -> DataFrame:
    """Typed page columns from (rel_path, text) rows, with the defaults of absent fields."""
    meta = files.select("rel_path", X.front_matter("text").alias("m"), X.front_body("text").alias("body"))

    def scalar(key: str, default: Column | str = "") -> Column:
        value = X.scalar_value(F.try_element_at("m", F.lit(key)))
        return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))

    def items(key: str) -> Column:
        raw = F.try_element_at("m", F.lit(key))
        one = F.when(F.coalesce(raw, F.lit("")) != "", F.array(X.scalar_value(raw)))
        return F.coalesce(X.list_value(raw), one, F.array().cast("array<string>"))

    flag = lambda key: F.lower(scalar(key, "false")).isin("true", "yes", "on", "1")
    stem = F.regexp_replace(base_name("rel_path"), r"\.md$", "")
    return meta.select(
        "rel_path", scalar("title", stem).alias("title"), scalar("type", "note").alias("type"), items("tags").alias("tags"),
        scalar("created").alias("created"), scalar("updated", scalar("created")).alias("updated"),
        scalar("status", "draft").alias("status"), items("links").alias("links"), "body",
        scalar("source_url").alias("source_url"), scalar("asset_path").alias("asset_path"),
        scalar("asset_mime").alias("asset_mime"), flag("memo").alias("memo"), flag("pinned").alias("pinned"),
        F.filter(items("folder_ids"), lambda x: strip(x) != "").alias("folder_ids"))


def read_pages(spark: SparkSession, root: str, type_: str | None = None, include_inbox: bool = True) -> DataFrame:
    """Markdown pages below the content folders of `root`; processed inbox files are left out."""
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
             .text(root, wholetext=True).select(relative("_metadata.file_path", root).alias("rel_path"), F.col("value").alias("text")))
    dirs = [*CONTENT_DIRS, "inbox"] if include_inbox else list(CONTENT_DIRS)
    parts = F.split("rel_path", "/")
    kept = files.where(top_dir().isin(*dirs) & (F.size(parts) > 1) & ~F.array_contains(parts, "inbox-processed"))
    pages = page_rows(kept)
    return pages.where(F.col("type") == type_) if type_ else pages


def read_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """File inventory with category and media type; contents are read only on request."""
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(*columns)
    return files.withColumn("rel_path", relative("path", root)).where(supported("path")).withColumns(
        {"category": category("path"), "mime": mime("path")})


def dir_stats(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total and supported file counts of an inventory (`path`), over all files or per folder."""
    return files.groupBy(*(by or [])).agg(F.count("*").alias("file_count"), F.count_if(supported("path")).alias("supported_count"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder, of any kind."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def dir_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """Count, newest time and content-sensitive sum of the supported files below a folder."""
    return fingerprint(list_files(spark, root).where(supported("path")))


def fingerprint(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return files.groupBy(*(by or [])).agg(F.count("*").alias("files"), F.max("modificationTime").alias("newest"),
                                          F.sum(each).cast("string").alias("digest"))


@F.udf(returnType=T.StringType(), useArrow=True)
def _decode_gbk(raw: bytes) -> str | None:
    return None if raw is None else bytes(raw).decode("gbk", errors="replace")


def decode_text(content) -> Column:
    """Bytes to text: UTF-8 with or without mark, else GBK; bytes that fit neither are replaced.

    UTF-8 stays in generated code; only other rows carry their bytes to the Arrow helper."""
    raw = col(content)
    text = raw.cast("string")
    valid = F.is_valid_utf8(text)
    return F.regexp_replace(F.when(valid, text).otherwise(_decode_gbk(F.when(~valid, raw))), "^\ufeff", "")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


SESSION_DOC = "id string, updated string, turns array<struct<role:string,content:string>>"


def session_turns(docs: DataFrame) -> DataFrame:
    """Turns of nested session documents, in order; only user and assistant turns with text are kept."""
    rows = docs.select(F.col("id").alias("session_id"), "updated", F.posexplode("turns").alias("turn", "t"))
    return rows.where(F.col("t.role").isin("user", "assistant") & (strip("t.content") != "")).select(
        "session_id", F.col("turn").cast("bigint").alias("turn"), F.col("t.role").alias("role"),
        F.col("t.content").alias("content"), "updated")


def read_session_docs(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(SESSION_DOC).option("multiLine", True).json(path).select("*", "_metadata.file_name")
    named = docs.withColumn("id", F.coalesce("id", F.regexp_replace("file_name", r"\.json$", "")))
    return session_turns(named.where("turns is not null"))


def read_html(pages: DataFrame, full_entities: bool = False) -> DataFrame:
    """Raw HTML rows (url, html) to title and Markdown; pages with almost no text are dropped."""
    unescape = H.unescape_full if full_entities else H.unescape_basic
    # Both in one struct: the filter below then reads the computed text instead of having it computed again.
    held = pages.withColumn("__read", F.array(F.struct(H.html_title("html", unescape).alias("title"), H.html_text("html", unescape).alias("text"))))
    text = held.select(*[c for c in pages.columns if c != "html"], F.explode_outer("__read").alias("__r"), F.col("url").alias("__url")).where(F.length("__r.text") >= 50)
    title = F.when(F.col("__r.title") != "", F.col("__r.title")).otherwise(host("__url"))
    markdown = F.concat(F.lit("# "), title, F.lit("\n\n来源: "), "__url", F.lit("\n\n"), "__r.text")
    return text.select(*[c for c in pages.columns if c != "html"], title.alias("title"), markdown.alias("markdown"), F.lit("basic-html").alias("method"))
