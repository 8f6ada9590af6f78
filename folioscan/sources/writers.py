"""Sinks: the chunk index, keyed tables, logs and Markdown reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import recent_pages, tag_index, top_dir
from ..operators.graph import broken_links, knowledge_map, orphan_pages

# Changes that are kept beside the last whole version before they are folded into a new one.
MOST_CHANGES = 8
# Chunks repeat their parents and tokens, which this codec finds where the default does not.
CODEC = "zstd"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _files(spark, path)
    return fs.exists(where)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished versions, oldest first. A version counts once Spark has marked its last part as written."""
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())
    done = lambda n: exists(spark, f"{path}/{n}/changed/_SUCCESS" if n.endswith("-change") else f"{path}/{n}/_SUCCESS")
    return [n for n in names if n.endswith(("-whole", "-change")) and done(n)]


def _next(spark: SparkSession, path: str, kind: str) -> str:
    """A folder name above every number in use, finished or not."""
    where, fs = _files(spark, path)
    taken = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    last = max([int(n[:10]) for n in taken if n[:10].isdigit()], default=0)
    return f"{path}/{last + 1:010d}-{kind}"


def write_index(chunks: DataFrame, path: str, dealt: bool = False) -> None:
    """Publish a whole new version of a table that `chunks` may itself read; file sizes follow the data. With `dealt`, the rows already lie
    in even partitions, as chunks of pages do where these are read, and are written there without a shuffle.

    A version is a folder of its own and nothing is renamed, so a stop at any point leaves the last finished version as it
    was. The version before stays for readers that still hold it; older ones are removed."""
    spark = chunks.sparkSession
    keys = [F.col("rel_path")] if "rel_path" in chunks.columns else []
    rows = chunks if dealt else chunks.hint("rebalance", *keys)
    rows.write.option("compression", CODEC).parquet(_next(spark, path, "whole"))
    names = versions(spark, path)
    wholes = [n for n in names if n.endswith("-whole")]
    for name in names:
        if len(wholes) > 1 and name < wholes[-2]:
            where, fs = _files(spark, f"{path}/{name}")
            fs.delete(where, True)


replace_table = write_index


def upsert_index(fresh: DataFrame, changed: DataFrame, path: str) -> None:
    """Replace the chunks of the changed pages: only the fresh rows and the list of changed pages are written."""
    spark = fresh.sparkSession
    names = versions(spark, path)
    if not names:
        write_index(fresh, path)
        return
    folder = _next(spark, path, "change")
    fresh.write.option("compression", CODEC).parquet(f"{folder}/rows")
    changed.select("rel_path").distinct().write.parquet(f"{folder}/changed")
    since = [n for n in names if n > max(x for x in names if x.endswith("-whole"))]
    if len(since) >= MOST_CHANGES:
        write_index(read_index(spark, path), path)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as last published: the last whole version with the later changes; None before the first.

    Rows of a page that changed later are left out by a join on the short list of changed pages."""
    names = versions(spark, path)
    if not names:
        return None
    whole = max(n for n in names if n.endswith("-whole"))
    later = [n for n in names if n > whole]
    rows = spark.read.parquet(f"{path}/{whole}")
    if not later:
        return rows
    number = lambda n: F.lit(int(n[:10])).cast("long")
    parts = [rows.withColumn("version__", number(whole))]
    parts += [spark.read.schema(rows.schema).parquet(f"{path}/{n}/rows").withColumn("version__", number(n)) for n in later]
    marks = [spark.read.schema("rel_path string").parquet(f"{path}/{n}/changed").withColumn("last__", number(n)) for n in later]
    last = reduce(DataFrame.unionByName, marks).groupBy("rel_path").agg(F.max("last__").alias("last__"))
    joined = reduce(DataFrame.unionByName, parts).join(last, "rel_path", "left")
    return joined.where(F.col("last__").isNull() | (F.col("version__") >= F.col("last__"))).select(*rows.columns)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


REPORTS = ("tags", "knowledge-map", "stats", "open-questions", "recent", "sync-log")
NONE_LINE = "- （无）"


def render_index_reports(pages: DataFrame, links: DataFrame, stats: DataFrame, questions: DataFrame, stamp: str) -> DataFrame:
    """Lines of six Markdown reports as (report, section, key, line); sort by the first three to print.

    Lines stay rows because some reports list a large part of the corpus."""
    entry = F.concat(F.lit("- ["), "title", F.lit("](../"), "rel_path", F.lit(")"))

    def lines(df: DataFrame, report: str, section: int, key, line) -> DataFrame:
        return df.select(F.lit(report).alias("report"), F.lit(section).alias("section"), key.alias("key"), line.alias("line"))

    def or_none(df: DataFrame, report: str, section: int) -> DataFrame:
        """The lines, or one line saying there are none."""
        count = df.agg(F.count("*").alias("n")).where("n = 0")
        return df.unionByName(lines(count, report, section, F.lit(""), F.lit(NONE_LINE)))

    spark = pages.sparkSession
    heads = [("tags", "标签索引"), ("knowledge-map", "知识关联图"), ("stats", "统计概览"), ("open-questions", "开放问题与缺口"),
             ("recent", "最近更新"), ("sync-log", "同步记录")]
    head = spark.createDataFrame(
        [(r, 0, f"{i:02d}", text) for r, title in heads
         for i, text in enumerate(("---", f"title: {title}", f"generated_at: {stamp}", "---", "", f"# {title}", ""))],
        "report string, section int, key string, line string")
    tags = tag_index(pages)
    local = pages.where(~top_dir().isin("inbox", "archive"))
    nodes, edges = knowledge_map(pages, links)
    broken = broken_links(links.join(local.select("rel_path"), "rel_path", "left_semi"), pages).join(
        local.select("rel_path", "title"), "rel_path")
    recent = recent_pages(pages)
    parts = [
        head,
        lines(tags.select("tag").distinct(), "tags", 1, F.concat(F.lower("tag"), F.lit("\u0000")), F.concat(F.lit("## "), "tag")),
        lines(tags, "tags", 1, F.concat(F.lower("tag"), F.lit("\u0001"), "title", F.lit("\u0001"), "rel_path"),
              F.concat(entry, F.lit(" — `"), "type", F.lit("` / `"), "status", F.lit("`"))),
        lines(nodes, "knowledge-map", 1, F.col("node"), F.concat(F.lit("  "), "node", F.lit('["'), F.replace("title", F.lit('"'), F.lit("'")), F.lit('"]'))),
        lines(edges, "knowledge-map", 2, F.concat("src", "dst"), F.concat(F.lit("  "), "src", F.lit(" --> "), "dst")),
        lines(stats, "stats", 1, F.concat("level", F.lit("\u0001"), "key"),
              F.when(F.col("level") == "all", F.concat(F.lit("- 总条目（不含 inbox）：**"), F.col("pages").cast("string"), F.lit("**")))
              .otherwise(F.concat(F.lit("- `"), "key", F.lit("`: "), F.col("pages").cast("string")))),
        or_none(lines(local.where("status = 'draft'"), "open-questions", 1, F.concat("title", "rel_path"), entry), "open-questions", 1),
        or_none(lines(orphan_pages(local, links), "open-questions", 2, F.concat("title", "rel_path"), entry), "open-questions", 2),
        or_none(lines(broken, "open-questions", 3, F.concat("rel_path", "link"), F.concat(entry, F.lit(" → `"), "link", F.lit("`"))), "open-questions", 3),
        or_none(lines(questions, "open-questions", 4, F.col("question"), F.concat(F.lit("- "), "question")), "open-questions", 4),
        lines(recent, "recent", 1, F.concat(F.translate("changed", "0123456789", "9876543210"), "rel_path"),
              F.concat(F.lit("| "), "changed", F.lit(" | ["), "title", F.lit("](../"), "rel_path", F.lit(") | `"), "type", F.lit("` | `"), "status", F.lit("` |"))),
        lines(spark.range(1), "sync-log", 1, F.lit(""), F.lit("| 日期 | 来源 | 方式 | 条数 | 备注 |")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_reports(rows: DataFrame, path: str) -> None:
    """One folder of text per report; within a folder the files are in line order."""
    (rows.repartitionByRange("report", "section", "key").sortWithinPartitions("report", "section", "key")
     .select("report", "line").write.mode("overwrite").partitionBy("report").text(path))


def corpus_union(*sources: DataFrame) -> DataFrame:
    """Pages, asset texts, inbox files and linked folders as one (rel_path, title, body, asset_path, tags) table."""
    none = F.array().cast("array<string>")
    parts = []
    for df in sources:
        cells = {"asset_path": F.lit(""), "tags": none}
        parts.append(df.select("rel_path", "title", "body", *[
            (F.col(c) if c in df.columns else cells[c]).alias(c) for c in ("asset_path", "tags")]))
    return reduce(DataFrame.unionByName, parts).where(F.trim("body") != "")
