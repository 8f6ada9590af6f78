"""Sources and sinks. Files are written from the given tables into the scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as P
from ..operators.chunking import chunk_rows
from ..session import scratch_path
from ..sources import readers as R
from ..sources import writers as O
from . import common as C
from .registry import query
from .texts import TEXT_SQL


@query("A1", "a1_page_rows", """
select rel_path, case when doc_id % 6 = 0 then cast(doc_id as varchar) else 'T ' || doc_id end as title, type, array_to_string(case when doc_id % 4 = 0 then [lang, source] else [] end, ',') as tags, created,
  case when updated = '' then created else updated end as updated, case when doc_id % 5 = 0 then 'draft' else status end as status, doc_id % 7 = 0 as pinned, md5(body) as digest from v_pages""")
def _(t):
    i = F.col("doc_id")
    text = F.concat(
        F.lit("---\n"), F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("title: \"T "), i.cast("string"), F.lit("\"\n"))),
        F.lit("type: "), "type", F.when(i % 8 == 0, F.concat(F.lit("\ntags: ["), "lang", F.lit(", \""), "source", F.lit("\"]")))
        .when(i % 4 == 0, F.concat(F.lit("\ntags:\n  - "), "lang", F.lit("\n  - \""), "source", F.lit("\""))).otherwise(""),
        F.lit("\ncreated: "), "created", F.lit("\nupdated: "), "updated",
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("\nstatus: "), "status")),
        F.when(i % 7 == 0, "\npinned: true").otherwise(""), F.lit("\n---\n"), "body")
    rows = R.page_rows(t.spread(t.v_pages, "rel_path").select("rel_path", text.alias("text")))
    return rows.select("rel_path", "title", "type", F.array_join("tags", ",").alias("tags"), "created", "updated", "status", "pinned",
                       F.md5("body").alias("digest"))


@query("A2 A3", "a3_dir_stats", """
select source as dir, count(*) as file_count, count(*) filter (where doc_id % 3 <> 0) as supported_count from documents group by source""")
def _(t):
    """The documents as an inventory in which every third file is of a kind that is not read."""
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".bin").otherwise(".md"))
    return R.dir_stats(t.documents.select(F.col("source").alias("dir"), name.alias("path")), ["dir"])


@query("A4", "a4_decode_text", """
select doc_id, md5(case when not regexp_matches(text, '[^\\x00-\\x7f]') then '中文' || text else text end) as digest from documents""")
def _(t):
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7f]")
    gbk = F.concat(F.unhex(F.lit("D6D0CEC4")), F.col("text").cast("binary"))
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))
    raw = t.documents.select("doc_id", F.when(ascii_only, gbk).when(F.col("doc_id") % 2 == 0, marked).otherwise(F.col("text").cast("binary")).alias("raw"))
    return raw.select("doc_id", F.md5(R.decode_text("raw")).alias("digest"))


@query("A5", "a5_read_jsonl", "select event_type, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by event_type")
def _(t):
    """Log lines appended in two writes, with broken and blank lines among them."""
    path = scratch_path(t.spark, "log")
    line = F.to_json(F.struct("event_id", "event_type"))
    lines = t.events.select(F.explode(F.when(F.col("event_id") % 9 == 0, F.array(line, F.lit('{"event_id": 1, "event'), F.lit(""))).otherwise(F.array(line))).alias("value"))
    for half in (0, 1):
        lines.where(F.length("value") % 2 == half).write.mode("append").text(path)
    return R.read_jsonl(t.spark, path, "event_id bigint, event_type string").where("event_id is not null").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("A6", "a6_session_docs", "select session_id, turn, role, md5(content) as digest from v_turns")
def _(t):
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    docs = t.conversations.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    nested = docs.select("id", F.lit("").alias("updated"), F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))
    raw = nested.select(F.to_json(F.struct("*")).alias("j")).select(F.from_json("j", R.SESSION_DOC).alias("d")).select("d.*")
    return R.session_turns(raw).select("session_id", "turn", "role", F.md5("content").alias("digest"))


@query("A10 I10 G1", "a10_write_index", f"""with {TEXT_SQL} select rel_path from v_pages where trim(body) <> ''
union all select 'assets/documents/' || page_id || '.html' from txt where trim(body) <> ''""")
def _(t):
    """All sources unioned, chunked, written as the partitioned index and read back."""
    from ..functions.html import html_text

    assets = t.pages.select(F.concat(F.lit("assets/documents/"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel_path"),
                            F.col("url").alias("title"), html_text("html").alias("body"))
    union = O.corpus_union(t.spread(C.page_arrays(t), "rel_path", scan=t.documents), t.spread(assets, "rel_path", scan=t.pages))
    path = scratch_path(t.spark, "index")
    O.write_index(chunk_rows(union), path, dealt=True)
    return O.read_index(t.spark, path).select("rel_path").distinct()


@query("G1", "g1_corpus_union", """
select rel_path, title, length(body) as n from v_pages where trim(body) <> '' union all select 'inbox/' || page_id, url, length(html) from pages where trim(html) <> ''""")
def _(t):
    inbox = t.pages.select(F.concat(F.lit("inbox/"), F.col("page_id").cast("string")).alias("rel_path"), F.col("url").alias("title"), F.col("html").alias("body"))
    return O.corpus_union(t.v_pages, inbox).select("rel_path", "title", F.length("body").cast("bigint").alias("n"))


@query("A13", "a13_index_reports")
def _(t):
    pages = C.page_arrays(t)
    questions = t.v_queries.select(F.col("phrase").alias("question"))
    links = t.v_links.withColumn("link", F.when(F.col("ord") == 0, F.concat(F.lit("../"), "link")).otherwise(F.col("link")))
    return O.render_index_reports(pages, links, P.page_stats(pages), questions, "2026-01-01 00:00")


@query("D27", "d27_dir_fingerprint", """
select source as dir, count(*) as files, strftime(max(timestamp '2024-01-01' + to_days(cast(doc_id % 300 as integer))), '%Y-%m-%d') as newest from documents group by source""")
def _(t):
    return R.fingerprint(files(t), ["dir"]).select("dir", "files", F.date_format("newest", "yyyy-MM-dd").alias("newest"))


def files(t, touched: bool = False):
    at = F.to_timestamp_ntz(F.lit("2024-01-01"), F.lit("yyyy-MM-dd")) + F.make_dt_interval(days=(F.col("doc_id") % 300).cast("int"))
    size = F.length("text") + (F.when((F.col("source") == "src3") & (F.col("doc_id") % 40 == 3), 1).otherwise(0) if touched else 0)
    return t.documents.select(F.col("source").alias("dir"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
                              size.alias("length"), at.alias("modificationTime"))


@query("K5", "k5_fingerprint_changes", "select source as dir, bool_or(source = 'src3' and doc_id % 40 = 3) as changed from documents group by source")
def _(t):
    from ..streaming.jobs import fingerprint_changes

    return fingerprint_changes(R.fingerprint(files(t), ["dir"]), R.fingerprint(files(t, True), ["dir"])).select("dir", "changed")


@query("K4", "k4_stream_dedup", "select count(*) as rows_kept, count(distinct digest) as contents from (select sha256(text) as digest, min(doc_id) from documents group by 1) x")
def _(t):
    """The documents table read as a stream; each content is stored once."""
    from ..streaming.jobs import stream_new_contents

    path = scratch_path(t.spark, "contents")
    source = t.spark.readStream.schema(t.documents.schema).parquet(f"{t.sf_dir}/documents*.parquet")
    stream_new_contents(source.select("doc_id", F.sha2("text", 256).alias("digest")), "digest", path, scratch_path(t.spark, "cp"))
    return t.spark.read.parquet(path).agg(F.count("*").alias("rows_kept"), F.count_distinct("digest").alias("contents"))


@query("K1 J18", "k1_stream_ingest", "select count(distinct rel_path) as pages from v_pages where trim(body) <> ''")
def _(t):
    """Pages arrive as a file stream and are chunked into the index batch by batch."""
    from ..streaming.jobs import stream_ingest

    staged, path = scratch_path(t.spark, "arriving"), scratch_path(t.spark, "index")
    # As many files as the documents have splits, so that none grows with the corpus; two thirds of them come first.
    parts = max(3, t.documents.rdd.getNumPartitions())
    t.v_pages.select("rel_path", "title", "body").repartition(parts, "rel_path").write.parquet(staged)
    stream = t.spark.readStream.schema("rel_path string, title string, body string").option("maxFilesPerTrigger", -(-2 * parts // 3)).parquet(staged)
    stream_ingest(stream, path, scratch_path(t.spark, "cp"))
    return O.read_index(t.spark, path).agg(F.count_distinct("rel_path").alias("pages"))
