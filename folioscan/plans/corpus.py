"""Page, asset, folder and scope queries, and corpus health reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..operators import corpus as P
from ..operators import graph as G
from ..operators.sequences import equal_depth, page_of
from . import common as C
from .chunks import document_sql, table_sql, titled_sql
from .registry import query

TAGGED = """
tg as (select rel_path, list(tag order by ord) as tags from v_tags group by rel_path),
lk as (select rel_path, count(*) as n from v_links group by rel_path),
pg as (select p.*, coalesce(tg.tags, []) as tags, coalesce(lk.n, 0) as links_count,
    case when p.doc_id % 3 = 0 then concat('assets/documents/', p.doc_id, '.html') else '' end as asset_path
  from v_pages p left join tg using (rel_path) left join lk using (rel_path))"""


def pages(t):
    return C.page_arrays(t).withColumn("asset_path", F.when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit("assets/documents/"), F.col("doc_id").cast("string"), F.lit(".html"))).otherwise(""))


def big(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else F.col(c) for c in df.columns])


@query("B1", "b1_filter_pages", "select rel_path, title from v_pages where type = 'concept' and status = 'refined'")
def _(t):
    return P.filter_pages(t.v_pages, "concept", "refined").select("rel_path", "title")


LIBRARY = f"""
with {TAGGED},
own as (select wiki_page, max(rel_path) as owner from v_assets where wiki_page <> '' group by wiki_page),
lib as (select c.chunk_id, c.rel_path, c.title, c.text, case when c.ord % 5 = 0 then [] else p.tags end as ct, p.tags as pt,
    coalesce(nullif(p.asset_path, ''), o.owner, '') as asset_path
  from v_chunks c left join pg p using (rel_path) left join own o on o.wiki_page = c.rel_path),
full_lib as (select l.*, coalesce(a.filename, '') as asset_filename, case when len(ct) > 0 then ct else pt end as tags
  from lib l left join v_assets a on a.rel_path = l.asset_path)"""


def library(t):
    tags = pages(t).select("rel_path", "tags")
    chunks = C.chunks(t).join(tags, "rel_path", "left").withColumn("asset_path", F.lit("")).withColumn(
        "tags", F.when(F.col("ord") % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("tags")))
    return P.chunk_page_asset(chunks, pages(t), t.v_assets)


@query("C1", "c1_chunk_page_asset", LIBRARY + """
select chunk_id, rel_path as wiki_page, asset_path, asset_filename, array_to_string(tags, ',') as tags from full_lib""")
def _(t):
    return library(t).select("chunk_id", "wiki_page", "asset_path", "asset_filename", F.array_join("tags", ",").alias("tags"))


@query("B4", "b4_search_library", LIBRARY + """
select q.query_id, count(*) as rows_found, count(distinct f.rel_path) as pages_found from v_queries q join full_lib f
on contains(lower(concat_ws(' ', f.title, f.text, f.rel_path, f.asset_path, f.asset_filename, array_to_string(f.tags, ' '))), lower(trim(q.phrase)))
group by q.query_id""")
def _(t):
    asked = t.v_queries.select("query_id", F.col("phrase").alias("q"))
    return P.search_library(library(t), asked).groupBy("query_id").agg(
        F.count("*").alias("rows_found"), F.count_distinct("rel_path").alias("pages_found"))


SCOPES = """
scope as (select 1 as scope_id, 'concepts' as path union all select 2, '/notes/4.md' union all select 3, '7.html'
  union all select 4, 'root/wiki/sources/2.md' union all select 5, 'other/8.md' union all select 6, '@external:d3/'
  union all select 7, 'documents/12.html' union all select 8, 'assets'),
ch as (select c.chunk_id, case when p.doc_id % 10 = 9 then '@external:d' || cast(p.doc_id % 4 as varchar) || '/' || c.rel_path else c.rel_path end as rel, p.asset_path as asset, trim(c.title) as title
  from v_chunks c join pg p using (rel_path)),
sc as (select scope_id, ltrim(replace(path, '\\', '/'), '/') as s, list_last(string_split(ltrim(path, '/'), '/')) as base from scope)"""


def scope_rows(t):
    return t.spark.createDataFrame(
        [(1, "concepts"), (2, "/notes/4.md"), (3, "7.html"), (4, "root/wiki/sources/2.md"), (5, "other/8.md"),
         (6, "@external:d3/"), (7, "documents/12.html"), (8, "assets")], "scope_id int, path string")


def scope_chunks(t):
    facts = pages(t).select("rel_path", "asset_path", "doc_id")
    rows = C.chunks(t).join(facts, "rel_path")
    return rows.withColumn("rel_path", F.when(F.col("doc_id") % 10 == 9, F.concat(
        F.lit("@external:d"), (F.col("doc_id") % 4).cast("string"), F.lit("/"), "rel_path")).otherwise(F.col("rel_path")))


@query("B5", "b5_scope_filter", f"""
with {TAGGED}, {SCOPES}
select cast(scope_id as integer) as scope_id, chunk_id from sc join ch on rel = s or asset = s
  or (starts_with(s, '@external:') and starts_with(rel, rtrim(s, '/') || '/'))
  or ends_with(rel, '/' || s) or ends_with(s, '/' || rel)
  or (asset <> '' and (ends_with(asset, '/' || s) or ends_with(s, '/' || asset)))
  or (base <> '' and (ends_with(rel, '/' || base) or ends_with(asset, '/' || base) or title = base))
  or starts_with(rel, s || '/') or starts_with(asset, s || '/')""")
def _(t):
    return P.scope_filter(scope_chunks(t), scope_rows(t))


@query("B6", "b6_external_chunks", f"""
with {TAGGED}, {SCOPES},
dirs as (select distinct 'd' || cast(doc_id % 4 as varchar) as path from v_pages),
e as (select c.chunk_id, '@external:d' || cast(p.doc_id % 4 as varchar) || '/' || c.rel_path as rel_path, c.title, substr(c.text, 1, 200) as preview,
  'd' || cast(p.doc_id % 4 as varchar) as external_path from v_chunks c join pg p using (rel_path) where p.doc_id % 10 = 9)
select * from e where contains(lower(title), '9 th') or contains(lower(rel_path), '9 th')""")
def _(t):
    dirs = t.v_pages.select(F.concat(F.lit("d"), (F.col("doc_id") % 4).cast("string")).alias("path")).distinct()
    return P.external_chunks(scope_chunks(t), dirs, "9 TH")


MEMO = """
memo as (select *, case when doc_id % 2 = 0 then true else false end as memo, doc_id % 9 = 0 as pinned,
  coalesce(nullif(updated, ''), created) as stamp from pg where string_split(rel_path, '/')[1] = 'notes')"""


def memos(t):
    return pages(t).withColumn("memo", F.col("doc_id") % 2 == 0).withColumn("pinned", F.col("doc_id") % 9 == 0)


@query("B7 H22", "b7_memo_timeline", f"""
with {TAGGED}, {MEMO} select rel_path, substr(stamp, 1, 10) as date_key, '' as time_key from memo
where memo and (list_contains(tags, 'fr') or contains(body, '#fr'))""")
def _(t):
    from ..functions.text import memo_time

    return P.memo_timeline(memos(t), tag="#fr").select("rel_path", "date_key", memo_time("updated").alias("time_key"))


@query("F3 B7", "f3_memo_order", f"""
with {TAGGED}, {MEMO} select rel_path, row_number() over (order by pinned desc, stamp desc, rel_path) as position, pinned, stamp
from memo order by position limit 50""")
def _(t):
    rows = P.memo_timeline(memos(t), flash_only=False).withColumn("stamp", F.coalesce(F.nullif("updated", F.lit("")), "created"))
    out = page_of(rows, equal_depth(rows, P.memo_key()), P.memo_order(), 1, 50)
    return out.select("rel_path", "position", "pinned", "stamp")


@query("B8", "b8_watchable", """
with f as (select case page_id % 6 when 0 then 'inbox/' || page_id || '.md' when 1 then 'inbox-processed/' || page_id || '.md'
    when 2 then '.rag/' || page_id || '.json' when 3 then 'a/manifest.json' when 4 then 'a/b/' || page_id || '.PDF' else 'a/' || page_id || '.html' end as path from pages)
select path, count(*) as n from f where not regexp_matches(path, '(^|/)(inbox-processed|\\.extracted)(/|$)') and not regexp_matches(path, '(^|/)manifest\\.json$')
  and regexp_matches(lower(path), '\\.(md|pdf|txt|docx?|pptx?|xlsx?|png|jpe?g|mp3|mp4)$') group by path""")
def _(t):
    i = F.col("page_id").cast("string")
    path = (F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("inbox/"), i, F.lit(".md")))
            .when(F.col("page_id") % 6 == 1, F.concat(F.lit("inbox-processed/"), i, F.lit(".md")))
            .when(F.col("page_id") % 6 == 2, F.concat(F.lit(".rag/"), i, F.lit(".json")))
            .when(F.col("page_id") % 6 == 3, F.lit("a/manifest.json"))
            .when(F.col("page_id") % 6 == 4, F.concat(F.lit("a/b/"), i, F.lit(".PDF")))
            .otherwise(F.concat(F.lit("a/"), i, F.lit(".html"))))
    return t.pages.select(path.alias("path")).where(P.watchable()).groupBy("path").agg(F.count("*").alias("n"))


_CELLS = "trim(l, ' ' || chr(10) || chr(9) || chr(13))"


@query("B11", "b11_parse_quality", rf"""
with src as (select cast(doc_id as varchar) as k, {titled_sql('text', "'doc' || doc_id")} as t from documents), {document_sql('made', 'src', 480, 80)},
piece as (select k, piece, {table_sql('piece')} as tabled, list_filter(list_transform(string_split(piece, chr(10)), lambda l: case when {_CELLS} = '' or regexp_matches({_CELLS}, '^[|\-: ]*$') then 0
    when starts_with({_CELLS}, '|') and length({_CELLS}) - length(replace({_CELLS}, '|', '')) < 2 then 1
    when regexp_matches({_CELLS}, '\|[^|\n]*$') and not ends_with({_CELLS}, '|') then 2 else 0 end), lambda n: n > 0) as faults from made),
per as (select d.source, d.text, count(p.k) as chunks, count(*) filter (where tabled) as tables, count(*) filter (where tabled and len(faults) > 0) as faulty
  from documents d left join piece p on p.k = cast(d.doc_id as varchar) group by d.doc_id, d.source, d.text)
select source, count(*) as files, count(*) filter (where faulty > 0 or length(trim(text, ' ' || chr(10))) < 40 or (regexp_matches(text, '第\d+页-表格') and tables = 0 and not contains(text, '|'))) as warned,
  cast(sum(tables) as bigint) as table_chunks, count(*) filter (where regexp_matches(text, '(?i)OCR')) as ocr, cast(sum(chunks) as bigint) as chunks from per group by source""")
def _(t):
    docs = t.spread(t.documents, "doc_id").select("doc_id", "source", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text")
    checked = P.parse_quality(docs)
    return checked.groupBy("source").agg(
        F.count("*").alias("files"), F.count_if(F.size("issues") > 0).alias("warned"), F.sum("table_chunks").alias("table_chunks"),
        F.count_if("has_ocr_signal").alias("ocr"), F.sum("chunks").alias("chunks"))


@query("B11", "b11_parse_signals", """
select doc_id, length(text) as chars, regexp_matches(text, '(?i)OCR') as has_ocr_signal, length(trim(text)) < 40 as short
from documents""")
def _(t):
    docs = t.spread(t.documents, "doc_id").select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    out = P.parse_quality(docs)
    return out.select("doc_id", F.col("chars").cast("bigint").alias("chars"), "has_ocr_signal",
                      F.array_contains("issues", "提取文本过短，可能解析失败或扫描件未 OCR").alias("short"))


FOLDERS = """
fp as (select rel_path, doc_id, case doc_id % 4 when 0 then ['f1'] when 1 then ['f2', 'f3'] when 2 then [] else ['f9', 'f1', 'f1', ' f2 '] end as ids from v_pages),
fa as (select rel_path, wiki_page, case when size % 2 = 0 then ['f3'] else ['f5'] end as ids from v_assets),
fd as (select distinct 'd' || cast(doc_id % 6 as varchar) as path, case when doc_id % 6 < 3 then ['f3'] else ['f4'] end as ids from v_pages)"""


def foldered(t):
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    i = F.col("doc_id")
    fp = t.v_pages.select("rel_path", "doc_id", F.when(i % 4 == 0, arr("f1")).when(i % 4 == 1, arr("f2", "f3"))
                          .when(i % 4 == 2, F.array().cast("array<string>")).otherwise(arr("f9", "f1", "f1", " f2 ")).alias("folder_ids"))
    fa = t.v_assets.select("rel_path", "wiki_page", F.when(F.col("size") % 2 == 0, arr("f3")).otherwise(arr("f5")).alias("folder_ids"))
    fd = t.v_pages.select(F.concat(F.lit("d"), (i % 6).cast("string")).alias("path"),
                          F.when(i % 6 < 3, arr("f3")).otherwise(arr("f4")).alias("folder_ids")).distinct()
    return fp, fa, fd


FOLDER_SQL = """
select rel_path as path from fp where list_has_any(ids, ['f2', 'f3']) union select rel_path from fa where list_has_any(ids, ['f2', 'f3'])
union select wiki_page from fa where list_has_any(ids, ['f2', 'f3']) and wiki_page <> ''
union select '@external:' || path from fd where list_has_any(ids, ['f2', 'f3'])"""


@query("C6", "c6_folder_scope", f"with {FOLDERS} {FOLDER_SQL}")
def _(t):
    return P.folder_scope(["f2", "f3"], *foldered(t))


@query("C7", "c7_expand_scope", f"""
with {TAGGED}, s as (select cast(doc_id % 7 as integer) as scope_id, rel_path as path from v_pages where type = 'note'
  union all select 8, rel_path from v_assets)
select distinct scope_id, path from (select scope_id, path from s
union all select s.scope_id, a.wiki_page from s join v_assets a on a.rel_path = s.path where a.wiki_page <> ''
union all select s.scope_id, p.asset_path from s join pg p on p.rel_path = s.path where p.asset_path <> ''
union all select s.scope_id, a.rel_path from s join v_assets a on a.wiki_page = s.path where a.wiki_page <> '') x""")
def _(t):
    scope = t.v_pages.where("type = 'note'").select((F.col("doc_id") % 7).cast("int").alias("scope_id"), F.col("rel_path").alias("path")).union(
        t.v_assets.select(F.lit(8).alias("scope_id"), "rel_path"))
    return P.expand_scope(scope, pages(t), t.v_assets)


@query("G5", "g5_scope_union", f"with {FOLDERS} select rel_path as path from v_pages where type = 'source' union ({FOLDER_SQL})")
def _(t):
    return P.scope_union(t.v_pages.where("type = 'source'").select(F.col("rel_path").alias("path")),
                         P.folder_scope(["f2", "f3"], *foldered(t)))


@query("G8", "g8_normalize_folder_ids", f"""
with {FOLDERS} select rel_path, array_to_string(list_filter(list_distinct_ordered, lambda x: list_contains(['f1', 'f2', 'f3'], x)), ',') as ids
from (select rel_path, list_filter(list_transform(ids, lambda x: trim(x)), lambda x, i: list_position(list_transform(ids, lambda y: trim(y)), x) = i) as list_distinct_ordered from fp) x""")
def _(t):
    fp, _, _ = foldered(t)
    valid = F.array(*[F.lit(x) for x in ("f1", "f2", "f3")])
    return fp.select("rel_path", F.array_join(P.normalize_folder_ids("folder_ids", valid), ",").alias("ids"))


@query("G6", "g6_merge_tags", f"""
with {TAGGED}, m as (select rel_path, list_concat(tags, [type, status, tags[1], '']) as parts from pg)
select rel_path, array_to_string(list_filter(parts, lambda x, i: x is not null and x <> '' and list_position(parts, x) = i)[1:3], ',') as tags from m""")
def _(t):
    from ..functions.text import merge_tags

    extra = F.array_compact(F.array("type", "status", F.get("tags", F.lit(0)), F.lit("")))
    return pages(t).select("rel_path", F.array_join(merge_tags("tags", extra, 3), ",").alias("tags"))


@query("G7", "g7_distinct_tags", """
select tag, rel_path, at_pos from (select tag, rel_path, cast(ord as integer) as at_pos, row_number() over (partition by tag order by rel_path, ord) as rn from v_tags where tag <> '') x where rn = 1""")
def _(t):
    return P.distinct_tags(pages(t)).withColumnRenamed("at", "at_pos")


@query("D12", "d12_page_stats", """
select 'all' as level, '' as key, count(*) as pages from v_pages
union all select 'type', type, count(*) from v_pages group by type
union all select 'status', status, count(*) from v_pages group by status
union all select 'dir', string_split(rel_path, '/')[1], count(*) from v_pages group by 2""")
def _(t):
    return P.page_stats(t.v_pages)


@query("D13", "d13_tag_index", """
with x as (select coalesce(t.tag, '(无标签)') as tag, p.rel_path, p.title, p.type, p.status from v_pages p left join v_tags t using (rel_path))
select tag, rel_path, title, type, status, count(*) over (partition by tag) as tag_pages from x""")
def _(t):
    return P.tag_index(pages(t)).select("tag", "rel_path", "title", "type", "status", "tag_pages")


@query("D14", "d14_draft_summary", f"""
with {TAGGED}, d as (select * from pg where status = 'draft')
select rel_path, title, type, cast(links_count as bigint) as links_count, (select count(*) from d) as draft_total, (select count(*) from d where links_count = 0) as no_links_total
from d order by rel_path limit 30""")
def _(t):
    return big(P.draft_summary(pages(t)), "links_count")


@query("F1", "f1_recent_pages", """
select rel_path, title, type, status, coalesce(nullif(updated, ''), nullif(created, ''), '1970-01-01') as changed from v_pages
order by changed desc, rel_path limit 20""")
def _(t):
    return P.recent_pages(t.v_pages).select("rel_path", "title", "type", "status", "changed")


@query("F5", "f5_assets_page", """
with a as (select *, '2024-' || lpad(cast(1 + size % 12 as varchar), 2, '0') as updated from v_assets)
select filename, updated, position, total from (select *, row_number() over (order by updated desc, filename desc) as position, count(*) over () as total from a) x
where position > 20 and position <= 40""")
def _(t):
    assets = t.v_assets.withColumn("updated", F.concat(F.lit("2024-"), F.lpad((1 + F.col("size") % 12).cast("string"), 2, "0")))
    cuts = equal_depth(assets, F.struct("updated", "filename"))
    return page_of(assets, cuts, [F.desc("updated"), F.desc("filename")], 2, 20, descending=True).select(
        "filename", "updated", "position", "total")


@query("D22", "d22_triage", f"""
with {TAGGED}, c as (select (select count(*) from pages where url like '%?%') as inbox, (select count(*) from pg where status = 'draft') as drafts,
  (select count(*) from pg where links_count = 0 and type <> 'note') as orphans, (select count(*) from v_links where link like 'missing/%') as gaps,
  (select count(*) from v_qa) as qa)
select kind, n, priority, case when priority >= 7 then 'high' else 'watch' end as level from (
  select 'inbox' as kind, inbox as n, 9 as priority from c where inbox > 0 union all select 'drafts', drafts, 6 from c where drafts >= 5
  union all select 'orphans', orphans, 5 from c where orphans >= 3 union all select 'gaps', gaps, 7 from c where gaps > 0
  union all select 'memory', qa, 4 from c where qa > 0) x""")
def _(t):
    p = pages(t)
    count = lambda df: df.agg(F.count("*")).scalar()
    facts = p.agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "draft").alias("drafts"),
                  F.count_if((F.size("links") == 0) & (F.col("type") != "note")).alias("orphans")).select(
        "*", count(t.pages.where("url like '%?%'")).alias("inbox"),
        count(t.v_links.where("link like 'missing/%'")).alias("open_questions"), count(C.chunks(t)).alias("chunks"),
        count(C.qa(t)).alias("qa"), F.lit(0).alias("archived_qa"))
    return P.triage(facts)


WORDS = ("the", "and", "der", "la", "que", "zzzz")


STYLE_SQL = r"""
with s as (select source, trim(unnest(string_split_regex(regexp_replace(text, '([。！？!?；;])\s*', '\1' || chr(10), 'g'), '\n+'))) as sentence from documents),
k as (select source, sentence, length(sentence) as len from s where length(sentence) >= 4),
a as (select source, count(*) as n, sum(len) as total, count(*) filter (where regexp_matches(sentence, '[?？]')) as q,
  count(*) filter (where regexp_matches(sentence, '[!！]')) as e, list_sort(list(len)) as lens from k group by source),
d as (select source, sum(len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: trim(p) <> ''))) as paras,
  sum(len(regexp_extract_all(text, '(?m)^\s*[-*+]\s')) + len(regexp_extract_all(text, '(?m)^\s*\d+\.\s'))) as lists,
  sum(len(regexp_extract_all(text, '(?m)^#{1,6}\s'))) as heads, sum(len(regexp_extract_all(text, '(?m)^\|.+\|$'))) as rows_,
  sum(len(string_split(regexp_replace(text, '\n$', ''), chr(10)))) as lines_, sum(length(text)) as chars from documents group by source)
select source, n as sentence_count, round_even(total / n, 1) as avg_sentence_len, cast(lens[n // 2 + 1] as bigint) as median_sentence_len,
  cast(greatest(paras, 1) as bigint) as paragraph_count, round_even(n / greatest(paras, 1), 1) as avg_paragraph_sentences,
  round_even(lists / greatest(lines_, 1), 3) as list_line_ratio, round_even(heads / greatest(paras, 1), 2) as heading_density,
  cast(rows_ as bigint) as table_row_count, round_even(q / n, 3) as question_ratio, round_even(e / n, 3) as exclaim_ratio, cast(chars as bigint) as chars
from a join d using (source)"""


@query("D24", "d24_style_metrics", STYLE_SQL)
def _(t):
    docs = t.spread(t.documents, "doc_id").select("source", "text")
    return P.style_metrics(docs, "source")


@query("D25", "d25_top_starters", r"""
with s as (select doc_id, source, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([。！？!?；;])\s*', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: length(x) >= 4)) as sentence from documents),
c as (select source, regexp_extract(sentence, '^([A-Za-z]{1,8})', 1) as starter, count(*) as uses from s group by 1, 2)
select source, starter, uses, rank from (select *, row_number() over (partition by source order by uses desc, starter) as rank from c where starter <> '') x where rank <= 6""")
def _(t):
    docs = t.spread(t.documents, "doc_id").select("source", "text")
    return big(P.top_starters(docs, "source"), "rank")


@query("D25", "d25_connector_counts", "with c as (" + " union all ".join(
    f"select source, '{w}' as word, {i} as at_pos, cast(sum((length(text) - length(replace(text, '{w}', ''))) // {len(w)}) as bigint) as uses from documents group by source"
    for i, w in enumerate(WORDS)) + """) select source, word, uses, rank from (
  select *, row_number() over (partition by source order by uses desc, at_pos) as rank from c where uses > 0) x where rank <= 4""")
def _(t):
    out = P.connector_counts(t.documents, "source", words=WORDS, k=4)
    return big(out.select("source", "word", "uses", "rank"), "rank")


@query("D26", "d26_style_summary", f"""
with m as ({STYLE_SQL}),
w as (select *, case when avg_sentence_len <= 18 then '短句为主、节奏紧凑' when avg_sentence_len <= 32 then '句长适中、叙述与说明并重' else '偏长句、适合展开论述' end as pace,
  concat_ws('；', case when list_line_ratio >= 0.15 then '常用条目式列举' end, case when heading_density >= 0.4 then '小节标题分层清晰' end, case when table_row_count >= 3 then '习惯用表格做对比或清单' end) as structure,
  concat_ws('；', case when question_ratio >= 0.08 then '偶用设问引导' end, case when exclaim_ratio >= 0.05 then '语气略带强调' end) as tone from m)
select source, concat_ws(chr(10), '句长特征：' || pace || '（均句长约 ' || printf('%.1f', avg_sentence_len) || ' 字）。', case when structure <> '' then '结构习惯：' || structure || '。' end,
  case when tone <> '' then '语气习惯：' || tone || '。' end) as summary from w""")
def _(t):
    docs = t.spread(t.documents, "doc_id").select("source", "text")
    return P.style_summary(P.style_metrics(docs, "source")).select("source", "summary")


SCORE_SQL = """case when length(trim(body)) < 120 then 0.0 else least(length(trim(body)) / 800.0, 3.0) + case when status = 'published' then 1.5 else 0.0 end
  + case when type in ('note', 'concept', 'comparison') then 1.0 when type = 'source' then 0.3 else 0.0 end end"""


@query("E12", "e12_sample_pages", f"""
with p as (select lang, rel_path, source as prefix, round({SCORE_SQL}, 6) as page_score from v_pages),
r as (select *, row_number() over (partition by lang order by page_score desc, rel_path) as rk,
  row_number() over (partition by lang, prefix order by page_score desc, rel_path) as pk from p where page_score > 0),
h as (select * from r where rk <= 9),
rest as (select r.* from r where pk = 1 and not exists (select 1 from h where h.lang = r.lang and h.prefix = r.prefix)),
u as (select *, 0 as part from h union all select *, 1 from rest)
select lang, rel_path, prefix, cast(page_score as double) as page_score, rank from (select *, row_number() over (partition by lang order by part, page_score desc, rel_path) as rank from u) x where rank <= 18""")
def _(t):
    out = P.sample_pages(t.v_pages.withColumn("src", F.col("source")), "lang", 18, F.col("src"))
    return big(out.select("lang", "rel_path", "prefix", "page_score", "rank"), "rank")


@query("E11", "e11_excerpt_budget", """
with b as (select lang, doc_id, title, '### ' || title || chr(10) || substr(trim(body), 1, 900) as block from v_pages where trim(body) <> ''),
u as (select *, coalesce(sum(length(block)) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as used from b)
select lang, doc_id, cast(used as bigint) as used, case when length(block) <= 12000 - used then block else substr(block, 1, cast(12000 - used as bigint)) end as block
from u where length(block) <= 12000 - used or 12000 - used >= 200""")
def _(t):
    return P.excerpt_budget(t.v_pages, "lang", "doc_id").select("lang", "doc_id", F.col("used").cast("bigint").alias("used"), "block")


RULES = {"alpha": ("the", "of"), "beta": ("der", "und"), "delta": ("que", "le"), "gamma": ("doc1", "zz")}
_hit = lambda k: " + ".join(f"cast(contains(blob, '{w}') as integer)" for w in RULES[k])
CLASSIFY = "with b as (select doc_id, 'doc' || doc_id as name, lower('doc' || doc_id || ' ' || text) as blob from documents), s as (" + " union all ".join(
    f"select doc_id, '{k}' as key, {_hit(k)} as hits from b" for k in RULES) + """),
r as (select *, row_number() over (partition by doc_id order by hits desc, key) as rk from s),
g as (select doc_id, coalesce(max(key) filter (where rk = 1 and hits > 0), 'beta') as primary_category,
  coalesce(string_agg(key, ',' order by rk) filter (where rk in (2, 3) and hits > 0), '') as related, bool_and(hits = 0) as uncertain from r group by doc_id)"""


def labelled(t):
    docs = t.documents.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text")
    return P.classify(docs, "name", "text", RULES, "beta")


@query("H26", "h26_classify", CLASSIFY + " select doc_id, primary_category, related, uncertain from g")
def _(t):
    return labelled(t).select("doc_id", "primary_category", F.array_join("related_categories", ",").alias("related"), "uncertain")


@query("D30", "d30_classify_counts", CLASSIFY + """
select primary_category, count(*) as files, count(*) filter (where uncertain) as uncertain from g group by primary_category""")
def _(t):
    return P.classify_counts(labelled(t))


@query("D29 H28", "d29_assumption_table", """
with p as (select rel_path, title, type, doc_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) as flat from v_pages),
a as (select rel_path, title, 0 as n, 'listed ' || type as assumption from p where doc_id % 5 = 1
union all select rel_path, title, i, ltrim(substr(flat, 1 + i * 10, 9 + i), '-•* ') from p, range(0, 3) r(i) where doc_id % 5 <> 1 and doc_id % 2 = 0)
select rel_path, title, assumption, n from (select rel_path, title, trim(assumption) as assumption, cast(row_number() over (partition by rel_path order by n) - 1 as integer) as n from a where trim(assumption) <> '' and not starts_with(trim(assumption), '#')) x
""")
def _(t):
    i = F.col("doc_id")
    flat = F.col("flat")
    bullet = lambda k: F.concat(F.lit("- "), F.substring(flat, 1 + k * 10, 9 + k), F.lit("\n"))
    body = F.when(i % 2 == 0, F.concat(F.lit("intro\n\n### 核心假设\n\n"), bullet(0), bullet(1), bullet(2), F.lit("\n## next\n\n- other\n"))).otherwise("plain")
    rows = t.v_pages.withColumn("flat", squeeze("body")).withColumn("body", body).withColumn("assumptions", F.when(
        i % 5 == 1, F.array(F.concat(F.lit("listed "), "type"))))
    return P.assumption_table(rows).select("rel_path", "title", "assumption", F.col("n").cast("int").alias("n"))


@query("G4", "g4_replace_prefix", """
select rel_path, title from v_pages where not starts_with(rel_path, 'concepts/') and not starts_with(rel_path, 'notes/')
union all select rel_path, 'new ' || title from v_pages where starts_with(rel_path, 'notes/')""")
def _(t):
    store = t.v_pages.select("rel_path", "title")
    fresh = store.where("rel_path like 'notes/%'").withColumn("title", F.concat(F.lit("new "), "title"))
    prefixes = store.select(F.concat(P.top_dir(), F.lit("/")).alias("prefix")).where("prefix in ('concepts/', 'notes/')").distinct()
    return P.replace_prefix(store, prefixes, fresh)


@query("C4", "c4_orphan_pages", """
select rel_path, type from v_pages p where type <> 'note' and not exists (select 1 from v_links l where l.rel_path = p.rel_path)""")
def _(t):
    return G.orphan_pages(t.v_pages, t.v_links, ("note",)).select("rel_path", "type")


@query("A2", "a2_file_labels", """
with f as (select page_id, 'x/' || page_id || case page_id % 5 when 0 then '.PDF' when 1 then '.md' when 2 then '.jpg' when 3 then '.mp3' else '.html' end as path from pages)
select page_id, case page_id % 5 when 2 then 'images' when 3 then 'audio' else 'documents' end as category,
  case page_id % 5 when 0 then 'application/pdf' when 1 then 'text/markdown' when 2 then 'image/jpeg' when 3 then 'audio/mpeg' else 'application/octet-stream' end as mime,
  page_id % 5 <> 4 as supported from f""")
def _(t):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".md", ".jpg", ".mp3", ".html")]), (F.col("page_id") % 5 + 1).cast("int"))
    files = t.pages.select("page_id", F.concat(F.lit("x/"), F.col("page_id").cast("string"), ext).alias("path"))
    return files.select("page_id", P.category("path").alias("category"), P.mime("path").alias("mime"), P.supported("path").alias("supported"))
