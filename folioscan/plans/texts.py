"""Scalar text, HTML, URL and parsing expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import parsing as X
from ..functions import text as T
from ..functions import urls as U
from ..sources.readers import read_html
from . import common as C
from .registry import query

LF = "chr(10)"


def docs(t, *columns):
    return t.spread(t.documents.select("doc_id", *(columns or ("text",))), "doc_id")


def pages(t):
    return t.spread(t.pages, "page_id")


@query("H1", "h1_normalize_text", r"""
select doc_id, md5(trim(regexp_replace(replace(replace(text || chr(13) || chr(10) || ' ', chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')) as digest
from (select doc_id, replace(text, chr(10), case doc_id % 3 when 0 then chr(13) || chr(10) when 1 then chr(10) || chr(10) || chr(10) || chr(10) else chr(13) end) as text from documents) x""")
def _(t):
    by = F.when(F.col("doc_id") % 3 == 0, "\r\n").when(F.col("doc_id") % 3 == 1, "\n\n\n\n").otherwise("\r")
    raw = F.concat(F.replace("text", F.lit("\n"), by), F.lit("\r\n "))
    return docs(t).select("doc_id", F.md5(T.normalize_text(raw)).alias("digest"))


@query("H2", "h2_tokenize", r"""
select doc_id, cast(len(tokens) as bigint) as n_tokens, md5(array_to_string(tokens, ' ')) as digest
from (select doc_id, regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]+|[a-zA-Z0-9_]+') as tokens from documents) x""")
def _(t):
    return docs(t).select("doc_id", T.tokenize("text").alias("tokens")).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("H3 L4", "h3_tokenize_plain", r"""
select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]+|[a-zA-Z0-9_]+')) as token from conversations) x group by token""")
def _(t):
    return t.conversations.select(F.explode(T.tokenize_plain("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("H4 H5", "h4_embed_input", r"""
select chunk_id, prefix, substr(sha256(case when prefix <> '' then prefix || chr(10) || piece else piece end), 1, 24) as hash from (
  select chunk_id, piece, case when ord % 2 = 0 and ttl <> '' then ttl || ' > ' || 'H ' || type when ttl <> '' then ttl when ord % 2 = 0 then 'H ' || type else '' end as prefix
  from (select chunk_id, type, ord, case when ord % 3 = 0 then '' else trim(title) end as ttl, case when ord % 2 = 0 then '【H ' || type || '】' || chr(10) else '' end || text as piece from v_chunks) a) b""")
def _(t):
    piece = F.concat(F.when(F.col("ord") % 2 == 0, F.concat(F.lit("【H "), "type", F.lit("】\n"))).otherwise(""), "text")
    title = F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("title"))
    rows = C.chunks(t).select("chunk_id", piece.alias("piece"), T.context_prefix(title, piece).alias("prefix"))
    return rows.select("chunk_id", "prefix", T.text_hash(T.embed_input("prefix", "piece")).alias("hash"))


UNESCAPE = "{}"
for _e, _c in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
    UNESCAPE = f"replace({UNESCAPE}, '{_e}', {_c})"
BLANKS = "' ' || chr(10) || chr(9) || chr(13) || chr(160)"


@query("H6", "h6_html_to_plain", rf"""
select page_id, md5(trim(regexp_replace({UNESCAPE.format("regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>|</p>|</li>', chr(10), 'g'), '<[^>]+>', '', 'g')")}, '\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS})) as digest from pages""".replace("\\\\s", "\\s"))
def _(t):
    return pages(t).select("page_id", F.md5(H.html_to_plain("html")).alias("digest"))


TEXT_SQL = rf"""
marked as (select page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', chr(1), 'g'),
    '(?s)<!--.*?-->|<![^>]*>', chr(1), 'g'), '(?i)</?(p|br|div|h1|h2|h3|h4|li|tr)(\s[^>]*)?/?>', chr(1) || chr(2) || chr(1), 'g'), '</?[a-zA-Z][^>]*>', chr(1), 'g'), '<[/a-zA-Z][^>]*$', '') as m from pages),
runs as (select page_id, url, html, list_transform(string_split(m, chr(1)), lambda s: case when s = chr(2) then chr(10)
    when trim({UNESCAPE.format('s')}, {BLANKS}) = '' then '' else trim({UNESCAPE.format('s')}, {BLANKS}) || ' ' end) as r from marked),
txt as (select page_id, url, html, trim(regexp_replace(regexp_replace(array_to_string(r, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), {BLANKS}) as body,
  substr({UNESCAPE.format("trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))")}, 1, 200) as title from runs)""".replace("\\\\s", "\\s")


@query("H7", "h7_html_text", f"with {TEXT_SQL} select page_id, cast(length(body) as bigint) as n, md5(body) as digest from txt")
def _(t):
    return pages(t).select("page_id", H.html_text("html").alias("b")).select(
        "page_id", F.length("b").cast("bigint").alias("n"), F.md5("b").alias("digest"))


@query("H7 L2", "h7_html_article_text")
def _(t):
    """Pages with a captioned picture at the head of the article; the full entity table has nothing left to resolve here."""
    shown = F.replace("html", F.lit("<article>"), F.concat(F.lit('<article><img src="x.png" alt="view '), F.col("page_id").cast("string"), F.lit('">')))
    rows = pages(t).select("page_id", H.html_article_text(shown).alias("body"))
    return rows.select("page_id", H.unescape_full("body").alias("body"))


@query("H8", "h8_html_title", f"with {TEXT_SQL} select page_id, title from txt")
def _(t):
    return pages(t).select("page_id", H.html_title("html").alias("title"))


@query("A9", "a9_read_html", f"""
with {TEXT_SQL}, n as (select *, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) as host from txt),
x as (select page_id, url, case when title <> '' then title else host end as title, body from n where length(body) >= 50)
select page_id, url, title, md5('# ' || title || {LF} || {LF} || '来源: ' || url || {LF} || {LF} || body) as digest, 'basic-html' as method from x""")
def _(t):
    return read_html(pages(t)).select("page_id", "url", "title", F.md5("markdown").alias("digest"), "method")


@query("A14", "a14_localize_text", f"""
with {TEXT_SQL}, n as (select *, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) as host from txt),
s as (select *, replace(trim(regexp_replace(regexp_replace(title, '[<>:"/\\|?*]', '', 'g'), '\\s+', ' ', 'g')), ' ', '-') as slug from n)
select page_id, concat(substr(sha256(url), 1, 16), '-', regexp_replace(host, '[^a-zA-Z0-9.-]', '-', 'g'), '-', substr(case when slug = '' then 'untitled' else slug end, 1, 60), '.md') as name from s""")
def _(t):
    return pages(t).select("page_id", U.local_name("url", H.html_title("html")).alias("name"))


@query("H9", "h9_strip_markdown", "select doc_id, md5(trim(regexp_replace(" + r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '(?m)^>\s?', '', 'g'),
  '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'), '\|', ' ', 'g'), '-{3,}', ' ', 'g'), '\s+', ' ', 'g'))) as digest from documents""")
def _(t):
    return docs(t).select("doc_id", F.md5(T.strip_markdown("text")).alias("digest"))


@query("H10", "h10_split_sentences", r"""
select doc_id, cast(len(s) as bigint) as n, md5(array_to_string(s, '|')) as digest from (select doc_id, list_filter(list_transform(string_split_regex(
  regexp_replace(text, '([。！？!?；;])\s*', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: length(x) >= 4) as s from documents) x""")
def _(t):
    return docs(t).select("doc_id", T.split_sentences("text").alias("s")).select(
        "doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("H11", "h11_hashtags", r"""
select doc_id, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), ',') as tags from (
  select doc_id, regexp_extract_all(replace(text, ' ' || substr(lang, 1, 1), ' #' || lang), '(?:^|[\s(（])#([\p{L}\p{M}\p{N}_-]+)', 1) as tags from documents) x""")
def _(t):
    raw = F.replace("text", F.concat(F.lit(" "), F.substring("lang", 1, 1)), F.concat(F.lit(" #"), "lang"))
    return docs(t, "text", "lang").select("doc_id", F.array_join(T.hashtags(raw), ",").alias("tags"))


@query("H12", "h12_slugify", r"""
select rel_path, case when s = '' then 'untitled' else substr(s, 1, 80) end as slug from (
  select rel_path, replace(trim(regexp_replace(regexp_replace(title || ' a/b: c?', '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g')), ' ', '-') as s from v_pages) x""")
def _(t):
    return t.v_pages.select("rel_path", T.slugify(F.concat("title", F.lit(" a/b: c?"))).alias("slug"))


RAW_URL = "case page_id % 3 when 0 then regexp_replace(url, '^https?://', '') when 1 then ' ' || url else url end"


@query("H13 H14 H15", "h13_urls", rf"""
with u as (select page_id, trim({RAW_URL}) as raw from pages), f as (select page_id, case when regexp_matches(raw, '(?i)^https?://') then raw else 'https://' || raw end as full_url from u),
p as (select *, regexp_extract(full_url, '^[a-zA-Z]+://([^/?#]*)', 1) as host, regexp_extract(full_url, '^([^?#]*)', 1) as head from f)
select page_id, case when contains(lower(host), 'example.com') and contains(regexp_extract(head, '^[a-zA-Z]+://[^/]*(/.*)?$', 1), '/en/') then regexp_replace(head, '/+$', '') || '/' else full_url end as url,
  coalesce(nullif(regexp_extract(full_url, '/en/(\d+)', 1), ''), nullif(regexp_extract(full_url, '/(\d+)', 1), ''), '') as content_id, regexp_replace(host, '[^a-zA-Z0-9.-]', '-', 'g') as domain from p""")
def _(t):
    raw = (F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", ""))
           .when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), "url")).otherwise(F.col("url")))
    full = U.normalize_url(raw, ())
    return t.pages.select("page_id", U.normalize_url(raw, ("example.com",), "/en/").alias("url"),
                          F.coalesce(U.url_content_id(full, (r"/en/(\d+)", r"/(\d+)")), F.lit("")).alias("content_id"),
                          U.domain_slug(full).alias("domain"))


@query("H16 B10", "h16_clean_page", f"""
with {TEXT_SQL}, l as (select page_id, array_to_string(list_filter(string_split(md, chr(10)), lambda s: not contains(s, 'the') and not contains(s, 'und ')), chr(10)) as body, ttl from (
  select page_id, case when page_id % 2 = 0 then '' else title end as ttl, 'x ' || chr(10) || '# Head ' || page_id || chr(10) || body as md from txt) y),
b as (select page_id, ttl, trim(body, {BLANKS}) as body from l)
select page_id, case when ttl = '' then 'Head ' || page_id else ttl end as title, md5(body) as digest,
  ttl <> '' and not ((length(body) - length(replace(body, 'que', ''))) // 3 >= 2 or (length(body) < 150 and contains(body, 'ad'))) and length(body) >= 80 as quality_ok from b""")
def _(t):
    i = F.col("page_id").cast("string")
    rows = pages(t).select("page_id", F.when(F.col("page_id") % 2 == 0, "").otherwise(H.html_title("html")).alias("ttl"),
                           F.concat(F.lit("x \n# Head "), i, F.lit("\n"), H.html_text("html")).alias("md"))
    body = U.drop_noise_lines("md", ("the", "und "))
    return rows.select("page_id", U.heading_title("ttl", body).alias("title"), F.md5(body).alias("digest"),
                       U.page_quality("ttl", body, marker="que", shell_host="ad").alias("quality_ok"))


@query("H17 H18", "h17_titles_and_type", r"""
select doc_id, case when doc_id % 4 = 0 then 'Meta' else 'Part ' || cast(doc_id % 3 as varchar) end as title, substr(trim(string_split(text, chr(10))[1]), 1, 80) as first_line,
  coalesce(regexp_extract(text || ' see http://a.b/' || doc_id || ') end', 'https?://[^\s\)\]"'']+'), '') as link,
  case when contains(lower(text || lang), ' vs ') or contains(text, 'que') then 'comparison' when regexp_matches(text, 'https?://') then 'source'
    when contains(lower(text || lang), 'und') then 'concept' when contains(lower(text || lang), 'the') then 'entity' else 'note' end as kind
from documents where trim(string_split(text, chr(10))[1]) <> '' and not starts_with(text, '#')""")
def _(t):
    rows = docs(t, "text", "lang").where((F.trim(F.split("text", "\n")[0]) != "") & ~F.col("text").startswith("#"))
    meta = F.when(F.col("doc_id") % 4 == 0, "Meta").otherwise("")
    body = F.concat(F.lit("lead\n\n# Part "), (F.col("doc_id") % 3).cast("string"), F.lit("\n\n"), "text")
    linked = F.concat("text", F.lit(" see http://a.b/"), F.col("doc_id").cast("string"), F.lit(") end"))
    return rows.select("doc_id", T.page_title(meta, body, F.lit("stem")).alias("title"), T.first_line_title("text").alias("first_line"),
                       T.first_url(linked).alias("link"), T.guess_type("text", "lang", "que", ("und",), ("the",)).alias("kind"))


@query("H19", "h19_page_hint", """
select doc_id, case when n = 0 then null else n end as page, case when doc_id % 3 = 1 then cast(n as integer) end as slide,
  case when n > 0 then case when doc_id % 3 = 1 then '第 ' || n || ' 页' else '第 ' || n || ' 页' end when doc_id % 3 = 1 and n > 0 then '幻灯片 ' || n else '打开原文' end as label
from (select doc_id, case when doc_id % 3 = 2 then null else cast(doc_id % 9 as integer) end as n from documents) x""")
def _(t):
    n = (F.col("doc_id") % 9).cast("string")
    mark = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n--- 第"), n, F.lit("页 ---\n")))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n--- 幻灯片 "), n, F.lit(" ---\n"))).otherwise(""))
    rows = docs(t).select("doc_id", F.concat("text", mark, "text").alias("text"))
    hints = rows.select("doc_id", T.page_hint("text").alias("page"), T.slide_hint("text").alias("slide"))
    return hints.select("*", T.source_label("page", "slide").alias("label"))


@query("H23", "h23_query_variants", r"""
with q as (select conv_id, turn, trim(text) as q, trim(regexp_replace(text, '[？?。！!；;，,、\s]+', ' ', 'g')) as bare, regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z0-9_]{3,}') as w
  from (select conv_id, turn, replace(text, chr(10), ' ') as text from conversations) z),
f as (select conv_id, turn, [q, bare, regexp_replace(bare, '(?i)^(请问|请|什么是|是什么|如何|怎么|为什么|为何)\s*', ''), case when len(w) >= 2 then array_to_string(w[1:8], ' ') end] as forms from q),
d as (select conv_id, turn, list_filter(forms, lambda x, i: x is not null and x <> '' and list_position(forms, x) = i)[1:6] as v from f)
select conv_id, turn, cast(generate_subscripts(v, 1) as bigint) as round, unnest(v) as variant from d""")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.posexplode(T.query_variants(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("p", "variant"))
    return rows.select("conv_id", "turn", (F.col("p") + 1).cast("bigint").alias("round"), "variant")


@query("H24", "h24_json_edges", """
select l.rel_path as source, l.link as target, 'links' as label, case l.ord when 0 then '强' else '弱' end as strength from v_links l""")
def _(t):
    edge = F.struct(F.col("rel_path").alias("source"), F.col("link").alias("target"), F.lit("links").alias("label"),
                    F.when(F.col("ord") == 0, "强").otherwise("弱").alias("strength"))
    # One model answer per page, as such answers arrive; a page has a handful of links.
    raw = t.v_links.groupBy("rel_path").agg(F.to_json(F.struct(F.collect_list(edge).alias("edges"))).alias("j")).select(
        F.concat(F.lit("Here:\n```json\n"), "j", F.lit("\n```\nend")).alias("raw"))
    return raw.select(F.inline(X.json_edges("raw")))


@query("H24", "h24_json_conflicts", """
select cast(doc_id as varchar) as path_a, trim(title) as a, status as b, type as why, rel_path as path_b from v_pages where title <> '' and status <> '' and doc_id % 5 <> 0""")
def _(t):
    i = F.col("doc_id")
    item = F.struct(F.col("title").alias("a"), F.when(i % 5 == 0, F.col("title")).otherwise(F.col("status")).alias("assumption_b"),
                    F.col("type").alias("reason"), i.cast("string").alias("path_a"), F.col("rel_path").alias("rel_path_b"))
    raw = t.v_pages.select("rel_path", F.concat(F.lit("note "), F.to_json(F.struct(F.array(item).alias("conflicts")))).alias("raw"))
    return raw.select(F.inline(X.json_conflicts("raw"))).select("a", "b", "why", "path_a", "path_b")


@query("H25", "h25_tagged_blocks", """
select conv_id, turn, trim(replace(text, '<<<', '')) as memory, 'T ' || role as skill_title, '' as skill_body, case when turn % 2 = 0 then '无' else 'P' end as principle_title,
  case when turn % 2 = 0 then '无。' else 'body' end as principle_body, turn % 2 = 0 as principle_empty from conversations""")
def _(t):
    even = F.col("turn") % 2 == 0
    raw = F.concat(F.lit("pre <<<MEMORY>>>\n"), F.replace("text", F.lit("<<<"), F.lit("")), F.lit("\n<<<SKILL_TITLE>>> T "), "role",
                   F.lit("\n<<<principle_title>>> "), F.when(even, "无").otherwise("P"), F.lit("\n<<<PRINCIPLE_BODY>>>\n"),
                   F.when(even, "无。").otherwise("body"))
    rows = t.conversations.select("conv_id", "turn", raw.alias("raw"))
    return X.tagged_blocks(rows, "raw").drop("raw")


@query("H27", "h27_excerpt", r"""
select doc_id, case when length(j) > 400 then substr(j, 1, 400) || '…' when j = '' then '（无摘要）' else j end as excerpt from (
  select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, '#') and not starts_with(x, '来源:')), ' ') as j from documents) x""")
def _(t):
    return docs(t).select("doc_id", T.excerpt("text").alias("excerpt"))


@query("H29 E15", "h29_rule_blocks", r"""
select doc_id, cast(0 as integer) as ord, 'r_0' || substr(md5(text), 1, 6) as id, doc_id % 3 <> 0 as enabled, '纠错 2026-01-02 03:04' as title, '2026-01-02 03:04' as at,
  trim(split_part(text, chr(10), 1), ' ') as question, 'r ' || length(text) as text, '纠错' as kind from documents
union all select doc_id, 1, '', true, '偏好 free', '', '', trim(split_part(text, chr(10), 1), ' '), '偏好' from documents""")
def _(t):
    i = F.col("doc_id")
    block = F.concat(F.lit("# 规则\n\n### r_0"), F.substring(F.md5("text"), 1, 6), F.lit(" · 纠错 2026-01-02 03:04 <!-- enabled: "),
                     F.when(i % 3 == 0, "false").otherwise("true"), F.lit(" -->\n- **触发问题**："), F.split("text", "\n")[0], F.lit("\n- **规则**：r "), F.length("text").cast("string"),
                     F.lit("\n\n### 偏好 free\n"), F.split("text", "\n")[0], F.lit("\nsecond\n"))
    return X.rule_blocks(docs(t).select("doc_id", block.alias("raw")), "raw", ["doc_id"])


@query("H30", "h30_normalize_items", r"""
with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '[;；\n]'), lambda x: trim(trim(trim(x), '-•* '))), lambda x: x <> '') as v from documents)
select doc_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i)[1:5], '|') as items from p""")
def _(t):
    return docs(t).select("doc_id", F.array_join(T.normalize_items("text", 5), "|").alias("items"))


@query("H31", "h31_squash_distance", """
select event_id, round(case when value > 1 then least(1.0, 1 / (1 + value)) else value end, 9) as score from events""")
def _(t):
    return t.events.select("event_id", F.round(T.squash_distance("value"), 9).alias("score"))


@query("H32", "h32_version_key", r"""
select event_id, list_aggregate([cast(coalesce(nullif(regexp_extract(v, '^(\d+)', 1), ''), '0') as integer), cast(coalesce(nullif(regexp_extract(v, '^\d+\.(\d+)', 1), ''), '0') as integer), 0], 'string_agg', '.') as version
from (select event_id, case event_type when 'error' then 'v' else '' end || cast(value as varchar) as v from events) x""")
def _(t):
    raw = F.concat(F.when(F.col("event_type") == "error", "v").otherwise(""), F.col("value").cast("string"))
    return t.events.select("event_id", F.array_join(T.version_key(raw).cast("array<string>"), ".").alias("version"))


@query("H33", "h33_is_table_block", r"""
select doc_id, len(l) >= 2 and p >= 2 and p >= greatest(2, len(l) // 2) as is_table from (
  select doc_id, l, len(list_filter(l, lambda x: contains(x, '|'))) as p from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents) a) b""")
def _(t):
    return docs(t).select("doc_id", T.is_markdown_table("text").alias("is_table"))


@query("H34", "h34_is_analysis_chunk", "select chunk_id, contains(text, 'Part 0') or contains(text, 'que la') as hit from v_chunks")
def _(t):
    return C.chunks(t).select("chunk_id", T.is_analysis_chunk("text", ("Part 0", "que la")).alias("hit"))
