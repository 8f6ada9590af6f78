"""Chunking queries over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators.graph import leading_chunks
from . import common as C
from .registry import query


def pages(t):
    return t.spread(t.v_pages.select("rel_path", "title", "body"), "rel_path")


@query("I1", "i1_split_sections", r"""
with p as (select rel_path, doc_id, trim(regexp_replace(regexp_replace(body, '^# Part \d\n\n', ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as b from v_pages)
select rel_path, cast(0 as integer) as ord, 'Part ' || cast(doc_id % 3 as varchar) as heading, md5(b) as digest from p where b <> ''

union all select rel_path, case when b = '' then 0 else 1 end, 'Second part', md5('closing words of ' || rel_path) from p""")
def _(t):
    """Every page with a second section added, so each has two headings and two bodies."""
    rows = pages(t).withColumn("body", F.concat("body", F.lit("\n\n### Second part\n\nclosing words of "), "rel_path"))
    return K.split_sections(rows, ["rel_path"], "body").select("rel_path", "ord", "heading", F.md5("body").alias("digest"))


@query("I2", "i2_split_paragraphs", r"""
select rel_path, cast(generate_subscripts(p, 1) - 1 as integer) as ord, unnest(p) as paragraph from (
  select rel_path, list_filter(list_transform(string_split_regex(body, '\n\s*\n'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') as p from v_pages) x""")
def _(t):
    return pages(t).select("rel_path", F.posexplode(K.paragraph_array("body")).alias("ord", "paragraph"))


table_sql = lambda x: (f"(contains({x}, '|') and len(list_filter(string_split({x}, chr(10)), lambda l: contains(l, '|'))) >= "  # noqa: E731
                    f"greatest(2, len(list_filter(string_split({x}, chr(10)), lambda l: trim(l) <> '')) // 2))")
_BUF = "list_last(string_split(a, chr(1)))"


@query("I3", "i3_merge_small", rf"""
with p as (select rel_path, list_filter(list_transform(string_split_regex(body, '\n\s*\n'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') as v from v_pages),
m as (select rel_path, string_split(list_reduce(v, lambda a, x: case when length({_BUF}) < 120 and length({_BUF}) + length(x) + 2 <= 360
  and not {table_sql(_BUF)} and not {table_sql('x')} then a || chr(10) || chr(10) || x else a || chr(1) || x end), chr(1)) as parts from p where len(v) > 0)
select rel_path, cast(generate_subscripts(parts, 1) - 1 as integer) as ord, unnest(parts) as part from m""")
def _(t):
    return pages(t).select("rel_path", F.posexplode(K.merged_array(K.paragraph_array("body"), 120)).alias("ord", "part"))


@query("I4", "i4_window_chunks", "select chunk_id, text from v_chunks")
def _(t):
    return C.chunks(t).select("chunk_id", "text")


@query("I5 H33", "i5_chunk_md_table", """
with recursive l as (select device_id, '| ' || id || ' | ' || plan || ' | ' || status || ' |' as line from v_orders where device_id <> ''),
t as (select device_id, list(line order by line) as v from l group by 1),
f(device_id, v, i, piece, buf) as (select device_id, v, 1, cast(null as varchar), '' from t
  union all select device_id, v, i + 1,
    case when buf <> '' and 37 + length(buf) + 1 + length(v[i]) > 200 or i > len(v) then buf end,
    case when i > len(v) then '' when buf = '' then v[i] when 37 + length(buf) + 1 + length(v[i]) > 200 then v[i] else buf || chr(10) || v[i] end
  from f where i <= len(v) + 1 and (i <= len(v) or buf <> '')),
w as (select device_id, '| id | plan | status |' || chr(10) || '|---|---|---|' || chr(10) || piece as piece, i from f where piece is not null)
select device_id, cast(row_number() over (partition by device_id order by i) - 1 as integer) as ord, piece from w""")
def _(t):
    rows = t.v_orders.where("device_id <> ''").select("device_id", "okey", F.concat_ws(" ", F.lit("|"), "id", F.lit("|"), "plan", F.lit("|"), "status", F.lit("|")).alias("line"))
    # A table of each plan's orders per customer; customers hold a bounded number of orders here.
    tables = rows.groupBy("device_id").agg(F.concat(
        F.lit("| id | plan | status |\n|---|---|---|\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("text"))
    return tables.select("device_id", F.posexplode(K.md_table_array("text", 200)).alias("ord", "piece"))


@query("I6", "i6_chunk_html_table", """
with recursive l as (select device_id, '<tr><td>' || id || '</td><td>' || plan || '</td></tr>' as line from v_orders where device_id <> ''),
t as (select device_id, list(line order by line) as v from l group by 1),
h as (select length('<table class=''t''><tr><th>id</th><th>plan</th></tr></table>') as n),
f(device_id, v, i, piece, buf) as (select device_id, v, 1, cast(null as varchar), '' from t
  union all select device_id, v, i + 1,
    case when buf <> '' and (select n from h) + length(buf) + length(v[i]) > 160 or i > len(v) then buf end,
    case when i > len(v) then '' when buf = '' then v[i] when (select n from h) + length(buf) + length(v[i]) > 160 then v[i] else buf || v[i] end
  from f where i <= len(v) + 1 and (i <= len(v) or buf <> '')),
w as (select device_id, '<table class=''t''><tr><th>id</th><th>plan</th></tr>' || piece || '</table>' as piece, i from f where piece is not null)
select device_id, cast(row_number() over (partition by device_id order by i) - 1 as integer) as ord, piece from w""")
def _(t):
    cells = t.v_orders.where("device_id <> ''").select("device_id", F.concat(F.lit("<tr><td>"), "id", F.lit("</td><td>"), "plan", F.lit("</td></tr>")).alias("row"))
    tables = cells.groupBy("device_id").agg(F.concat(
        F.lit("<table class='t'><tr><th>id</th><th>plan</th></tr>"), F.array_join(F.array_sort(F.collect_list("row")), ""), F.lit("</table>")).alias("text"))
    return tables.select("device_id", F.posexplode(K.html_table_array("text", 160)).alias("ord", "piece"))


_RULE = K.TABLE_RULE.replace("\\s", "[ \\t]")
_ROW = "list_last(string_split(a, chr(3)))"
_TRIM = "trim({}, ' ' || chr(10) || chr(9) || chr(13))"


def titled_sql(body, title):
    clean = _TRIM.format(rf"regexp_replace(replace(replace({body}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")
    return f"case when {clean} = '' or {title} = '' or contains(substr({clean}, 1, 80), {title}) then {clean} else {title} || chr(10) || chr(10) || {clean} end"


def document_sql(name, source, size, overlap):
    """CTEs that end in `name (k, ord, piece)`: the chunks of every text t of the relation `source (k, t)`, section by section. HTML tables are left out:
    the data holds none."""
    small, step = max(120, size // 4), size - overlap
    flat = rf"trim(regexp_replace({{}}, '\s+', ' ', 'g'))"
    cut = (f"list_transform(range(0, case when length({{0}}) <= {size} then 1 else cast(ceil((length({{0}}) - {size}) / {step}.0) as bigint) + 1 end), "
           f"lambda i: substr({{0}}, cast(i * {step} + 1 as bigint), {size}))")
    return rf"""
{name}_parts as (select k, generate_subscripts(v, 1) as si, unnest(v) as part from (
  select k, string_split(regexp_replace(t, '(^|\n)(#{{1,4}}[ \t]+[^\n]+)', '\1' || chr(1) || '\2', 'g'), chr(1)) as v from {source}) x),
{name}_sections as (select * from (select k, si,
    case when regexp_matches(part, '^#{{1,4}}[ \t]+[^ \t\n]') then '【' || {_TRIM.format("regexp_extract(part, '^#{1,4}[ \t]+([^\n]+)', 1)")} || '】' || chr(10) else '' end as prefix,
    {_TRIM.format("case when regexp_matches(part, '^#{1,4}[ \t]+[^ \t\n]') then regexp_replace(part, '^#{1,4}[ \t]+[^\n]+', '') else part end")} as body from {name}_parts) x where body <> ''),
{name}_paras as (select k, si, prefix, list_filter(list_transform(string_split_regex(body, '\n[ \t]*\n'), lambda x: {_TRIM.format('x')}), lambda x: x <> '') as v from {name}_sections),
{name}_merged as (select k, si, prefix, string_split(list_reduce(v, lambda a, x: case when length({_BUF}) < {small} and length({_BUF}) + length(x) + 2 <= {3 * small}
  and not {table_sql(_BUF)} and not {table_sql('x')} then a || chr(10) || chr(10) || x else a || chr(1) || x end), chr(1)) as v from {name}_paras where len(v) > 0),
{name}_flat as (select k, si, prefix, generate_subscripts(v, 1) as mi, unnest(v) as p from {name}_merged),
{name}_wide as (select k, si, mi, prefix, p, {flat.format("prefix || p")} as f, {table_sql('p')} as tabled, greatest(80, {size} - length(prefix)) as room,
    list_filter(string_split(p, chr(10)), lambda x: trim(x) <> '') as lines from {name}_flat),
{name}_tables as (select *, case when len(lines) >= 2 and regexp_matches(trim(lines[2]), '{_RULE}') then 2 else 1 end as n from {name}_wide),
{name}_heads as (select *, array_to_string(lines[1:n], chr(10)) as head, lines[n + 1:] as body from {name}_tables),
{name}_packed as (select *, case when not tabled or length(p) <= room then [{_TRIM.format('p')}] when len(body) = 0 then [head]
    else list_transform(list_filter(string_split(list_reduce(body, lambda a, x: case when {_ROW} = '' then a || x
      when length(head) + 1 + length({_ROW}) + 1 + length(x) <= room then a || chr(10) || x when length(head) + 1 + length(x) > room then a || chr(3) || x || chr(3)
      else a || chr(3) || x end), chr(3)), lambda x: x <> ''), lambda x: {_TRIM.format('head || chr(10) || x')}) end as rows from {name}_heads),
{name}_cut as (select k, si, mi, case when tabled then list_transform(rows, lambda x, i: {_TRIM.format("case when i = 1 then prefix || x else x end")})
    when length(prefix) + length(p) <= {size} then [{_TRIM.format("prefix || p")}] else {cut.format('f')} end as v from {name}_packed),
{name}_rows as (select k, si, mi, generate_subscripts(v, 1) as wi, unnest(v) as piece from {name}_cut),
{name}_found as (select k, cast(row_number() over (partition by k order by si, mi, wi) - 1 as integer) as ord, piece from {name}_rows where {_TRIM.format('piece')} <> ''),
{name}_none as (select k, {flat.format('t')} as f from {source} where t <> '' and k not in (select k from {name}_found)),
{name}_left as (select k, {cut.format('f')} as v from {name}_none),
{name} as (select * from {name}_found union all select k, cast(generate_subscripts(v, 1) - 1 as integer), unnest(v) from {name}_left)"""


_FAMILY = f"""{document_sql('parent', 'src', 960, 80)},
kid_src as (select k || chr(2) || cast(ord as varchar) as k, {_TRIM.format('piece')} as t from parent), {document_sql('kid', 'kid_src', 320, 80)},
family as (select split_part(c.k, chr(2), 1) as rel_path, p.ord as p, p.piece as parent_text, c.ord as c, c.piece as text
  from kid c join parent p on p.k = split_part(c.k, chr(2), 1) and cast(p.ord as varchar) = split_part(c.k, chr(2), 2))"""


@query("I7", "i7_chunk_documents", f"""
with src as (select rel_path as k, {titled_sql('body', 'title')} as t from v_pages), {document_sql('made', 'src', 520, 80)}
select k as rel_path, ord, piece as text from made""")
def _(t):
    return K.chunk_documents(pages(t), ["rel_path"], "body", "title", 520, 80)


@query("I8", "i8_chunk_parent_child", f"""
with src as (select rel_path as k, {titled_sql('body', 'title')} as t from v_pages), {_FAMILY}
select rel_path, p, parent_text, c, text from family""")
def _(t):
    return K.chunk_parent_child(pages(t), ["rel_path"], "body", "title", 960, 320, 80)


@query("I9", "i9_pack_sentences", r"""
with f as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from documents where text is not null),
s as (select doc_id, flat, list_filter(string_split(regexp_replace(flat, '([。！？!?；;])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as v from f),
r as (select doc_id, case when length(flat) <= 500 then [flat] else list_transform(string_split(list_reduce(v, lambda a, x:
    case when length(list_last(string_split(a, chr(2)))) + length(x) > 500 then a || chr(2) || x else a || x end), chr(2)), lambda x: trim(x)) end as parts from s)
select doc_id, cast(generate_subscripts(parts, 1) - 1 as integer) as ord, unnest(parts) as part from r""")
def _(t):
    return t.spread(t.documents, "doc_id").select("doc_id", F.posexplode(K.pack_sentences("text", 500)).alias("ord", "part"))


_FULL = "case when title = '' or contains(substr(body, 1, 50), title) then body else title || chr(10) || body end"


@query("I10", "i10_chunk_rows", rf"""
with src as (select rel_path as k, {titled_sql(_FULL, 'title')} as t from v_pages), {_FAMILY},
numbered as (select rel_path, p, {_TRIM.format('text')} as text, row_number() over (partition by rel_path order by p, c) - 1 as ord from family),
h as (select n.*, g.title, {_TRIM.format('g.title')} as name, trim(regexp_extract(n.text, '^【(.+?)】\n', 1)) as heading, cast(len(regexp_extract_all(lower(n.text), '[a-z0-9_]+')) as integer) as n_tokens
  from numbered n join v_pages g using (rel_path))
select rel_path || '#' || ord as chunk_id, title, text, n_tokens, rel_path || '#p' || p as parent_id,
  case when heading <> '' and name <> '' then name || ' > ' || heading when name <> '' then name else heading end as context_prefix from h where n_tokens > 0""")
def _(t):
    rows = K.chunk_rows(pages(t))
    return rows.select("chunk_id", "title", "text", F.size("tokens").alias("n_tokens"), "parent_id", "context_prefix")


@query("E10", "e10_cap_per_group", """
select chunk_id, rel_path, ord from (select chunk_id, rel_path, cast(ord as bigint) as ord, row_number() over (partition by rel_path order by ord) as rn from v_chunks) x where rn <= 2""")
def _(t):
    return leading_chunks(C.chunks(t), 2).select("chunk_id", "rel_path", "ord")
