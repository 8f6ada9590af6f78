"""Link graph, answer preparation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import query_variants
from ..operators import activity as A
from ..operators import answers as N
from ..operators import corpus as P
from ..operators import graph as G
from ..operators import search as S
from ..operators.incremental import rerank_rows
from ..operators.sequences import top_rows
from ..session import materialize, scratch_path
from ..sources.readers import read_jsonl
from ..sources.writers import append_log
from . import common as C
from .registry import query
from .retrieval import BM25, COSINE, KEYWORD, RRF, TFIDF, hybrid, with_rank

RESOLVE = """
cand as (select l.rel_path, l.ord, l.link, k.p, case k.p when 0 then ltrim(trim(link), '/') when 1 then case when not ends_with(link, '.md') and contains(link, '/') then ltrim(trim(link), '/') || '.md' end
    else ['concepts', 'entities', 'sources', 'comparisons', 'notes', 'archive'][k.p // 2] || '/' || link || case when k.p % 2 = 1 then '.md' else '' end end as path
  from v_links l, range(0, 14) k(p)),
bypath as (select c.rel_path, c.ord, c.link, c.p, v.rel_path as target from cand c join v_pages v on v.rel_path = c.path),
titles as (select lower(title) as t, max(rel_path) as target from v_pages where title <> '' group by 1),
resolved as (select rel_path, ord, link, min_by(target, p) as target from (select * from bypath
  union all select l.rel_path, l.ord, l.link, 99, t.target from v_links l join titles t on t.t = lower(trim(l.link))) x group by rel_path, ord, link)"""

ALL = f"{TFIDF}, {BM25}, {KEYWORD}, {COSINE}, {RRF}"
HITS = f"{ALL}, hits as (select h.*, c.rel_path, c.title, c.text, row_number() over (partition by h.query_id order by h.score desc, h.chunk_id) as rank from hybrid h join v_chunks c using (chunk_id))"


@C.once
def edges(t):
    """Resolved links, written once: every graph query walks them."""
    return materialize(G.resolve_links(t.v_links, t.v_pages), "edges")


@C.once
def hits(t):
    """Fused hits with their chunk fields and rank, at most ten per query; written once for the steps that reuse them."""
    ranked = with_rank(hybrid(t))
    return materialize(ranked.join(C.texts(t).select("chunk_id", "rel_path", "title", "text"), "chunk_id"), "hits")


@C.once
def seed_edges(t):
    """Resolved links of the pages with hits, all that a subgraph of one hop follows."""
    seeds = materialize(G.page_scores(hits(t)).select("rel_path").distinct(), "seeds")
    return materialize(G.resolve_links(t.v_links.join(seeds, "rel_path", "left_semi"), t.v_pages), "seed_edges")


@query("C2", "c2_resolve_links", f"with {RESOLVE} select rel_path, ord, link, target from resolved")
def _(t):
    return G.resolve_links(t.v_links, t.v_pages)


@query("C3", "c3_broken_links", """
with l as (select rel_path, ord, case when ord = 0 then '../' || link else link end as link from v_links where not starts_with(link, 'http')),
r as (select *, case when ord = 0 then substr(link, 4) else regexp_replace(rel_path, '[^/]*$', '') || link end as target from l)
select rel_path, ord, link from r where not exists (select 1 from v_pages p where p.rel_path = r.target)""")
def _(t):
    links = t.v_links.withColumn("link", F.when(F.col("ord") == 0, F.concat(F.lit("../"), "link")).otherwise(F.col("link")))
    return G.broken_links(links, t.v_pages).select("rel_path", "ord", "link")


def expanded(seeds, final):
    """CTEs that end in `grown (query_id, chunk_id, score, retrieval)`: two hops over `seeds (query_id, chunk_id, rel_path, score, rank)`."""
    boost = "case p.type when 'entity' then 1.1 when 'concept' then 1.1 when 'source' then 1.05 else 1.0 end"
    room = max(4, 2 * final)
    return f"""
seed as (select query_id, rel_path, min(rank) as at_pos, min_by(score, rank) as base from {seeds} group by query_id, rel_path),
lead2 as (select * from (select chunk_id, rel_path, row_number() over (partition by rel_path order by ord) as nth from v_chunks) where nth <= 2),
visit1 as (select s.query_id, e.target, s.at_pos, e.ord, s.base * 0.85::double as carried, s.base * 0.85::double * {boost} as score
  from seed s join v_pages p on p.rel_path = s.rel_path join resolved e on e.rel_path = s.rel_path),
first1 as (select * from (select *, row_number() over (partition by query_id, target order by at_pos, ord) as f from visit1) where f = 1),
hop1 as (select * from (select v.query_id, v.target, l.chunk_id, v.score, v.carried, row_number() over (partition by v.query_id order by v.at_pos, v.ord, l.nth, l.chunk_id) as n from first1 v join lead2 l on l.rel_path = v.target
  where not exists (select 1 from {seeds} h where h.query_id = v.query_id and h.chunk_id = l.chunk_id)) where n <= {room}),
taken as (select query_id, count(*) as taken from hop1 group by query_id),
front2 as (select query_id, target as rel_path, min(n) as at_pos, min_by(carried, n) as base from hop1 group by query_id, target),
visit2 as (select s.query_id, e.target, s.at_pos, e.ord, s.base * 0.7224999999999999::double * {boost} as score
  from front2 s join v_pages p on p.rel_path = s.rel_path join resolved e on e.rel_path = s.rel_path),
first2 as (select * from (select *, row_number() over (partition by query_id, target order by at_pos, ord) as f from visit2) where f = 1),
hop2 as (select * from (select v.query_id, l.chunk_id, v.score, row_number() over (partition by v.query_id order by v.at_pos, v.ord, l.nth, l.chunk_id) as n from first2 v join lead2 l on l.rel_path = v.target
  where not exists (select 1 from {seeds} h where h.query_id = v.query_id and h.chunk_id = l.chunk_id) and not exists (select 1 from hop1 h where h.query_id = v.query_id and h.chunk_id = l.chunk_id))
  where n <= {room}),
hop2cut as (select h.* from hop2 h left join taken t on t.query_id = h.query_id where h.n + coalesce(t.taken, 0) <= {room}),
gathered as (select query_id, chunk_id, round(score, 6) as score, 'seed' as retrieval from {seeds} union all select query_id, chunk_id, round(score, 6), 'graph-hop1' from hop1
  union all select query_id, chunk_id, round(score, 6), 'graph-hop2' from hop2cut),
grown as (select query_id, chunk_id, score, retrieval from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from gathered) where rn <= {final})"""


@query("J9", "j9_graph_expand", f"""
with {HITS}, {RESOLVE}, {expanded('hits', 20)} select query_id, chunk_id, score, retrieval from grown""")
def _(t):
    return G.graph_expand(hits(t), edges(t), t.v_pages, C.texts(t), hops=2, final_k=20).select(
        "query_id", "chunk_id", "score", "retrieval")


@query("J9", "j9_graph_expand_one_hop", f"""
with {HITS}, {RESOLVE},
seed as (select query_id, rel_path, min(rank) as at_pos, min_by(score, rank) as base from hits group by query_id, rel_path),
visit as (select s.query_id, e.target, s.at_pos, e.ord, s.base * 0.85 * case p.type when 'entity' then 1.1 when 'concept' then 1.1 when 'source' then 1.05 else 1.0 end as score
  from seed s join v_pages p on p.rel_path = s.rel_path join resolved e on e.rel_path = s.rel_path),
firstv as (select * from (select *, row_number() over (partition by query_id, target order by at_pos, ord) as f from visit) where f = 1),
lead2 as (select * from (select chunk_id, rel_path, row_number() over (partition by rel_path order by ord) as nth from v_chunks) where nth <= 2),
arr as (select v.query_id, l.chunk_id, v.score, row_number() over (partition by v.query_id order by v.at_pos, v.ord, l.nth, l.chunk_id) as n from firstv v join lead2 l on l.rel_path = v.target
  where not exists (select 1 from hits h where h.query_id = v.query_id and h.chunk_id = l.chunk_id)),
allc as (select query_id, chunk_id, round(score, 6) as score, 'seed' as retrieval from hits union all select query_id, chunk_id, round(score, 6), 'graph-hop1' from arr where n <= 40)
select query_id, chunk_id, score, retrieval from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from allc) where rn <= 20""")
def _(t):
    return G.graph_expand(hits(t), seed_edges(t), t.v_pages, C.texts(t), hops=1, final_k=20).select(
        "query_id", "chunk_id", "score", "retrieval")


NODES = f"""
with {HITS}, {RESOLVE},
seed as (select query_id, rel_path, round(max(score), 6) as score, 0 as hop from hits group by query_id, rel_path),
step as (select s.query_id, e.target as rel_path, round(max(s.score * 0.85), 6) as score, 1 as hop from seed s join resolved e using (rel_path)
  where not exists (select 1 from seed z where z.query_id = s.query_id and z.rel_path = e.target) group by s.query_id, e.target),
nodes as (select query_id, rel_path, score, hop, node from (select *, row_number() over (partition by query_id order by hop, score desc, rel_path) as node
  from (select * from seed union all select * from step) x) y where node <= 12),
edge as (select n.query_id, n.rel_path as source, e.target, min_by(e.link, e.ord) as label from nodes n join resolved e using (rel_path) where n.hop < 1 group by 1, 2, 3)"""


@C.once
def nodes(t):
    return materialize(G.subgraph_nodes(hits(t), seed_edges(t), hops=1, nodes=12), "nodes")


@C.once
def sub_edges(t):
    return G.subgraph_edges(nodes(t), seed_edges(t), hops=1)


@query("J21 F6", "j21_subgraph_nodes", NODES + " select query_id, rel_path, cast(score as double) as score, hop, node from nodes")
def _(t):
    return nodes(t).select("query_id", "rel_path", "score", "hop", F.col("node").cast("bigint").alias("node"))


@query("J21", "j21_subgraph_edges", NODES + " select query_id, source, target, label from edge")
def _(t):
    return sub_edges(t)


@C.once
def graph_nodes(t):
    """Nodes with their titles, written once: references are made of them and resolved among them."""
    return materialize(nodes(t).join(t.v_pages.select("rel_path", "title"), "rel_path").select(
        F.col("query_id").alias("graph"), F.col("rel_path").alias("id"), "title", F.col("node").alias("ord")).repartition("graph"), "graph_nodes")


def inferred(t):
    """Edges as a model might name them: by title, by bare number or by path, some of them known or self loops."""
    g = graph_nodes(t)
    nxt = g.select("graph", (F.col("ord") - 1).alias("ord"), F.col("id").alias("nid"), F.col("title").alias("ntitle"))
    ref = F.when(F.col("ord") % 3 == 0, F.lower("title")).when(F.col("ord") % 3 == 1, F.concat(F.lit("/"), "id")).otherwise(F.substring("title", 1, 30))
    return g.join(nxt, ["graph", "ord"]).select("graph", ref.alias("source"), F.when(F.col("ord") % 4 == 0, F.col("title")).otherwise(F.col("nid")).alias("target"),
                                               F.lit(" leads ").alias("label"), F.when(F.col("ord") % 2 == 0, "强").otherwise("?").alias("strength"), "ord")


REFS = """
, gn as (select n.query_id as graph, n.rel_path as id, p.title, n.node as ord from nodes n join v_pages p using (rel_path)),
inf as (select a.graph, a.ord, case a.ord % 3 when 0 then lower(a.title) when 1 then '/' || a.id else substr(a.title, 1, 30) end as source, case when a.ord % 4 = 0 then a.title else b.id end as target,
  case when a.ord % 2 = 0 then '强' else '?' end as strength from gn a join gn b on b.graph = a.graph and b.ord = a.ord + 1),
refs as (select distinct graph, ref from (select graph, source as ref from inf union all select graph, target from inf) x where trim(ref) <> ''),
ruled as (select r.graph, r.ref, g.id, g.ord, case when g.id = trim(r.ref) then 0 when g.id = ltrim(trim(r.ref), '/') then 1 when lower(g.title) = lower(trim(r.ref)) then 2
    when contains(lower(g.title), lower(trim(r.ref))) or contains(lower(trim(r.ref)), lower(g.title)) then 3
    when contains(lower(g.title), lower(replace(list_last(string_split(trim(r.ref), '/')), '.md', ''))) then 4 end as pr from refs r join gn g using (graph)),
ids as (select graph, ref, id from (select *, row_number() over (partition by graph, ref order by pr, ord) as rn from ruled where pr is not null) where rn = 1)"""


@query("C16", "c16_resolve_node_ref", NODES + REFS + " select graph, ref, id from ids")
def _(t):
    rows = inferred(t)
    refs = rows.select("graph", F.col("source").alias("ref")).union(rows.select("graph", "target"))
    return G.resolve_node_ref(refs, graph_nodes(t))


@query("C20 J22", "j22_merge_inferred", NODES + REFS + """,
placed as (select i.graph, a.id as source, b.id as target, i.strength, i.ord from inf i join ids a on a.graph = i.graph and a.ref = i.source join ids b on b.graph = i.graph and b.ref = i.target where a.id <> b.id),
fresh as (select * from placed p where not exists (select 1 from edge e where e.query_id = p.graph and e.source = p.source and e.target = p.target))
select query_id as graph, source, target, label, '中' as strength, 'wiki' as source_type from edge
union all select graph, source, target, 'leads', case when strength = '强' then '强' else '中' end, 'inferred' from (select *, row_number() over (partition by graph, source, target order by ord) as rn from fresh) where rn = 1""")
def _(t):
    known = sub_edges(t).withColumnRenamed("query_id", "graph")
    return G.merge_inferred(graph_nodes(t), known, inferred(t))


@query("J23", "j23_graph_summary", NODES + """
select n.query_id as graph, count(*) as node_count, coalesce(any_value(e.edge_count), 0) as edge_count, string_agg(n.rel_path, ',' order by node) as nodes, coalesce(any_value(e.edges), '') as edges
from nodes n left join (select query_id, count(*) as edge_count, array_to_string(list(source || '>' || target order by source, target)[1:40], ',') as edges from edge group by 1) e using (query_id) group by 1""")
def _(t):
    ns = nodes(t).select(F.col("query_id").alias("graph"), F.col("rel_path").alias("id"), F.col("node").alias("ord"))
    out = G.graph_summary(ns, sub_edges(t).withColumnRenamed("query_id", "graph"))
    return out.withColumns({"nodes": F.array_join("nodes", ","), "edges": F.array_join("edges", ",")})


@query("J24", "j24_knowledge_map", """
with first50 as (select rel_path, title, row_number() over (order by list_position(['concepts', 'entities', 'sources', 'comparisons', 'notes'], string_split(rel_path, '/')[1]), rel_path) as n from v_pages),
b as (select *, substr(regexp_replace(title, '[^a-zA-Z0-9_]', '_', 'g'), 1, 40) as base from first50),
nd as (select rel_path, case when k = 1 then base else base || '_' || (k - 1) end as node from (select *, row_number() over (partition by base order by n) as k from b) x),
r as (select l.rel_path, l.ord, case when l.ord = 0 then l.link else regexp_replace(l.rel_path, '[^/]*$', '') || l.link end as target from v_links l where not regexp_matches(l.link, '^https?://'))
select r.rel_path, r.ord, s.node as src, d.node as dst from r join nd s on s.rel_path = r.rel_path join nd d on d.rel_path = r.target where s.node <> d.node""")
def _(t):
    links = t.v_links.withColumn("link", F.when(F.col("ord") == 0, F.concat(F.lit("../"), "link")).otherwise(F.col("link")))
    return G.knowledge_map(t.v_pages, links)[1]


@query("J8", "j8_search_pages", """
with tg as (select rel_path, string_agg(tag, ' ' order by ord) as tags from v_tags group by rel_path),
p as (select v.rel_path, v.title, lower(concat_ws(' ', v.title, coalesce(tg.tags, ''), v.body)) as hay, lower(v.title) as lt from v_pages v left join tg using (rel_path)),
s as (select q.query_id, p.rel_path, p.title, case when contains(lt, lower(trim(q.phrase))) then 12 else 2 end as score from v_queries q join p on contains(hay, lower(trim(q.phrase))))
select query_id, rel_path, score, rank from (select *, row_number() over (partition by query_id order by score desc, title, rel_path) as rank from s) x where rank <= 20""")
def _(t):
    pages = t.spread(C.page_arrays(t), "rel_path", scan=t.documents)
    out = S.search_pages(pages, t.v_queries.select("query_id", F.col("phrase").alias("text")))
    return out.select("query_id", "rel_path", "score", F.col("rank").cast("bigint").alias("rank"))


SCOPED = """
sq as (select query_id, case query_id % 3 when 0 then 'concepts' when 1 then 'notes' else 'sources' end as dir from v_queries),
sc as (select q.query_id, c.chunk_id, c.title, c.text from sq q join v_chunks c on starts_with(c.rel_path, q.dir || '/')),
sn as (select query_id, count(*) as n from sc group by query_id),
st as (select s.query_id, t.chunk_id, t.token, t.tf, s.title, s.text from sc s join v_tf t using (chunk_id) join v_query_tokens k on k.query_id = s.query_id and k.token = t.token),
sd as (select query_id, token, count(*) as df from st group by query_id, token),
sraw as (select query_id, chunk_id, any_value(title) as title, any_value(text) as text, sum((1 + ln(1 + tf)) * ln(1 + n / (1.0 + df))) as raw from st join sd using (query_id, token) join sn using (query_id) group by query_id, chunk_id),
sts as (select r.query_id, r.chunk_id, round(raw * case when exists (select 1 from v_query_tokens k where k.query_id = r.query_id and contains(lower(r.title), k.token)) then 1.35 else 1.0 end, 6) as score from sraw r),
wide as (select query_id, chunk_id, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from bm) where rn <= 60),
sbm as (select query_id, chunk_id, score from (select w.*, row_number() over (partition by query_id order by score desc, chunk_id) as rn from wide w join sc using (query_id, chunk_id)) where rn <= 20),
skw as (select query_id, chunk_id, score from sbm union all select query_id, chunk_id, score from sts where query_id not in (select query_id from sbm))"""


@C.once
def scoped(t):
    """Keyword search of each query inside its own folder."""
    dirs = F.when(F.col("query_id") % 3 == 0, "concepts").when(F.col("query_id") % 3 == 1, "notes").otherwise("sources")
    asked = C.queries(t).withColumn("scope_id", dirs)
    paths = asked.select("scope_id", F.col("scope_id").alias("path")).distinct()
    pages = t.v_pages.select(F.col("rel_path").alias("chunk_id"), "rel_path", "title", F.lit("").alias("asset_path"))
    # A scope takes whole pages, and queries of one folder share it: no chunk is repeated for each query.
    held = materialize(P.scope_filter(pages, paths).select("scope_id", F.col("chunk_id").alias("rel_path")), "scope")
    rows = C.index(t)
    inside = rows.join(held, "rel_path")
    tf = S.tfidf_top(asked, inside, 10, "scope_id")
    return S.best(S.keyword_scores(S.bm25_phrase(asked, rows, 20, inside.select("scope_id", "chunk_id")), tf), 10)


@query("J7", "j7_search_scoped", f"""
with {BM25}, {SCOPED} select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from skw) where rank <= 10""")
def _(t):
    return scoped(t).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("J17", "j17_layered_sources", f"""
with {BM25}, {SCOPED} select r.query_id, c.title, c.rel_path, round(r.score, 4) as score, case when contains(c.rel_path, 'notes') then 'principle' else 'skills' end as layer
from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from skw) r join v_chunks c using (chunk_id) where rank <= 4""")
def _(t):
    rows = scoped(t).where("rank <= 4").join(C.index(t).select("chunk_id", "title", "rel_path"), "chunk_id")
    return rows.select("query_id", "title", "rel_path", F.round("score", 4).alias("score"),
                       F.when(F.col("rel_path").contains("notes"), "principle").otherwise("skills").alias("layer"))


@query("J10", "j10_expand_parents", f"""
with {HITS}, par as (select *, rel_path || '#p' || (cast(string_split(chunk_id, '#')[2] as integer) // 2) as parent_id from hits),
f as (select * from (select *, row_number() over (partition by query_id, parent_id order by rank) as rn from par) where rn = 1)
select f.query_id, f.chunk_id, md5(string_agg(c.text, ' ' order by c.ord)) as parent from f join v_chunks c on c.rel_path = f.rel_path and c.ord // 2 = cast(string_split(f.chunk_id, '#')[2] as integer) // 2 group by 1, 2""")
def _(t):
    half = F.floor(F.col("ord") / 2)
    parents = C.texts(t).groupBy("rel_path", half.alias("p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("parent_text"))
    mine = hits(t).withColumn("p", F.floor(F.split("chunk_id", "#")[1].cast("int") / 2)).join(parents, ["rel_path", "p"]).withColumn(
        "parent_id", F.concat("rel_path", F.lit("#p"), F.col("p").cast("string")))
    return S.expand_parents(mine).select("query_id", "chunk_id", F.md5("text").alias("parent"))


@query("J14", "j14_ground_flag", f"""
with {BM25} select q.query_id, count(b.chunk_id) as hits, case when count(b.chunk_id) > 0 then 'answer' else 'refuse' end as decision from v_queries q left join bm25 b using (query_id) group by q.query_id""")
def _(t):
    return S.ground_flag(C.queries(t), S.bm25_phrase(C.queries(t), C.index(t)))


@query("J16", "j16_conflict_flag", f"""
with {HITS} select query_id, count(distinct rel_path) as paths, count(*) as blocks, count(distinct rel_path) >= 2 or count(*) >= 2 as may_conflict from hits group by query_id""")
def _(t):
    return S.conflict_flag(hits(t))


@query("J15 H19", "j15_context_table", f"""
with {HITS} select query_id, md5(string_agg('--- 片段 ' || rank || '（相关度 ' || printf('%.2f', score) || ' · ' || retrieval || '）---' || chr(10) || '标题：《' || title || '》' || chr(10) || '路径：' || rel_path || chr(10) || '内容：' || chr(10) || text, chr(10) || chr(10) order by rank)) as digest,
  string_agg(rel_path, ',' order by rank) as sources from hits group by query_id""")
def _(t):
    rows = hits(t).withColumn("parent_id", F.lit("")).withColumn("parent_text", F.lit("")).withColumn("asset_path", F.lit(""))
    return S.context_table(rows).select("query_id", F.md5("context").alias("digest"), F.array_join("sources", ",").alias("sources"))


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """Stands where a caller's reranker would: distinct words that query and text have in common."""
    return [len(set(q.lower().split(" ")) & set(x.lower().split(" "))) / 10.0 for q, x in pairs]


@query("J13 L3", "j13_apply_rerank", f"""
with {HITS}, s as (select h.query_id, h.rank as position, len(list_intersect(list_distinct(string_split(lower(q.text), ' ')), list_distinct(string_split(lower(h.text), ' ')))) / 10.0 as relevance
  from hits h join v_queries q using (query_id) where h.query_id % 4 <> 0 and h.rank % 5 <> 0)
select query_id, chunk_id, new_rank as rank from (select h.query_id, h.chunk_id, row_number() over (partition by h.query_id order by s.relevance desc nulls last, h.rank) as new_rank
  from hits h left join s on s.query_id = h.query_id and s.position = h.rank where h.query_id % 4 = 0 or s.relevance is not null) x where new_rank <= 6""")
def _(t):
    """A caller's scoring function run on the hits of most queries; the rest keep their order."""
    ranked = hits(t).withColumnRenamed("rank", "position")
    asked = ranked.where((F.col("query_id") % 4 != 0) & (F.col("position") % 5 != 0)).join(t.v_queries.select("query_id", F.col("text").alias("query")), "query_id")
    scores = rerank_rows(asked.withColumn("position", F.col("position").cast("bigint")), shared_words)
    return S.apply_rerank(ranked, scores, 6).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


EXTERNAL = """ext as (select query_id, 'ext:' || doc_id as chunk_id, case when doc_id % 2 = 0 then hit_text else 'other ' || doc_id end as text, title, 0.5 / (1 + doc_id) as score, 1 + (doc_id % 7) as rank
  from (select h.query_id, h.text as hit_text, h.title, h.rank as doc_id from hits h where h.rank <= 4) x)"""


def external(t):
    """Hits of an outside service: some repeat a local text, some do not."""
    r = F.col("rank")
    return hits(t).where("rank <= 4").select(
        "query_id", F.concat(F.lit("ext:"), r.cast("string")).alias("chunk_id"),
        F.when(r % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("other "), r.cast("string"))).alias("text"), "title",
        (0.5 / (1 + r)).alias("score"), (1 + r % 7).cast("int").alias("rank"))


@query("G2", "g2_merge_first_wins", f"""
with {HITS}, {EXTERNAL}, u as (select query_id, chunk_id, text, title, score, rank, 0 as side from hits union all select query_id, chunk_id, text, title, score, rank, 1 from ext),
f as (select * from (select *, row_number() over (partition by query_id, lower(substr(text, 1, 120) || title) order by side, rank, chunk_id) as rn from u) where rn = 1)
select query_id, chunk_id, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as k from f) where k <= 8""")
def _(t):
    local = hits(t).select("query_id", "chunk_id", "text", "title", "score", "rank")
    return S.merge_first_wins(local, external(t), 8).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("G3", "g3_merge_best", f"""
with {ALL}, u as (select query_id, chunk_id, score from vtop union all select query_id, chunk_id, score * 10 from hybrid),
m as (select query_id, chunk_id, max(score) as score from u group by query_id, chunk_id)
select query_id, chunk_id, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as k from m) where k <= 10""")
def _(t):
    from .retrieval import vectors

    second = hybrid(t).select("query_id", "chunk_id", (F.col("score") * 10).alias("score"))
    return S.merge_best(vectors(t), second, 10).withColumn("score", F.round("score", 9))


def golden(t):
    return t.v_queries.select("query_id", F.when(F.col("query_id") % 3 == 0, F.lit("notes/")).alias("expect_rel_contains"),
                              F.when(F.col("query_id") % 3 != 0, F.substring("phrase", 1, 6)).alias("expect_keyword"),
                              (F.col("query_id") % 10 == 9).alias("expect_empty"))


@query("D28 J25", "d28_retrieval_eval", f"""
with {HITS}, g as (select query_id, case when query_id % 3 = 0 then 'notes/' end as er, case when query_id % 3 <> 0 then substr(phrase, 1, 6) end as ek, query_id % 10 = 9 as ee from v_queries)
select g.query_id, cast(case when any_value(ee) then count(h.chunk_id) = 0 else coalesce(bool_or(coalesce(contains(h.rel_path, er), false) or coalesce(ek <> '' and contains(h.text || h.title, ek), false)), false) end as integer) * 1.0::double as recall
from g left join hits h on h.query_id = g.query_id and h.rank <= 10 group by g.query_id""")
def _(t):
    return A.retrieval_eval(golden(t), hits(t), 10)


@C.once
def multi(t):
    """Every rewritten form of every query as its own round, scored in one job."""
    forms = t.v_queries.select("query_id", F.posexplode(query_variants("text")).alias("p", "text")).select(
        "query_id", (F.col("p") + 1).cast("bigint").alias("round"), "text")
    asked = forms.select((F.col("query_id") * 100 + F.col("round")).alias("query_id"), "text")
    scored = S.tfidf_top(asked, C.index(t), 10).select(
        F.floor(F.col("query_id") / 100).alias("query_id"), (F.col("query_id") % 100).alias("round"), "chunk_id", "score")
    return forms, scored


MULTI = r"""
v0 as (select query_id, text as q, trim(regexp_replace(text, '[？?。！!；;，,、\s]+', ' ', 'g')) as bare, regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}|[A-Za-z0-9_]{3,}') as w from v_queries),
v1 as (select query_id, list_filter([q, bare, case when len(w) >= 2 then array_to_string(w[1:8], ' ') end], lambda x: x is not null and x <> '') as f from v0),
v2 as (select query_id, list_filter(f, lambda x, i: list_position(f, x) = i)[1:6] as f from v1),
vr as (select query_id, cast(generate_subscripts(f, 1) as bigint) as round, unnest(f) as text from v2),
vt as (select distinct query_id, round, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as token from vr),
vp as (select k.query_id, k.round, t.chunk_id, sum((1 + ln(1 + t.tf)) * ln(1 + (select count(*) from v_chunks) / (1.0 + d.df))) as raw from vt k join v_tf t using (token) join v_df d using (token) group by 1, 2, 3),
th as (select distinct k.query_id, k.round, c.rel_path from vt k, (select distinct rel_path, title from v_chunks) c where contains(lower(c.title), k.token)),
vs as (select p.query_id, p.round, p.chunk_id, round(p.raw * case when th.rel_path is not null then 1.35 else 1.0 end, 6) as score from vp p join v_chunks c using (chunk_id) left join th on th.query_id = p.query_id and th.round = p.round and th.rel_path = c.rel_path),
top10 as (select * from (select *, row_number() over (partition by query_id, round order by score desc, chunk_id) as rn from vs) where rn <= 10)"""


@query("J11 H23", "j11_search_multi", f"""
with {MULTI}, mx as (select query_id, round, max(score) as b from top10 group by 1, 2), st as (select query_id, min(round) as stop from mx where b >= 60 group by 1),
kept as (select p.* from top10 p left join st using (query_id) where stop is null or round <= stop), m as (select query_id, chunk_id, max(score) as score from kept group by 1, 2)
select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from m) where rank <= 10""")
def _(t):
    forms, scored = multi(t)
    return A.search_multi(forms, scored, 10, 60.0)[0].select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("D28 J25", "d28_multi_round_recall", f"""
with {MULTI}, mx as (select query_id, round, max(score) as b from top10 group by 1, 2), st as (select query_id, min(round) as stop from mx where b >= 60 group by 1),
kept as (select p.* from top10 p left join st using (query_id) where stop is null or round <= stop), m as (select query_id, chunk_id, max(score) as score from kept group by 1, 2),
h as (select m.query_id, c.rel_path, c.text, c.title, m.chunk_id, row_number() over (partition by m.query_id order by m.score desc, m.chunk_id) as rank from m join v_chunks c using (chunk_id)),
g as (select query_id, case when query_id % 3 = 0 then 'notes/' end as er, case when query_id % 3 <> 0 then substr(phrase, 1, 6) end as ek, query_id % 10 = 9 as ee from v_queries)
select g.query_id, cast(case when any_value(ee) then count(h.chunk_id) = 0 else coalesce(bool_or(coalesce(contains(h.rel_path, er), false) or coalesce(ek <> '' and contains(h.text || h.title, ek), false)), false) end as integer) * 1.0::double as recall
from g left join h on h.query_id = g.query_id and h.rank <= 10 group by g.query_id""")
def _(t):
    """The same expectations held against the merged hits of all rounds."""
    forms, scored = multi(t)
    merged = A.search_multi(forms, scored, 10, 60.0)[0]
    return A.retrieval_eval(golden(t), merged.join(C.index(t).select("chunk_id", "rel_path", "text", "title"), "chunk_id"), 10)


@query("J11 A12", "j11_round_log", f"""
with {MULTI}, mx as (select query_id, round, count(*) as hits, max(score) as top_score from top10 group by 1, 2), st as (select query_id, min(round) as stop from mx where top_score >= 60 group by 1)
select v.query_id, v.round, substr(v.text, 1, 120) as query, coalesce(hits, 0) as hits, coalesce(top_score, 0.0) as top_score from vr v left join mx using (query_id, round) left join st using (query_id) where stop is null or v.round <= stop""")
def _(t):
    """The log of the rounds, appended as JSON lines and read back."""
    forms, scored = multi(t)
    log, path = A.search_multi(forms, scored, 10, 60.0)[1], scratch_path(t.spark, "rounds")
    append_log(log, path)
    return read_jsonl(t.spark, path, log.schema)


ROUNDS = rf"""
{MULTI.split("vt as (")[0].rstrip().rstrip(",")},
fo as (select v2.query_id, list_concat(f, case when contains(lower(q), 'anna') or contains(lower(q), 'der') or contains(lower(q), 'the') or contains(lower(q), 'und') or contains(lower(q), 'éa')
  then list_filter(['Anna', 'Anna 工作', 'Anna 记录', 'der', 'the', 'und', '闪念', 'memos'], lambda x: not list_contains(f, x) and x <> trim(q)) else [] end)[1:6] as f from v2 join v0 using (query_id)),
fr as (select query_id, cast(generate_subscripts(f, 1) as bigint) as round, unnest(f) as text from fo),
fq as (select query_id * 100 + round as query_id, query_id as parent, round, text, text as phrase from fr),
fqt as (select distinct query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as token from fq),
{ALL.replace('v_query_tokens', 'fqt').replace('v_queries', 'fq').replace('e.vec_id = q.query_id', 'e.vec_id = q.parent')},
fh as (select h.*, c.rel_path, row_number() over (partition by h.query_id order by h.score desc, h.chunk_id) as rank from hybrid h join v_chunks c using (chunk_id)),
{RESOLVE}, {expanded('fh', 10)},
rs as (select g.*, parent, round from grown g join fq using (query_id)),
rm as (select parent, round, max(score) as b from rs group by all), rt as (select parent, min(round) as stop from rm where b >= 0.03 group by parent),
rk as (select rs.* from rs left join rt using (parent) where stop is null or round <= stop),
best as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select parent as query_id, chunk_id, max(score) as score from rk group by all)) where rank <= 10)"""


@C.once
def rounds(t):
    """All forms of all queries, the owner's rows among them, through the whole search."""
    from .activity import OWNER
    stored = C.chunk_vectors(t).select("chunk_id", "vector")
    return N.search_rounds(t.v_queries, C.query_vectors(t), C.index(t), stored, edges(t), t.v_pages, OWNER, 10, 0.03)


@query("J11 C19", "j11_search_rounds", f"with {ROUNDS} select query_id, chunk_id, score, rank from best")
def _(t):
    return rounds(t)[0].select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("J11 A12", "j11_rounds_log", f"""
with {ROUNDS}, rc as (select parent, round, count(*) as hits, max(score) as top_score from rs group by all)
select fq.parent as query_id, fq.round, substr(text, 1, 120) as query, coalesce(hits, 0) as hits, coalesce(top_score, 0.0) as top_score from fq
  left join rc using (parent, round) left join rt using (parent) where stop is null or fq.round <= stop""")
def _(t):
    return rounds(t)[1]


_EXPECT = "cast(case when any_value(ee) then count(h.chunk_id) = 0 else coalesce(bool_or(coalesce(contains(h.rel_path, er), false) or coalesce(ek <> '' and contains(h.text || h.title, ek), false)), false) end as integer) * 1.0::double"


@query("J25 D28", "j25_golden_recall", f"""
with {ROUNDS}, g as (select query_id, case when query_id % 3 = 0 then 'notes/' end as er, case when query_id % 3 <> 0 then substr(phrase, 1, 6) end as ek, query_id % 10 = 9 as ee from v_queries),
one as (select parent as query_id, chunk_id, rel_path, text, title from rs join v_chunks using (chunk_id) where round = 1),
many as (select b.query_id, chunk_id, rel_path, text, title from best b join v_chunks using (chunk_id)),
a as (select g.query_id, {_EXPECT} as recall from g left join one h on h.query_id = g.query_id group by g.query_id),
b as (select g.query_id, {_EXPECT} as rounds_recall from g left join many h on h.query_id = g.query_id group by g.query_id)
select query_id, recall, rounds_recall from a join b using (query_id)""")
def _(t):
    """The expectations held against the plain search and against the search in rounds."""
    shown = C.index(t).select("chunk_id", "rel_path", "text", "title")
    found = N.full_search(C.queries(t).select("query_id", "text", F.col("text").alias("phrase")), C.query_vectors(t), C.index(t),
                          C.chunk_vectors(t).select("chunk_id", "vector"), edges(t), t.v_pages, 10)
    plain = A.retrieval_eval(golden(t), found.drop("rel_path").join(shown, "chunk_id"), 10)
    merged = A.retrieval_eval(golden(t), rounds(t)[0].join(shown, "chunk_id"), 10)
    return plain.join(merged.withColumnRenamed("recall", "rounds_recall"), "query_id").select("query_id", "recall", "rounds_recall")


MERGED = """u as (select query_id, chunk_id, text, title, score, rank, 0 as side from hits union all select query_id, chunk_id, text, title, score, rank, 1 from ext),
fw as (select * from (select *, row_number() over (partition by query_id, lower(substr(text, 1, 120) || title) order by side, rank, chunk_id) as rn from u) where rn = 1),
seeds as (select w.query_id, w.chunk_id, coalesce(c.rel_path, '') as rel_path, w.score, w.k as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as k from fw) w
  left join v_chunks c using (chunk_id) where w.k <= 20)"""


@query("J12", "j12_search_full", f"""
with {HITS}, {EXTERNAL}, {RESOLVE}, {MERGED}, {expanded('seeds', 20)}
select query_id, chunk_id, score, retrieval, cast(rn as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from grown) where rn <= 6""")
def _(t):
    local = hits(t).select("query_id", "chunk_id", "text", "title", "score", "rank")
    merged = with_rank(S.merge_first_wins(local, external(t), 20).drop("rank")).join(C.texts(t).select("chunk_id", "rel_path"), "chunk_id", "left")
    seeds = merged.withColumn("rel_path", F.coalesce("rel_path", F.lit("")))
    grown = G.graph_expand(seeds, edges(t), t.v_pages, C.texts(t), hops=2, final_k=20).drop("rank")
    return top_rows(grown, ["query_id"], [F.desc("score"), F.asc("chunk_id")], 6).select("query_id", "chunk_id", "score", "retrieval", "rank")
