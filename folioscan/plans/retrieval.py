"""Scoring, fusion and answer preparation over the chunk table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import search as S
from ..session import materialize
from . import common as C
from .registry import query

TFIDF = """
n_chunks as (select count(*) as n from v_chunks),
pair as (select q.query_id, t.chunk_id, sum((1 + ln(1 + t.tf)) * ln(1 + (select n from n_chunks) / (1.0 + d.df))) as raw
  from v_query_tokens q join v_tf t on t.token = q.token join v_df d on d.token = q.token group by q.query_id, t.chunk_id),
title_hit as (select distinct q.query_id, c.rel_path from v_query_tokens q, (select distinct rel_path, title from v_chunks) c
  where contains(lower(c.title), q.token)),
marks as (select chunk_id, rel_path, contains(text, '分析提炼') or contains(text, '### 核心要点') as marked from v_chunks),
tfidf as (select p.query_id, p.chunk_id, round(p.raw * case when h.query_id is not null then 1.35 else 1.0 end
    * case when m.marked then 1.22 else 1.0 end, 6) as score
  from pair p join marks m on m.chunk_id = p.chunk_id left join title_hit h on h.query_id = p.query_id and h.rel_path = m.rel_path
  where p.raw > 0)"""

BM25 = """
doc as (select chunk_id, lower(title) as title, lower(title || chr(10) || text) as content from v_chunks where trim(text) <> ''),
docs as (select *, greatest(0, length(title) - 2) + greatest(0, length(content) - 2) as dl from doc),
stat as (select count(*) as total, avg(dl) as mean from docs),
ph as (select query_id, lower(trim(phrase)) as q from v_queries where length(trim(phrase)) >= 3),
hit as (select ph.query_id, d.chunk_id, d.dl,
    len(list_filter(range(1, length(d.title) + 1), lambda i: substr(d.title, i, length(ph.q)) = ph.q))
    + len(list_filter(range(1, length(d.content) + 1), lambda i: substr(d.content, i, length(ph.q)) = ph.q)) as f
  from ph join docs d on contains(d.content, ph.q)),
cnt as (select query_id, count(*) as n from hit group by query_id),
bm as (select h.query_id, h.chunk_id, round(greatest(case when ln((total - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((total - n + 0.5) / (n + 0.5)) end, 0)
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean)), 6) as score from hit h join cnt using (query_id), stat),
bm25 as (select query_id, chunk_id, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from bm) where rn <= 20)"""

COSINE = """
vec as (select p.rel_path || '#0' as chunk_id, e.embedding from v_embeddings e join v_pages p on p.doc_id = e.vec_id),
qv as (select q.query_id, e.embedding from v_queries q join v_embeddings e on e.vec_id = q.query_id),
cosine as (select qv.query_id, vec.chunk_id, round(coalesce(list_dot_product(qv.embedding::double[], vec.embedding::double[])
    / nullif(sqrt(list_dot_product(qv.embedding::double[], qv.embedding::double[])) * sqrt(list_dot_product(vec.embedding::double[], vec.embedding::double[])), 0), 0), 6) + 0.0 as score
  from qv, vec),
vtop as (select query_id, chunk_id, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from cosine) where rn <= 20)"""

KEYWORD = """
kw as (select query_id, chunk_id, score, 'phrase' as method from bm25
  union all select query_id, chunk_id, score, 'tfidf' from tfidf where query_id not in (select query_id from bm25))"""

RRF = """
lists as (select query_id, 'keyword' as list, chunk_id, score from kw union all select query_id, 'vector', chunk_id, score from vtop),
ranked as (select *, row_number() over (partition by query_id, list order by score desc, chunk_id) as pos from lists),
fused as (select query_id, chunk_id, round(sum(1.0 / (60.0 + pos)), 6) as score, bool_or(list = 'keyword') as in_keyword, bool_or(list = 'vector') as in_vector
  from ranked where pos <= 20 group by query_id, chunk_id),
cut as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused),
hybrid as (select c.query_id, c.chunk_id, round(c.score * case when m.marked then 1.12 else 1.0 end, 6) as score,
    case when in_keyword and in_vector then 'hybrid-rrf' when in_vector then 'vector' else 'keyword' end as retrieval
  from cut c join marks m on m.chunk_id = c.chunk_id where rank <= 10)"""


# The lists below hold at most 20 rows per query. They are written, so that each is made once and Spark knows how small
# they are: what they are joined with is then not shuffled.
@C.once
def bm25(t):
    return materialize(S.bm25_phrase(C.queries(t), C.texts(t)), "phrases")


@C.once
def keyword(t):
    """Best 20 keyword hits per query; enough for every fused list below. Words are only scored for queries without a phrase hit."""
    found = bm25(t)
    rest = materialize(C.queries(t).join(found.select("query_id"), "query_id", "left_anti"), "rest")
    return materialize(S.keyword_scores(found, S.tfidf_top(rest, C.texts(t), 20, cut=True)), "keyword")


@C.once
def vectors(t):
    return materialize(S.vector_scores(C.query_vectors(t), C.chunk_vectors(t).select("chunk_id", "vector"), 20), "vectors")


@C.once
def hybrid(t):
    # By query, or the list lies in as many files as the chunks have splits and no longer counts as small.
    return materialize(S.hybrid_rrf(keyword(t), vectors(t), C.texts(t), 10).repartition("query_id"), "fused")


def with_rank(df):
    return df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


@query("D17", "d17_doc_frequency", "select token, df from v_df")
def _(t):
    return S.doc_frequency(C.chunks(t))


@query("D18", "d18_term_frequency", "select chunk_id, token, tf from v_tf")
def _(t):
    return S.term_frequency(C.chunks(t))


@query("C14", "c14_query_token_join", """
select q.query_id, count(*) as pairs, count(distinct t.chunk_id) as chunks, cast(sum(t.tf) as bigint) as occurrences
from v_query_tokens q join v_tf t on t.token = q.token group by q.query_id""")
def _(t):
    return S.token_matches(C.queries(t), C.chunks(t))


@query("J1 E1 C14", "j1_tfidf_scores", f"""
with {TFIDF} select query_id, chunk_id, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from tfidf) x where rank <= 10""")
def _(t):
    return S.best(S.tfidf_top(C.queries(t), C.index(t), 10), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("J2", "j2_bm25_phrase", f"with {BM25} select query_id, chunk_id, score from bm25")
def _(t):
    return S.bm25_phrase(C.queries(t), C.chunks(t))


@query("J3 E1", "j3_vector_scores", f"""
with q as (select label, min(vec_id) as vec_id from v_embeddings group by label),
c as (select cast(q.label as bigint) as query_id, e.chunk_id, round(list_dot_product(v.embedding::double[], e.embedding::double[])
    / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6) + 0.0 as score
  from q join v_embeddings v using (vec_id), v_embeddings e where e.model = 'm1')
select query_id, chunk_id, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from c) where rn <= 20""")
def _(t):
    stored = t.v_embeddings.where("model = 'm1'").select("chunk_id", F.col("embedding").alias("vector"))
    return S.vector_scores(C.label_queries(t), stored, 20)


@query("J4", "j4_keyword_scores", f"""
with {TFIDF}, {BM25}, {KEYWORD} select query_id, chunk_id, score, method from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rn from kw) where rn <= 20""")
def _(t):
    return S.best(keyword(t), 20).drop("rank")


@query("E2", "e2_rrf", f"""
with {TFIDF}, {BM25}, {KEYWORD}, {COSINE}, {RRF} select query_id, chunk_id, score, in_keyword, in_vector from fused""")
def _(t):
    return S.rrf(S.two_lists(keyword(t), vectors(t)), 20)


@query("E3", "e3_minmax", f"""
with {TFIDF} select query_id, chunk_id, score, round(case when hi > lo then (score - lo) / (hi - lo) when score > 0 then 1.0 else 0.0 end, 6) as norm
from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from tfidf) x""")
def _(t):
    return S.minmax(S.tfidf_every(C.queries(t), C.index(t)), ["query_id"]).withColumn("norm", S.rounded("norm"))


@query("J5", "j5_hybrid_rrf", f"""
with {TFIDF}, {BM25}, {KEYWORD}, {COSINE}, {RRF} select query_id, chunk_id, score, retrieval from hybrid""")
def _(t):
    return hybrid(t)


for _name, _mix, _max in (("j6_hybrid_weighted", "0.35 * a + 0.65 * b", False), ("j6_hybrid_max", "greatest(0.35 * a, 0.65 * b)", True)):
    @query("J6", _name, f"""
    with {TFIDF}, {BM25}, {KEYWORD}, {COSINE},
    an as (select query_id, chunk_id, case when hi > lo then (score - lo) / (hi - lo) when score > 0 then 1.0 else 0.0 end as a
      from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from kw)),
    bn as (select query_id, chunk_id, case when hi > lo then (score - lo) / (hi - lo) when score > 0 then 1.0 else 0.0 end as b
      from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from vtop)),
    ab as (select query_id, chunk_id, coalesce(a, 0.0) as a, coalesce(b, 0.0) as b from an full outer join bn using (query_id, chunk_id)),
    sc as (select *, round({_mix}, 6) as score from ab),
    rk as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc)
    select r.query_id, r.chunk_id, round(r.score * case when m.marked then 1.12 else 1.0 end, 6) as score,
      case when a <> 0 and b <> 0 then 'hybrid' when b <> 0 then 'vector' else 'keyword' end as retrieval
    from rk r join marks m on m.chunk_id = r.chunk_id where rank <= 10""")
    def _(t, use_max=_max):
        hits, found = vectors(t), materialize(S.bm25_phrase(C.queries(t), C.index(t)), "phrases")
        rows, bounds = S.tfidf_for_mix(C.queries(t), C.index(t), hits, 10, 0.35)
        # Bounds of each query's list as a whole, be it phrase hits or TF-IDF.
        mine = found.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        bounds = mine.unionByName(bounds.join(mine, "query_id", "left_anti"))
        return S.hybrid_weighted(S.keyword_scores(found, rows), hits, C.index(t), 10, use_max=use_max, bounds=bounds)
