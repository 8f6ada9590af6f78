"""New and changed rows, index maintenance, and batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import embed_input, text_hash
from ..functions.times import stamp
from ..operators import incremental as N
from ..operators import postings as X
from ..session import scratch_path
from . import common as C
from . import retrieval as R
from .registry import query


def stored(t):
    """Vectors of the chunk table: some of another text, some of another model, some of chunks that are gone."""
    rows = C.chunks(t).select("chunk_id", "ord", F.col("title").alias("context_prefix"), "text")
    hashed = rows.withColumn("text_hash", text_hash(F.when(F.col("ord") % 4 == 1, F.col("text")).otherwise(embed_input("context_prefix", "text"))))
    return hashed.where("ord % 5 <> 4").select(
        F.when(F.col("ord") % 7 == 6, F.concat("chunk_id", F.lit("-old"))).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("ord") % 6 == 5, "m2").otherwise("m1").alias("model"), "text_hash", "ord")


def live(t):
    return C.chunks(t).withColumn("context_prefix", F.col("title"))


STORED = """
st as (select case when ord % 7 = 6 then chunk_id || '-old' else chunk_id end as chunk_id, case when ord % 6 = 5 then 'm2' else 'm1' end as model,
  substr(sha256(case when ord % 4 = 1 or trim(title) = '' then text else trim(title) || chr(10) || text end), 1, 24) as text_hash, ord from v_chunks where ord % 5 <> 4)"""


@query("C8", "c8_embedding_semi", f"with {STORED} select chunk_id, text_hash from st where model = 'm1' and chunk_id in (select chunk_id from v_chunks)")
def _(t):
    return N.embedding_semi(C.chunks(t), stored(t), "m1").select("chunk_id", "text_hash")


@query("C9", "c9_orphan_embeddings", f"with {STORED} select chunk_id, model from st where chunk_id not in (select chunk_id from v_chunks)")
def _(t):
    return N.orphan_embeddings(stored(t), C.chunks(t)).select("chunk_id", "model")


@query("C10 K10", "c10_embedding_todo", f"""
with {STORED}, w as (select chunk_id, substr(sha256(case when trim(title) = '' then text else trim(title) || chr(10) || text end), 1, 24) as text_hash from v_chunks where trim(text) <> '')
select chunk_id, text_hash from w where not exists (select 1 from st where st.model = 'm1' and st.chunk_id = w.chunk_id and st.text_hash = w.text_hash)""")
def _(t):
    return N.embedding_todo(live(t), stored(t), "m1").select("chunk_id", "text_hash")


@query("D19", "d19_embedding_coverage", f"""
with {STORED}, c as (select (select count(*) from st where model = 'm1') as stored, (select count(*) from v_chunks where trim(text) <> '') as expected)
select stored, expected, cast(case when expected = 0 then 100 else least(100, round_even(100.0 * stored / expected, 0)) end as bigint) as percent from c""")
def _(t):
    return N.embedding_coverage(C.chunks(t), stored(t), "m1")


def letter_vectors(texts: list[str]) -> list[list[float]]:
    """Stands where a caller's model would: length, vowels and blanks of each text."""
    return [[float(len(s)), float(sum(s.count(c) for c in "aeiou")), float(s.count(" "))] for s in texts]


@query("K10 L1", "k10_incremental_embeddings", f"""
with {STORED}, w as (select chunk_id, case when trim(title) = '' then text else trim(title) || chr(10) || text end as input from v_chunks where trim(text) <> ''),
d as (select chunk_id, input, substr(sha256(input), 1, 24) as text_hash from w)
select chunk_id, 'm1' as model, text_hash, cast(3 as integer) as dim, cast(length(input) as bigint) as chars, cast(length(input) - length(translate(input, 'aeiou', '')) as bigint) as vowels,
  cast(length(input) - length(replace(input, ' ', '')) as bigint) as blanks from d where not exists (select 1 from st where st.model = 'm1' and st.chunk_id = d.chunk_id and st.text_hash = d.text_hash)""")
def _(t):
    made = N.embed_rows(N.embedding_todo(live(t), stored(t), "m1"), "m1", letter_vectors)
    part = lambda i: F.col("vector")[i].cast("bigint")
    return made.select("chunk_id", "model", "text_hash", "dim", part(0).alias("chars"), part(1).alias("vowels"), part(2).alias("blanks"))


@query("C11", "c11_url_new", """
with p as (select page_id, case when page_id % 2 = 0 then regexp_replace(url, '[?#].*$', '') else url end as url from pages),
f as (select * from (select *, row_number() over (partition by url order by page_id) as rn from p) x where rn = 1)
select page_id, url from f where url not in (select url from pages where page_id % 3 = 0)""")
def _(t):
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "[?#].*$", "")).otherwise(F.col("url")).alias("url"))
    cache = t.pages.where("page_id % 3 = 0").select("url")
    return N.url_new(rows, cache, F.asc("page_id")).select("page_id", "url")


@query("C12", "c12_asset_new", """
with f as (select doc_id, sha256(text) as digest from documents), n as (select * from (select *, row_number() over (partition by digest order by doc_id) as rn from f) x where rn = 1)
select doc_id, digest from n where digest not in (select sha256(text) from documents where source = 'src3')""")
def _(t):
    files = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"), "source")
    return N.asset_new(files.drop("source"), files.where("source = 'src3'"), F.asc("doc_id"))


@query("C13", "c13_import_missing", "select id, plan from v_orders where id not in (select order_id from v_licenses)")
def _(t):
    return N.import_missing(t.v_orders.select("id", "plan"), t.v_licenses.select(F.col("order_id").alias("id")))


@query("J18", "j18_upsert_page_index", """
select chunk_id, text from v_chunks where type not in ('note', 'source') union all select chunk_id, 'new ' || text from v_chunks where type = 'note'""")
def _(t):
    store = C.chunks(t).select("chunk_id", "rel_path", "text")
    fresh = C.chunks(t).where("type = 'note'").select("chunk_id", "rel_path", F.concat(F.lit("new "), "text").alias("text"))
    updated = N.upsert_page_index(store, fresh, t.v_pages.where("type = 'note'"))
    return N.remove_pages(updated, t.v_pages.where("type = 'source'")).select("chunk_id", "text")


@query("J19", "j19_sync_phrase_rows", "select chunk_id, md5(title || chr(10) || text) as digest from v_chunks where trim(text) <> ''")
def _(t):
    return N.phrase_rows(C.chunks(t)).select("chunk_id", F.md5("content").alias("digest"))


@query("J20", "j20_index_status", f"with {STORED} select (select count(*) from v_chunks) as chunks, (select count(*) from st) as embeddings, (select count(*) from v_chunks where trim(text) <> '') as phrase_rows, (select count(*) from v_chunks) >= 20000 as index_advised")
def _(t):
    return N.index_status(C.chunks(t), stored(t), N.phrase_rows(C.chunks(t)))


@C.once
def stored_index(t):
    """The stored index of the chunk table; chunks of one language share blocks. The chunks are written once, as the index's own."""
    return X.build(t.spark, scratch_path(t.spark, "index"), C.chunks(t).select("chunk_id", "rel_path", "title", "text", F.col("lang").alias("cluster")))


@query("J1 J4", "j1_index_scores", f"""
with {R.TFIDF} select query_id, chunk_id, score from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from tfidf) x where rank <= 10""")
def _(t):
    return X.tfidf_top(stored_index(t), C.queries(t), 10)


@query("J2", "j2_index_phrase", f"with {R.BM25} select query_id, chunk_id, score from bm25")
def _(t):
    return X.phrase_scores(stored_index(t), C.queries(t))


@query("J19 J18", "j19_index_terms", """
with now as (select chunk_id, text from v_chunks where type not in ('note', 'source') union all select chunk_id, 'fresh ' || text from v_chunks where type = 'note'),
tok as (select chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from now)
select term, count(distinct chunk_id) as df from tok group by term""")
def _(t):
    """Document frequencies that the index gives after notes were replaced and sources removed."""
    index = X.build(t.spark, scratch_path(t.spark, "index"), C.chunks(t))
    notes = C.chunks(t).where("type = 'note'").withColumn("text", F.concat(F.lit("fresh "), "text"))
    X.upsert(index, notes, t.v_pages.where("type = 'note'").select("rel_path"))
    X.remove(index, t.v_pages.where("type = 'source'").select("rel_path"))
    return X.doc_frequency(index)


@query("J20", "j20_stored_status", """
select (select count(*) from v_chunks) as chunks, (select count(*) from v_chunks where trim(text) <> '') as phrase_rows,
  (select count(distinct rel_path) from v_chunks) as pages, cast(1 as bigint) as segments""")
def _(t):
    return X.status(stored_index(t))


@query("K2", "k2_monotone_changes", """
with e as (select user_id, event_id, case when event_id % 50 = 0 then ts - interval '1' day else ts end as ts from events)
select user_id, event_id from (select *, max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as m from e) x where m is null or ts > m""")
def _(t):
    late = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 50 == 0, F.col("ts") - F.expr("interval 1 day")).otherwise(F.col("ts")).alias("ts"))
    return N.monotone_changes(late, "user_id", "event_id", "ts").select("user_id", "event_id")


@query("K3", "k3_debounced_batches", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6' hour then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as run from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, strftime(max(ts) + interval '6' hour, '%Y-%m-%d %H:%M:%S') as fires, count(*) as events from s group by user_id, run""")
def _(t):
    return N.debounced_batches(t.events, "user_id", "ts", "6 hours").withColumns({"started": stamp("started"), "fires": stamp("fires")})


@query("K6", "k6_last_seen", """
with h as (select h.event_id, 'L' || cast(1 + h.event_id % (select count(*) from orders) as varchar) as id, h.ts - interval '8500' day as ts from v_heartbeats h),
j as (select h.id, h.ts, l.status, l.device_id as owner, case when h.event_id % 4 = 0 then 'x' else l.device_id end as device_id, l.expires_at from h left join v_licenses l using (id)),
k as (select *, coalesce(status = 'active' and device_id = owner and expires_at >= ts, false) as ok from j)
select id, coalesce(strftime(max(ts) filter (where ok), '%Y-%m-%d %H:%M:%S'), '') as last_seen_at, count(*) filter (where ok) as accepted, count(*) filter (where not ok) as rejected from k group by id""")
def _(t):
    n = t.orders.agg(F.count("*")).scalar()
    beats = t.v_heartbeats.select("event_id", F.concat(F.lit("L"), (1 + F.col("event_id") % n).cast("string")).alias("id"),
                                  (F.col("ts") - F.expr("interval 8500 days")).alias("ts"))
    own = t.v_licenses.select("id", F.col("device_id").alias("d"))
    mine = beats.join(own, "id", "left").select("id", "ts", F.when(F.col("event_id") % 4 == 0, "x").otherwise(F.col("d")).alias("device_id"))
    return N.last_seen(mine, t.v_licenses).withColumn("last_seen_at", F.coalesce(stamp("last_seen_at"), F.lit("")))


@query("K7", "k7_rolling_active", """
with d as (select distinct device_id, cast(ts as date) as d from v_heartbeats), s as (select distinct device_id, d + cast(k as integer) as day from d, range(0, 7) r(k))
select strftime(day, '%Y-%m-%d') as day, count(*) as devices from s where day <= (select max(d) from d) group by day""")
def _(t):
    return N.rolling_active(t.v_heartbeats, 7).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "devices")


@query("K8", "k8_order_lifecycle", """
with recursive e as (select event_id, order_id, kind, row_number() over (partition by order_id order by ts, event_id) as n from v_order_events),
r(event_id, order_id, n, kind, state_before, state_after) as (
  select event_id, order_id, n, kind, 'none', case when kind = 'create' then 'pending' else 'none' end from e where n = 1
  union all select e.event_id, e.order_id, e.n, e.kind, r.state_after, case when e.kind = 'create' and r.state_after = 'none' then 'pending' when e.kind = 'pay' and r.state_after in ('pending', 'free') then 'paid'
    when e.kind = 'free' and r.state_after = 'pending' then 'free' when e.kind = 'cancel' and r.state_after = 'pending' then 'none' else r.state_after end
  from r join e on e.order_id = r.order_id and e.n = r.n + 1)
select event_id, order_id, kind, state_before, case when kind = 'touch' then 'ignored' when state_before <> state_after then case when state_after = 'none' then 'deleted' else state_after end
  when (kind = 'pay' and state_before = 'paid') or (kind = 'free' and state_before = 'free') then 'unchanged' else 'rejected' end as outcome from r""")
def _(t):
    return N.order_lifecycle(t.v_order_events).select("event_id", "order_id", "kind", "state_before", "outcome")


@query("K9", "k9_retry_state", """
select user_id as id, count(*) as attempts, bool_or(value > 60) as sent, case when bool_or(value > 60) then '' else max_by(props, event_id) end as last_error from events group by user_id""")
def _(t):
    tries = t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("attempt"), (F.col("value") > 60).alias("ok"), F.col("props").alias("error"))
    return N.retry_state(tries)


@query("K11", "k11_session_upsert", """
with old as (select session_id, '2024-01-01' as created_at, '2024-01-01' as updated_at, substr(any_value(content), 1, 5) as preview from v_turns where turn = 1 and cast(session_id as bigint) % 2 = 0 group by session_id),
new as (select session_id, '2024-02-' || lpad(cast(1 + min(turn) as varchar), 2, '0') as created_at, '2024-02-' || lpad(cast(1 + max(turn) as varchar), 2, '0') as updated_at,
  substr(max_by(content, turn) filter (where role = 'user'), 1, 80) as preview from v_turns where turn >= 2 group by session_id)
select coalesce(o.session_id, n.session_id) as session_id, coalesce(o.created_at, n.created_at) as created_at, coalesce(n.updated_at, o.updated_at) as updated_at, coalesce(nullif(n.preview, ''), o.preview, '') as preview
from old o full outer join new n on n.session_id = o.session_id""")
def _(t):
    old = t.v_turns.where("turn = 1 and cast(session_id as bigint) % 2 = 0").select(
        "session_id", F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at"), F.substring("content", 1, 5).alias("preview"))
    new = t.v_turns.where("turn >= 2").withColumn("at_time", F.concat(F.lit("2024-02-"), F.lpad((1 + F.col("turn")).cast("string"), 2, "0")))
    return N.session_upsert(old, new)


@query("K12", "k12_keyed_upsert", """
with c as (select id, 'paid' as status, 'new' as plan from v_orders where status = 'pending' union all select 'N' || cast(c_custkey as varchar), 'free', 'gift' from customer)
select coalesce(o.id, c.id) as id, coalesce(c.status, o.status) as status, coalesce(o.plan, c.plan) as plan, coalesce(o.product, '') as product from v_orders o full outer join c on c.id = o.id""")
def _(t):
    changes = t.v_orders.where("status = 'pending'").select("id", F.lit("paid").alias("status"), F.lit("new").alias("plan")).union(
        t.customer.select(F.concat(F.lit("N"), F.col("c_custkey").cast("string")), F.lit("free"), F.lit("gift")))
    out = N.keyed_upsert(t.v_orders.select("id", "status", "plan", "product"), changes, ["id"], ["status"])
    return out.withColumn("product", F.coalesce("product", F.lit("")))


@query("K13", "k13_rate_limit", """
with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events),
r as (select user_id, rn, event_id, true as accepted, [us] as kept from e where rn = 1
  union all select e.user_id, e.rn, e.event_id, len(list_filter(r.kept, lambda x: e.us - x < 21600000000)) < 2,
    case when len(list_filter(r.kept, lambda x: e.us - x < 21600000000)) < 2 then list_append(list_filter(r.kept, lambda x: e.us - x < 21600000000), e.us)
      else list_filter(r.kept, lambda x: e.us - x < 21600000000) end
  from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
select event_id, user_id, accepted from r""")
def _(t):
    return N.rate_limit(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", 2, 6 * 3600).select("event_id", "user_id", "accepted")


@query("K14", "k14_bulk_set_status", """
with w as (select ' ' || rel_path as path from v_pages where type <> 'note' union all select link from v_links union all select '../' || rel_path from v_pages where type = 'note'),
a as (select distinct trim(path) as rel_path from w where trim(path) <> '')
select a.rel_path, case when contains('/' || a.rel_path || '/', '/../') or starts_with(a.rel_path, '/') or p.status is null then 'error' when p.status = 'refined' then 'skipped' else 'refined' end as outcome from a left join v_pages p using (rel_path)""")
def _(t):
    wanted = t.v_pages.where("type <> 'note'").select(F.concat(F.lit(" "), "rel_path").alias("path")).union(t.v_links.select("link")).union(
        t.v_pages.where("type = 'note'").select(F.concat(F.lit("../"), "rel_path")))
    return N.bulk_set_status(t.v_pages, wanted)
