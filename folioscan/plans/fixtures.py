"""Derived tables over the driver's parquet files.

Each view is one SQL text that both Spark SQL and DuckDB accept, so a query and its oracle
start from the same rows. Arrays (tags, links) are kept as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Declared, so opening a table starts no job to read file footers.
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

ORDER_CLOCK = "2001-09-01 00:00:00"
EVENT_CLOCK = "2024-01-31 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["v_pages"] = """
select doc_id, concat(d, '/', cast(doc_id as string), '.md') as rel_path,
  concat('Doc ', cast(doc_id as string), ' ', substr(replace(text, chr(10), ' '), 1, 40)) as title,
  case d when 'concepts' then 'concept' when 'entities' then 'entity' when 'sources' then 'source'
         when 'comparisons' then 'comparison' else 'note' end as type,
  case quality when 1 then 'refined' when 0 then 'draft' else 'archived' end as status,
  concat('2024-', lpad(cast(1 + doc_id % 12 as string), 2, '0'), '-', lpad(cast(1 + doc_id % 28 as string), 2, '0')) as created,
  case when doc_id % 7 = 0 then '' else concat('2025-', lpad(cast(1 + doc_id % 11 as string), 2, '0'), '-', lpad(cast(1 + doc_id % 27 as string), 2, '0')) end as updated,
  concat('# Part ', cast(doc_id % 3 as string), chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10)))) as body,
  lang, source
from (select t.doc_id, t.text, t.lang, t.source, l.quality,
        case t.doc_id % 5 when 0 then 'concepts' when 1 then 'entities' when 2 then 'sources'
                          when 3 then 'comparisons' else 'notes' end as d
      from documents t left join (select doc_id, max(quality) as quality from labels group by doc_id) l on t.doc_id = l.doc_id) x
"""

VIEWS["v_tags"] = """
select rel_path, 0 as ord, lang as tag from v_pages where doc_id % 13 <> 0
union all select rel_path, 1 as ord, source as tag from v_pages where doc_id % 13 <> 0
"""

VIEWS["v_link_targets"] = """
select rel_path, doc_id, (doc_id * 7 + 1) % (select count(*) from documents) as by_path,
  (doc_id * 11 + 2) % (select count(*) from documents) as by_title,
  (doc_id * 5 + 3) % (select count(*) from documents) as by_number
from v_pages
"""

VIEWS["v_links"] = """
select p.rel_path, 0 as ord, q.rel_path as link from v_link_targets p join v_pages q on q.doc_id = p.by_path where p.doc_id % 4 <> 0
union all select p.rel_path, 1 as ord, q.title as link from v_link_targets p join v_pages q on q.doc_id = p.by_title where p.doc_id % 12 = 3
union all select rel_path, 2 as ord, cast(by_number as string) as link from v_link_targets where doc_id % 12 = 5
union all select rel_path, 3 as ord, concat('missing/', cast(doc_id as string), '.md') as link from v_pages where doc_id % 20 = 13
union all select rel_path, 4 as ord, 'http://example.com/x' as link from v_pages where doc_id % 20 = 1
"""

VIEWS["v_assets"] = """
select substr(md5(html), 1, 16) as id, concat('assets/documents/', cast(page_id as string), '.html') as rel_path,
  concat(cast(page_id as string), '.html') as filename, 'documents' as category, length(html) as size,
  case when page_id % 2 = 0 then coalesce(p.rel_path, '') else '' end as wiki_page
from pages g left join v_pages p on p.doc_id = g.page_id
"""

VIEWS["v_orders"] = """
select cast(o_orderkey as string) as id, o_orderkey as okey,
  case substr(o_orderpriority, 1, 1) when '1' then 'month' when '2' then 'month' when '3' then 'year' when '4' then 'year' else 'lifetime' end as plan,
  cast(o_totalprice as decimal(18,2)) as amount,
  case o_orderstatus when 'F' then 'paid' when 'P' then 'pending' else 'free' end as status,
  case when o_orderkey % 17 = 0 then '' else cast(o_custkey as string) end as device_id,
  case o_custkey % 3 when 0 then '' when 1 then 'alpha' else 'beta' end as product,
  case when o_orderkey % 4 = 0 then '' else concat('P_N', lpad(cast(c_nationkey as string), 2, '0')) end as channel_code,
  o_orderdate as created_at,
  case when o_orderstatus = 'P' then null else o_orderdate + interval '1' day end as paid_at
from orders join customer on o_custkey = c_custkey
"""

VIEWS["v_promoters"] = """
select concat('P_N', lpad(cast(n_nationkey as string), 2, '0')) as code, n_name as name,
  cast((n_nationkey % 6) * 0.1 as decimal(4,2)) as commission_rate
from nation where n_nationkey % 5 <> 0
"""

VIEWS["v_licenses"] = """
select concat('L', id) as id, id as order_id, device_id, plan, paid_at as starts_at,
  case plan when 'month' then paid_at + interval '30' day when 'year' then paid_at + interval '365' day
            else timestamp '2099-12-31 23:59:59' end as expires_at,
  case when okey % 11 = 0 then 'revoked' else 'active' end as status,
  case when okey % 5 = 0 then null else paid_at + interval '20' day end as last_seen_at
from v_orders where status <> 'pending'
"""

VIEWS["v_codes"] = """
select upper(substr(md5(cast(p_partkey as string)), 1, 8)) as code,
  case p_size % 3 when 0 then 'month' when 1 then 'year' else 'lifetime' end as plan, p_partkey % 2 as used from part
"""

VIEWS["v_turns"] = """
select cast(conv_id as string) as session_id, turn, role, text as content from conversations
where role in ('user', 'assistant') and trim(text) <> ''
"""

# Windowed form, for the oracle; Spark builds the same rows with operators.sequences.qa_pairs.
VIEWS["v_qa"] = """
select concat(session_id, ':', cast(turn as string)) as id, session_id, turn, content as question, answer,
  case when length(answer) % 3 <> 0 then 1 else 0 end as grounded,
  case when length(answer) % 4 = 0 then '[]' else '[{"title":"t","path":"p"}]' end as sources
from (select session_id, turn, role, content,
        lead(role) over (partition by session_id order by turn) as next_role,
        lead(content) over (partition by session_id order by turn) as answer from v_turns) t
where role = 'user' and next_role = 'assistant'
"""

VIEWS["v_queries"] = """
select item_id as query_id, replace(text, chr(10), ' ') as text,
  concat(split_part(replace(text, chr(10), ' '), ' ', 2), ' ', split_part(replace(text, chr(10), ' '), ' ', 3)) as phrase
from benchmark
"""

VIEWS["v_heartbeats"] = """
select event_id, cast(user_id as string) as device_id, ts from events where event_type in ('click', 'view')
"""

VIEWS["v_audit"] = """
select event_id as id, ts as at_time, case event_type when 'signup' then 'rule_create' when 'purchase' then 'rule_create_bulk'
  when 'error' then 'rule_delete' when 'click' then 'qa_delete' else 'session_delete' end as action from events
"""

VIEWS["v_order_events"] = """
select event_id, ts, cast(user_id as string) as order_id, case event_type when 'signup' then 'create' when 'purchase' then 'pay'
  when 'click' then 'free' when 'error' then 'cancel' else 'touch' end as kind from events
"""

VIEWS["v_embeddings"] = """
select vec_id, cast(vec_id as string) as chunk_id, case when vec_id % 10 = 0 then 'm2' else 'm1' end as model, embedding, label
from embeddings
"""

# DuckDB text of derived tables that Spark builds with library operators.
ORACLE_VIEWS: dict[str, str] = {}

ORACLE_VIEWS["v_sessions"] = """
select session_id, count(*) as turn_count, max(turn) as last_turn,
  coalesce(substr(min_by(content, turn) filter (where role = 'user'), 1, 80), '') as preview
from v_turns group by session_id
"""

# 480-character windows with 80 overlap over the squeezed body, as operators.chunking.window_chunks.
ORACLE_VIEWS["v_flat"] = r"""
select rel_path, title, type, status, trim(regexp_replace(body, '\s+', ' ', 'g')) as flat from v_pages
"""
ORACLE_VIEWS["v_chunks"] = """
select concat(rel_path, '#', cast(i as varchar)) as chunk_id, rel_path, title, type, status, i as ord,
  substr(flat, cast(i * 400 + 1 as bigint), 480) as text
from (select *, unnest(range(0, case when length(flat) <= 480 then 1 else cast(ceil((length(flat) - 480) / 400.0) as bigint) + 1 end)) as i
      from v_flat where flat <> '') x
"""
ORACLE_VIEWS["v_chunk_tokens"] = """
select chunk_id, rel_path, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as token from v_chunks
"""
ORACLE_VIEWS["v_tf"] = """
select chunk_id, token, count(*) as tf from v_chunk_tokens group by chunk_id, token
"""
ORACLE_VIEWS["v_df"] = """
select token, count(*) as df from v_tf group by token
"""
ORACLE_VIEWS["v_query_tokens"] = """
select distinct query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as token from v_queries
"""


def _closure(names: list[str]) -> list[str]:
    known = {**VIEWS, **ORACLE_VIEWS}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in known:
            if dep != name and re.search(rf"\b{dep}\b", known[name]):
                visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `sql` with the view definitions it mentions, as common table expressions.

    A statement that starts with its own WITH list is merged into one list."""
    known = {**VIEWS, **ORACLE_VIEWS}
    names = _closure([n for n in known if re.search(rf"\b{n}\b", sql)])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} as ({known[n].strip()})" for n in names)
    body = sql.strip()
    match = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if match:
        return f"with {'recursive ' if match.group(1) else ''}{ctes},\n{body[match.end():]}"
    return f"with {ctes}\n{body}"


class Tables:
    """Lazy access to the base tables and SQL views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in BASE_SCHEMAS and name not in VIEWS:
            raise AttributeError(name)
        if name not in self.opened:
            if name in BASE_SCHEMAS:
                self.opened[name] = self.spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self.opened[name] = self.sql(f"select * from {name}")
        return self.opened[name]

    def spread(self, df: DataFrame, *keys: str, scan: DataFrame | None = None) -> DataFrame:
        """Give text-heavy work every core when the scan has fewer splits than the cluster has cores.

        The driver's files are single row groups; a real corpus has many splits and is left as it is. `scan` is the table to ask where `df` joins it
        with others: to ask `df` would run its joins."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, *keys) if (df if scan is None else scan).rdd.getNumPartitions() < cores else df

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        for table in BASE_TABLES:
            if re.search(rf"\b{table}\b", full):
                getattr(self, table).createOrReplaceTempView(table)
        return self.spark.sql(full)
