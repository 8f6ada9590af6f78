"""Registered queries of this subpackage: each applies one operator to its whole table. SQL texts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, limit=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def digest(spans: str) -> "F.Column":
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest("base"), 256).alias("base_sha256"),
                        digest("spans").alias("spans"))


# Verdict, host, path prefix.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]
# Labels of domains that are listed wherever they are registered.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge_urls

    listed = F.split("domain", r"\.")[0].isin(*LISTED_LABELS)
    found = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, listed)
    return found.select("page_id", "host", "path", "rule", "verdict", "listed")


_PARTS = r"""select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages"""
ORACLES["op8_url_filter"] = f"""
with u as ({_PARTS}), r(v, h, p) as (values {', '.join(repr(r) for r in URL_RULES)}),
m as (select u.*, (select max((length(h || p), h || p, v)) from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as best,
    coalesce(list_bool_or([list_contains([{', '.join(repr(x) for x in LISTED_LABELS)}], x) for x in string_split(host, '.')]), false) as listed from u)
select page_id, host, path, best[2] as rule, coalesce(best[3], case when listed then 'block' else 'allow' end) as verdict, listed from m"""


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import clean_lines

    found = clean_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.drop("clean_text")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = found.select("doc_id", F.explode("hits").alias("h"))
    return hit.select("doc_id", "h.item_id", F.col("h.start").alias("start_word"), "h.distance", F.col("h.size").alias("item_words"))


# Tools that the turns of a conversation are read as, and what their arguments must be.
TOOLS = {
    "lookup": {"type": "object", "required": ["query", "turn"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1, "maxLength": 200}, "turn": {"type": "integer", "minimum": 0}}},
    "compose": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {
        "prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
}


@query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as calls (short ones look something up, long ones have a text composed), each waiting for the one two
    turns earlier; assistant turns as the results of the turn before them."""
    from .toolchat import link_calls

    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    body = F.coalesce("text", F.lit(""))
    short = F.length(body) < 120
    arguments = F.when(short, F.to_json(F.struct("turn", body.alias("query")))).otherwise(F.to_json(F.struct("turn", body.alias("prompt"))))
    calls = turns.where("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), F.when(short, "lookup").otherwise("compose").alias("name"),
        arguments.alias("arguments"), name(F.col("turn") - 2).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    found = link_calls(calls, results, TOOLS)
    return found.withColumn("faults", F.array_join("faults", "; "))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with the markup language and address of the page that shows a document where one does: the number that
    ends a page's path is the document's."""
    from .common import materialize
    from .langid import fuse, score_texts, train

    docs = table(spark, sf_dir, "documents")
    languages, logs = train(docs, "text", "lang")
    scored = materialize(score_texts(docs, ["doc_id", "lang", "source"], "text", logs), "scored")
    return fuse(addressed(scored, table(spark, sf_dir, "pages")), ["doc_id", "declared"], languages, "declared", "suffix", "host")


def addressed(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """`docs` with `declared`, `suffix` and `host`; the first page by address speaks for a document, its source and declared
    language stand in where it has none. Pages bring a few short strings, and `docs` comes without its texts."""
    from .urlfilter import host_of, path_of

    number = F.try_to_number(F.regexp_extract(path_of(F.col("url")), r"/(\d{1,17})[^/0-9]*/?$", 1), F.lit("9" * 17)).cast("long")
    markup = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\slang=[\"']?([A-Za-z]+)", 1)
    facts = pages.select(number.alias("doc_id"), F.struct("url", host_of(F.col("url")).alias("host__"), F.nullif(F.lower(markup), F.lit("")).alias("markup__")).alias("p"))
    facts = facts.where("doc_id is not null").groupBy("doc_id").agg(F.min("p").alias("p")).select("doc_id", "p.host__", "p.markup__")
    made = ("declared", "suffix", "host")
    joined = docs.drop(*made).join(facts, "doc_id", "left")
    return joined.select(*[c for c in docs.columns if c not in made], F.coalesce("markup__", "lang").alias("declared"),
                         F.element_at(F.split("host__", r"\."), -1).alias("suffix"), F.coalesce("host__", "source").alias("host"))


def _mixing_sql(rounds: int = 6, share: float = 0.5) -> str:
    """The raking rounds written out, one factor table after the other."""
    dims = {"mix_source": 0.5, "mix_lang": 0.7, "mix_topic": 0.9}
    ctes = ["""m as materialized (select doc_id, coalesce(source, '') as mix_source, coalesce(lang, '') as mix_lang,
        case when regexp_matches(text, '[Ll]icen[sc]e') then 'legal' when regexp_matches(text, '[A-Za-z0-9.]+@[a-z0-9]+[.]') then 'contact'
             when regexp_matches(text, '[#*$%&]{3}') then 'markup' else 'prose' end as mix_topic,
        cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) as bigint) as mix_tokens from documents)""",
            "c as materialized (select mix_source, mix_lang, mix_topic, cast(sum(mix_tokens) as bigint) as tokens from m group by all)"]
    now = {}
    for d, power in dims.items():
        ctes += [f"p_{d} as materialized (select {d}, pow(sum(tokens)::double, {power}) as p from c group by all)",
                 f"t_{d} as materialized (select {d}, p / (select sum(p) from p_{d}) as share from p_{d})",
                 f"f_{d}_0 as materialized (select {d}, 1.0::double as f from t_{d})"]
        now[d] = f"f_{d}_0"
    for r in range(1, rounds + 1):
        for d in dims:
            others = [o for o in dims if o != d]
            joins = " ".join(f"join {now[o]} on c.{o} = {now[o]}.{o}" for o in others)
            ctes += [f"s_{d}_{r} as materialized (select c.{d}, sum(tokens::double * {' * '.join(now[o] + '.f' for o in others)}) as mass from c {joins} group by all having mass > 0)",
                     f"f_{d}_{r} as materialized (select {d}, share / mass as f from t_{d} join s_{d}_{r} using ({d}))"]
            now[d] = f"f_{d}_{r}"
    joins = " ".join(f"left join {now[d]} on c.{d} = {now[d]}.{d}" for d in dims)
    product = " * ".join(f"coalesce({now[d]}.f, 0)" for d in dims)
    ctes += [f"g as materialized (select c.*, {product} as factor from c {joins})",
             f"w as (select mix_source, mix_lang, mix_topic, factor * (select sum(tokens::double) * {share} / sum(tokens * factor) from g) as raw from g)",
             """o as (select m.*, case when mix_tokens > 0 then round(coalesce(raw, 0), 9) else 0 end as weight, ('0x' || substr(md5('0:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint / 281474976710656.0 as u
                from m left join w using (mix_source, mix_lang, mix_topic))"""]
    return f"with {', '.join(ctes)} select doc_id, mix_source, mix_lang, mix_topic, mix_tokens, weight, cast(floor(weight) + case when u < weight - floor(weight) then 1 else 0 end as bigint) as copies from o"


ORACLES["op6_mix"] = _mixing_sql()
ORACLES["op3_tool_calls"] = r"""
with t as (select *, coalesce(text, '') as body from conversations where conv_id is not null and turn is not null),
c as (select conv_id, turn, text, body, length(body) < 120 as short from t where role = 'user'),
s as (select *, row_number() over (partition by conv_id, turn % 2 order by turn) as r from c),
k as (select *, row_number() over (partition by conv_id, turn % 2, turn // 2 - r order by turn) - 1 as level from s),
a as (select conv_id, turn - 1 as turn, text as content from t where role = 'assistant'),
j as (select coalesce(k.conv_id, a.conv_id) as conv_id, coalesce(k.turn, a.turn) as turn, k.turn is not null as called, a.turn is not null as answered, level, short, body, content,
    coalesce(k.turn, a.turn + 1) as position from k full join a on k.conv_id = a.conv_id and k.turn = a.turn)
select conv_id, 'call-' || turn as call_id, position, cast(level as bigint) as level, case when not called then 'orphan' when answered then 'linked' else 'unanswered' end as status,
    case when called and body = '' then 'arguments.' || (case when short then 'query' else 'prompt' end) || ': length' else '' end as faults,
    '{"arguments":' || case when not called then 'null' when short then '{"query":' || to_json(body) || ',"turn":' || turn || '}' else '{"prompt":' || to_json(body) || ',"turn":' || turn || '}' end
    || ',"id":' || to_json('call-' || turn) || ',"name":' || case when not called then 'null' when short then '"lookup"' else '"compose"' end || ',"result":' || coalesce(to_json(content), 'null') || '}' as record
from j"""


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import prefix_trie

    conv = F.col("conv")
    found = prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, most_head=8)
    return found.drop("f0", "f1", "f2")
