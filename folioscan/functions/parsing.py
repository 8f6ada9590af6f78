"""Expressions that read structure out of model or user text: JSON edges, tagged sections, rule blocks, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, lines_of, replace, strip

EDGE = "array<struct<source string, target string, label string, strength string>>"
CONFLICT = ("array<struct<a string, assumption_a string, b string, assumption_b string, why string, reason string, "
            "path_a string, rel_path_a string, path_b string, rel_path_b string>>")
# Section names and the words that mean "nothing".
BLOCK_TAGS = ("MEMORY", "SKILL_TITLE", "SKILL_BODY", "PRINCIPLE_TITLE", "PRINCIPLE_BODY")
NOTHING = ("无", "无。", "none", "N/A", "-")


# A fenced or braced JSON document in an answer.
FENCED, BRACED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)\{.*\}"


def json_edges(raw) -> Column:
    """Edge objects of the first fenced or braced JSON document; NULL or empty when there is none."""
    text = strip(raw)
    fenced = F.regexp_extract(text, FENCED, 1)
    braced = F.regexp_extract(text, BRACED, 0)
    return F.from_json(F.when(fenced != "", fenced).otherwise(braced), f"edges {EDGE}")["edges"]


def json_conflicts(raw) -> Column:
    """Pairs of different statements, under either of their key names."""
    found = F.regexp_extract(strip(raw), r"(?s)\{.*\}|\[.*\]", 0)
    doc = F.from_json(found, f"conflicts {CONFLICT}, items {CONFLICT}")
    listed = F.from_json(found, CONFLICT)
    items = F.when(found.startswith("["), listed).otherwise(F.coalesce(doc["conflicts"], doc["items"]))

    def pick(x: Column, *names: str) -> Column:
        return strip(F.coalesce(*[F.nullif(x[n], F.lit("")) for n in names], F.lit("")))

    rows = F.transform(items, lambda x: F.struct(
        pick(x, "a", "assumption_a").alias("a"), pick(x, "b", "assumption_b").alias("b"),
        pick(x, "why", "reason").alias("why"), pick(x, "path_a", "rel_path_a").alias("path_a"),
        pick(x, "path_b", "rel_path_b").alias("path_b")))
    return F.filter(rows, lambda r: (r["a"] != "") & (r["b"] != "") & (r["a"] != r["b"]))


def tagged_block(raw, name: str) -> Column:
    return strip(F.regexp_extract(col(raw), rf"(?is)<<<{name}>>>\s*(.*?)(?=<<<[A-Z_]+>>>|\z)", 1))


def tagged_blocks(df: DataFrame, raw: str) -> DataFrame:
    """One column per section, and whether the principle sections say nothing."""
    out = df.select("*", *[tagged_block(raw, tag).alias(tag.lower()) for tag in BLOCK_TAGS])
    title, body = F.col("principle_title"), F.col("principle_body")
    empty = (((title == "") & (body == "")) | (title.isin(*NOTHING) & body.isin("", *NOTHING))
             | (body.isin("无", "无。") & title.isin("无", "无。", "")))
    return out.withColumn("principle_empty", empty)


# How a rule block, its flag, id, time and marked lines are written.
RULE_HEAD = r"^###\s+\S"
RULE_FLAG = r"(?i)<!--\s*enabled:\s*(true|false)\s*-->"
RULE_ID = r"^###\s+(r_[0-9a-f]{6,12})\s*·"
RULE_TITLE = r"^###\s+(?:r_[0-9a-f]{6,12}\s*·\s*)?"
RULE_TIME = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2})"
QUESTION_LINE, RULE_LINE = r"^- \*\*触发问题\*\*[：:]", r"^- \*\*规则\*\*[：:]"


def rule_blocks(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per `###` block: identifier, on/off, time, question, rule text and kind."""
    blocks = F.filter(F.split(col(text), f"(?m)(?={RULE_HEAD})"), lambda b: b.rlike(RULE_HEAD))
    rows = df.select(*keys, F.posexplode(blocks).alias("ord", "block"))
    head = F.regexp_extract("block", r"^([^\n]*)", 1)
    flag = F.lower(F.regexp_extract(head, RULE_FLAG, 1))
    clean = strip(replace(head, RULE_FLAG))
    ident = F.regexp_extract(clean, RULE_ID, 1)
    title = strip(replace(clean, RULE_TITLE))
    body = strip(replace("block", r"^[^\n]*"))
    parsed = rows.select(*keys, "ord", ident.alias("id"), (flag != "false").alias("enabled"), title.alias("title"),
                         F.transform(lines_of(body), strip).alias("lines"), body.alias("body"))
    after_colon = lambda s: strip(replace(replace(s, r"^[^：]*：(?s:(.*))$", "$1"), r"^[^:]*:(?s:(.*))$", "$1"))
    questions = F.filter("lines", lambda s: s.rlike(QUESTION_LINE))
    # Free lines count only until the first rule line or free line has filled the text.
    folded = F.aggregate("lines", F.lit(""), lambda acc, s: F.when(
        s.rlike(QUESTION_LINE), acc).when(s.rlike(RULE_LINE), after_colon(s)).when(
        (acc == "") & (s != "") & ~s.startswith("#"), s).otherwise(acc))
    return parsed.select(
        *keys, "ord", "id", "enabled", "title",
        F.regexp_extract("title", RULE_TIME, 1).alias("at"),
        F.coalesce(after_colon(F.element_at(F.when(F.size(questions) > 0, questions), -1)), F.lit("")).alias("question"),
        F.when(folded != "", folded).otherwise(F.col("body")).alias("text"),
        F.when(F.col("title").contains("纠错"), "纠错").when(F.col("title").contains("偏好"), "偏好")
        .otherwise("规则").alias("kind"))


# Fixed value: how a front-matter block is set off.
FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n(.*)\z"


def has_front_matter(text) -> Column:
    return col(text).rlike(FRONT)


def front_matter(text) -> Column:
    """Key to raw value of the leading block; empty map when there is none.

    A line `key: value` gives a pair; lines `- item` below a key without value become its bracketed list, each item
    quoted so that commas inside it stay. A colon inside an item does not make a key. The last line of a key wins."""
    block = F.regexp_extract(col(text), FRONT, 1)
    lines = F.filter(lines_of(block), lambda s: strip(s) != "")
    quoted = lambda s: F.concat(F.lit('"'), F.replace(scalar_value(strip(replace(s, r"^\s*-\s+"))), F.lit('"'), F.lit("'")), F.lit('"'))
    pair = lambda s: F.struct(
        strip(F.substring_index(s, ":", 1)).alias("key"), strip(replace(s, r"^[^:]*:")).alias("value"), F.array().cast("array<string>").alias("items"))
    start = F.array().cast("array<struct<key:string,value:string,items:array<string>>>")

    def fold(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["key"].alias("key"), last["value"].alias("value"), F.concat(last["items"], F.array(quoted(s))).alias("items"))
        is_item = s.rlike(r"^\s*-\s+\S")
        return (F.when(is_item & (F.size(acc) > 0), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.when(F.size(acc) > 0, grown))))
                .when(~is_item & s.contains(":"), F.concat(acc, F.array(pair(s)))).otherwise(acc))

    entries = F.transform(F.aggregate(lines, start, fold), lambda e: F.struct(
        e["key"].alias("key"), F.when((e["value"] == "") & (F.size(e["items"]) > 0), F.concat(F.lit("["), F.array_join(e["items"], ", "), F.lit("]")))
        .otherwise(e["value"]).alias("value")))
    # Later lines win over earlier ones with the same key.
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.lit(0), F.size(entries) - i - 1)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def front_body(text) -> Column:
    return F.when(has_front_matter(text), F.regexp_extract(col(text), FRONT, 2)).otherwise(col(text))


def scalar_value(raw) -> Column:
    return replace(col(raw), r"^[\"']+|[\"']+\z")


def list_value(raw) -> Column:
    """Items of `[a, "b, c"]`; a comma inside quotes does not part items. NULL when the value is not a bracketed list."""
    inner = F.regexp_extract(col(raw), r"(?s)^\[(.*)\]$", 1)
    cells = F.regexp_extract_all(inner, F.lit(r"""\s*("[^"]*"|'[^']*'|[^,]+)\s*(?:,|\z)"""), F.lit(1))
    items = F.filter(F.transform(cells, lambda s: scalar_value(strip(s))), lambda s: s != "")
    return F.when(col(raw).rlike(r"(?s)^\[.*\]$"), items)
