"""Inputs shared by several query groups."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators.chunking import window_chunks
from ..operators.sequences import qa_pairs
from ..session import materialize
from .fixtures import Tables

SIZE, OVERLAP = 480, 80


def once(fn):
    """Build a derived table once per data folder."""

    @functools.wraps(fn)
    def wrapper(t: Tables) -> DataFrame:
        key = f"{fn.__module__}.{fn.__qualname__}"
        if key not in t.opened:
            t.opened[key] = fn(t)
        return t.opened[key]

    return wrapper


@once
def chunks(t: Tables) -> DataFrame:
    """480-character windows over every page, with tokens."""
    pages = t.spread(t.v_pages, "rel_path", scan=t.documents).select("rel_path", "title", "type", "status", "lang", "body")
    rows = window_chunks(pages, ["rel_path", "title", "type", "status", "lang"], "body", SIZE, OVERLAP)  # it squeezes the texts
    return rows.select(F.concat_ws("#", "rel_path", F.col("ord").cast("string")).alias("chunk_id"), "rel_path", "title",
                       "type", "status", "lang", F.col("ord").cast("bigint").alias("ord"), "text", tokenize("text").alias("tokens"))


@once
def index(t: Tables) -> DataFrame:
    """The chunk table written out once, for jobs that pass over it several times."""
    return materialize(chunks(t), "chunks")


@once
def texts(t: Tables) -> DataFrame:
    """As `index` without stored tokens, for jobs that read the texts but seldom their words; `tokens` are cut when read."""
    return materialize(chunks(t).drop("tokens"), "texts").withColumn("tokens", tokenize("text"))


def queries(t: Tables) -> DataFrame:
    return t.v_queries


@once
def qa(t: Tables) -> DataFrame:
    """Question log derived from the turns, with its grounding flag and source list."""
    return qa_pairs(t.v_turns).select(
        "id", "session_id", "turn", "question", "answer",
        F.when(F.length("answer") % 3 != 0, 1).otherwise(0).alias("grounded"),
        F.when(F.length("answer") % 4 == 0, "[]").otherwise('[{"title":"t","path":"p"}]').alias("sources"))


@once
def page_arrays(t: Tables) -> DataFrame:
    """Pages with their tags and links as arrays; both are a handful per page."""
    tags = t.v_tags.groupBy("rel_path").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "tag"))), lambda x: x["tag"]).alias("tags"))
    links = t.v_links.groupBy("rel_path").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "link"))), lambda x: x["link"]).alias("links"))
    none = F.array().cast("array<string>")
    return (t.v_pages.join(tags, "rel_path", "left").join(links, "rel_path", "left")
            .withColumn("tags", F.coalesce("tags", none)).withColumn("links", F.coalesce("links", none)))


@once
def chunk_vectors(t: Tables) -> DataFrame:
    """Stored vectors placed on the first chunk of the page with the same number."""
    return t.v_embeddings.join(t.v_pages.select("doc_id", "rel_path"), F.col("vec_id") == F.col("doc_id")).select(
        F.concat("rel_path", F.lit("#0")).alias("chunk_id"), "model", F.col("embedding").alias("vector"))


@once
def query_vectors(t: Tables) -> DataFrame:
    return t.v_queries.join(t.v_embeddings, F.col("vec_id") == F.col("query_id")).select(
        "query_id", F.col("embedding").alias("vector"))


@once
def label_queries(t: Tables) -> DataFrame:
    """One query vector per label: the stored vector with the smallest id of that label."""
    return t.v_embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(
        F.col("label").cast("bigint").alias("query_id"), "vector")
