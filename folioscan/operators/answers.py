"""The search that answers questions: keyword and vector lists fused, expanded over links, and repeated for every form of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import query_variants
from ..session import materialize
from .activity import query_alias_expand, search_multi
from .graph import graph_expand
from .search import bm25_phrase, hybrid_rrf, keyword_scores, tfidf_top, vector_scores

FORMS = 6  # forms of one question, as a rule of the search


def full_search(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, edges: DataFrame, pages: DataFrame,
                k: int = 10, coarse: int = 20, hops: int = 2) -> DataFrame:
    """`(query_id, chunk_id, rel_path, score, retrieval, rank)`: the k best of each query after fusion and link expansion.

    queries: query_id, text, phrase. query_vectors: query_id, vector. chunks, with tokens, should be stored: it is read for each list."""
    keyword = keyword_scores(bm25_phrase(queries, chunks), tfidf_top(queries, chunks, coarse))
    fused = hybrid_rrf(keyword, vector_scores(query_vectors, vectors, coarse), chunks, k, coarse)
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    seeds = materialize(ranked.join(chunks.select("chunk_id", "rel_path"), "chunk_id"), "seeds")
    return graph_expand(seeds, edges, pages, chunks, hops=hops, final_k=k)


def question_forms(queries: DataFrame, owner: dict[str, str] | None = None, limit: int = FORMS) -> DataFrame:
    """`(query_id, round, text)`: a question, its rewritten forms and, where it refers to the owner, the owner's rows; the first `limit`
    different ones, counted from 1."""
    forms = queries.select("query_id", F.posexplode(query_variants("text")).alias("p", "form"))
    if owner:
        extra = query_alias_expand(queries.select("query_id", "text"), owner, limit + 8)
        forms = forms.unionByName(extra.select("query_id", (F.col("position") + 1000).cast("int").alias("p"), F.col("text").alias("form")))
    first = forms.groupBy("query_id", "form").agg(F.min("p").alias("p"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("p"))  # a handful of forms a question
    return first.withColumn("round", place.cast("bigint")).where(F.col("round") <= limit).select("query_id", "round", F.col("form").alias("text"))


def search_rounds(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, edges: DataFrame, pages: DataFrame,
                  owner: dict[str, str] | None = None, k: int = 10, enough: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """Merged hits over the rounds of each question up to the first whose best score is `enough`, and the log of the rounds.

    All rounds of all questions are one `full_search`; which of them count is settled afterwards."""
    forms = materialize(question_forms(queries, owner), "forms")
    number = (F.col("query_id") * 100 + F.col("round")).alias("number")
    asked = forms.select(number, "query_id", "text")
    found = full_search(asked.select(F.col("number").alias("query_id"), "text", F.col("text").alias("phrase")),
                        asked.join(query_vectors, "query_id").select(F.col("number").alias("query_id"), "vector"), chunks, vectors, edges, pages, k)
    scored = found.join(asked.select(F.col("number").alias("query_id"), F.col("query_id").alias("parent")), "query_id").select(
        F.col("parent").alias("query_id"), (F.col("query_id") % 100).alias("round"), "chunk_id", "score")
    return search_multi(forms, materialize(scored, "rounds"), k, enough)
