"""Links between pages: resolution, broken and orphan pages, expansion of hits and subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, normalize_path, strip
from ..session import materialize
from .sequences import first_rows, running, top_rows

CONTENT_DIRS = ("concepts", "entities", "sources", "comparisons", "notes", "archive")  # fixed value: search order
DECAY = 0.85
TYPE_BOOST = {"entity": 1.1, "concept": 1.1, "source": 1.05}
STRENGTHS = ("强", "中", "弱")


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Target page of each (rel_path, ord, link): exact path, then path with suffix, then known folders, then title.

    Every link gives a short list of candidate paths; one equi join finds those that exist and the first wins.
    Of pages sharing a title the largest path counts."""
    n = normalize_path("link")
    has_suffix = n.endswith(".md")
    candidates = [(0, n), (1, F.when(~has_suffix & n.contains("/"), F.concat(n, F.lit(".md"))))]
    for i, folder in enumerate(CONTENT_DIRS):
        inside = F.concat(F.lit(folder + "/"), n)
        candidates.append((2 + 2 * i, F.when(~has_suffix, inside)))
        candidates.append((3 + 2 * i, F.concat(inside, F.lit(".md"))))
    options = F.filter(F.array(*[F.struct(F.lit(p).alias("priority"), c.alias("path")) for p, c in candidates]),
                       lambda o: o["path"].isNotNull())
    named = links.where(strip("link") != "")
    by_path = (named.select("rel_path", "ord", "link", F.explode(options).alias("o"))
               .join(pages.select(F.col("rel_path").alias("target")), F.col("o.path") == F.col("target"))
               .select("rel_path", "ord", "link", F.col("o.priority").alias("priority"), "target"))
    titles = (pages.where(F.col("title") != "").groupBy(F.lower("title").alias("t"))
              .agg(F.max("rel_path").alias("target")))
    by_title = (named.join(titles, F.lower(strip("link")) == F.col("t"))
                .select("rel_path", "ord", "link", F.lit(99).alias("priority"), "target"))
    return (by_path.unionByName(by_title).groupBy("rel_path", "ord", "link")
            .agg(F.min_by("target", "priority").alias("target")))


def relative_target(rel_path, link) -> Column:
    """Path of a link taken from the folder of its page, `.` and `..` resolved; NULL when it leaves the root."""
    folder = F.regexp_replace(F.col(rel_path), r"[^/]*$", "")
    parts = F.filter(F.split(F.concat(folder, F.col(link)), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts, F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok")),
        lambda acc, p: F.when(p != "..", F.struct(F.array_append(acc["path"], p).alias("path"), acc["ok"].alias("ok")))
        .otherwise(F.struct(F.slice(acc["path"], F.lit(1), F.greatest(F.size(acc["path"]) - 1, F.lit(0))).alias("path"),
                            (acc["ok"] & (F.size(acc["path"]) > 0)).alias("ok"))))
    return F.when(walked["ok"], F.array_join(walked["path"], "/"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links that are not web addresses and whose file, relative to the page, does not exist."""
    local = links.where(~F.col("link").startswith("http")).withColumn("target", relative_target("rel_path", "link"))
    return local.join(pages.select(F.col("rel_path").alias("target")), "target", "left_anti").select(*links.columns)


def orphan_pages(pages: DataFrame, links: DataFrame, skip_types: tuple[str, ...] = ()) -> DataFrame:
    rows = pages.where(~F.col("type").isin(*skip_types)) if skip_types else pages
    return rows.join(links.select("rel_path").distinct(), "rel_path", "left_anti")


def type_boost(page_type) -> Column:
    out = F.lit(1.0)
    for name, boost in TYPE_BOOST.items():
        out = F.when(F.col(page_type) == name, boost).otherwise(out)
    return out


def leading_chunks(chunks: DataFrame, n: int = 2) -> DataFrame:
    """The first n chunks of every page, in chunk order."""
    return top_rows(chunks, ["rel_path"], [F.asc("ord")], n, "nth")


def graph_expand(hits: DataFrame, edges: DataFrame, pages: DataFrame, chunks: DataFrame, hops: int = 2,
                 per_page: int = 2, final_k: int = 20, room: int | None = None) -> DataFrame:
    """Hits plus chunks of linked pages, decayed by distance; one round of joins per hop.

    hits: query_id, chunk_id, rel_path, score, rank. edges: rel_path, ord, target. Arrivals keep breadth-first
    order (hop, linking page, link, chunk), a chunk counts once, and at most `room`
    (else max(4, 2 x final_k)) are added."""
    if hops < 0:
        raise ValueError(f"hops must not be negative: {hops}")
    room = max(4, 2 * final_k) if room is None else room
    out = hits.select("query_id", "chunk_id", "rel_path", F.col("score").cast("double").alias("score"),
                      F.lit("seed").alias("retrieval"))
    kinds = pages.select("rel_path", type_boost("type").alias("boost"))
    frontier = hits.groupBy("query_id", "rel_path").agg(
        F.min("rank").alias("at"), F.min_by("score", "rank").cast("double").alias("base"))
    used = None
    for hop in range(hops):
        decay = DECAY ** (hop + 1)
        visits = (frontier.join(kinds, "rel_path").join(edges, "rel_path")
                  .select("query_id", "target", (F.col("base") * decay).alias("carried"),
                          (F.col("base") * decay * F.col("boost")).alias("score"), "at", "ord"))
        visits = visits.groupBy("query_id", "target").agg(
            F.min_by(F.struct("at", "ord", "carried", "score"), F.struct("at", "ord")).alias("v")).select(
            "query_id", F.col("target").alias("rel_path"), "v.*")
        reached = chunks.join(visits.select("rel_path").distinct(), "rel_path", "left_semi")
        arrivals = (visits.join(leading_chunks(reached, per_page).select("rel_path", "chunk_id", "nth"), "rel_path")
                    .join(out.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))
        numbered = top_rows(arrivals, ["query_id"], [F.asc("at"), F.asc("ord"), F.asc("nth"), F.asc("chunk_id")],
                            room, "n")
        if used is not None:
            numbered = (numbered.join(used, "query_id", "left")
                        .where(F.col("n") + F.coalesce("taken", F.lit(0)) <= room).drop("taken"))
        if hop + 1 < hops:
            # A few rows per query, used three times below: written once so that hops do not multiply the plan.
            numbered = materialize(numbered, "hop")
        out = out.unionByName(numbered.select("query_id", "chunk_id", "rel_path", "score",
                                              F.lit(f"graph-hop{hop + 1}").alias("retrieval")))
        used = out.where("retrieval <> 'seed'").groupBy("query_id").agg(F.count("*").alias("taken"))
        frontier = numbered.groupBy("query_id", "rel_path").agg(
            F.min("n").alias("at"), F.min_by("carried", "n").alias("base"))
    scored = out.withColumn("score", F.round("score", 6))
    return top_rows(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], final_k)


def page_scores(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", F.split(normalize_path("rel_path"), "#")[0].alias("rel_path")).agg(
        F.max("score").cast("double").alias("score"))


def subgraph_nodes(hits: DataFrame, edges: DataFrame, hops: int = 1, nodes: int = 24) -> DataFrame:
    """Seed pages with their best score, then pages reached over links, closest and strongest first, at most `nodes`."""
    found = page_scores(hits).select("query_id", "rel_path", F.round("score", 6).alias("score"), F.lit(0).alias("hop"))
    frontier = found
    for hop in range(1, hops + 1):
        step = (frontier.join(edges, "rel_path")
                .groupBy("query_id", F.col("target").alias("rel_path"))
                .agg(F.round(F.max(F.col("score") * (DECAY ** hop)), 6).alias("score")))
        frontier = step.join(found.select("query_id", "rel_path"), ["query_id", "rel_path"], "left_anti").withColumn(
            "hop", F.lit(hop))
        found = found.unionByName(frontier.select("query_id", "rel_path", "score", "hop"))
    return top_rows(found, ["query_id"], [F.asc("hop"), F.desc("score"), F.asc("rel_path")], nodes, "node")


def subgraph_edges(kept: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """Links leaving pages closer than `hops`, once per (source, target), kept even if the target was cut."""
    inner = kept.where(F.col("hop") < hops).select("query_id", "rel_path")
    return (inner.join(edges, "rel_path").groupBy("query_id", F.col("rel_path").alias("source"), "target")
            .agg(F.min_by("link", "ord").alias("label")))


def resolve_node_ref(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node id of each (graph, ref): exact id, normalised id, title, substring either way, then stem.

    nodes: graph, id, title, ord. A graph holds few nodes, so the substring legs join on the graph key."""
    wanted = refs.select("graph", "ref").distinct().where(strip("ref") != "")
    low = F.lower(strip("ref"))
    stem = F.lower(F.regexp_replace(base_name(strip("ref")), r"\.md", ""))
    title = F.lower("title")
    rule = (F.when(F.col("id") == strip("ref"), 0).when(F.col("id") == normalize_path("ref"), 1)
            .when(title == "", None)
            .when(title == low, 2).when(title.contains(low) | low.contains(title), 3)
            .when((stem != "") & (title.contains(stem) | title.endswith(stem)), 4))
    return (wanted.join(nodes, "graph").withColumn("priority", rule).where("priority is not null")
            .groupBy("graph", "ref").agg(F.min_by("id", F.struct("priority", "ord")).alias("id")))


def edge_dedup(existing: DataFrame, inferred: DataFrame) -> DataFrame:
    """New edges (graph, source, target, label, strength, ord) without self loops, known pairs and repeats."""
    clean = inferred.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")))
    fresh = clean.join(existing.select("graph", "source", "target"), ["graph", "source", "target"], "left_anti")
    kept = first_rows(fresh, ["graph", "source", "target"], [F.asc("ord")])
    return kept.select(
        "graph", "source", "target", strip(F.coalesce("label", F.lit(""))).alias("label"),
        F.when(strip("strength").isin(*STRENGTHS), strip("strength")).otherwise("中").alias("strength"),
        F.lit("inferred").alias("source_type"))


def merge_inferred(nodes: DataFrame, edges: DataFrame, inferred: DataFrame) -> DataFrame:
    """Edges of each graph plus the inferred ones whose ends resolve to its nodes."""
    refs = inferred.select("graph", F.col("source").alias("ref")).union(inferred.select("graph", F.col("target").alias("ref")))
    ids = resolve_node_ref(refs, nodes)
    src, dst = ids.select("graph", F.col("ref").alias("source"), F.col("id").alias("s")), ids.select(
        "graph", F.col("ref").alias("target"), F.col("id").alias("d"))
    placed = (inferred.join(src, ["graph", "source"]).join(dst, ["graph", "target"])
              .select("graph", F.col("s").alias("source"), F.col("d").alias("target"), "label", "strength", "ord"))
    known = edges.select("graph", "source", "target", "label", F.lit("中").alias("strength"), F.lit("wiki").alias("source_type"))
    return known.unionByName(edge_dedup(edges, placed))


def graph_summary(nodes: DataFrame, edges: DataFrame, max_nodes: int = 30, max_edges: int = 40) -> DataFrame:
    """Node and edge counts per graph with the first few of each."""
    n = nodes.groupBy("graph").agg(F.count("*").alias("node_count"))
    e = edges.groupBy("graph").agg(F.count("*").alias("edge_count"))
    first_n = top_rows(nodes, ["graph"], [F.asc("ord")], max_nodes, "k").groupBy("graph").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("nodes"))
    first_e = top_rows(edges, ["graph"], [F.asc("source"), F.asc("target")], max_edges, "k").groupBy("graph").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat("source", F.lit(">"), "target").alias("e")))),
                    lambda x: x["e"]).alias("edges"))
    return (n.join(e, "graph", "left").join(first_n, "graph").join(first_e, "graph", "left")
            .select("graph", "node_count", F.coalesce("edge_count", F.lit(0)).cast("bigint").alias("edge_count"), "nodes",
                    F.coalesce("edges", F.array().cast("array<string>")).alias("edges")))


def knowledge_map(pages: DataFrame, links: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges among all pages outside inbox and archive, or the first `limit` in folder then path order.

    Equal names are numbered in that order; a common name is numbered in blocks of its folder and first path letters."""
    folder = F.split("rel_path", "/")[0]
    order = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in CONTENT_DIRS]), folder), F.lit(99))
    first = pages.where(~folder.isin("inbox", "archive")).select("rel_path", "title", order.alias("d"))
    if limit is not None:
        first = first.orderBy("d", "rel_path").limit(limit)
    safe = F.substring(F.regexp_replace("title", r"[^a-zA-Z0-9_\x{4e00}-\x{9fff}]", "_"), 1, 40)
    base = first.withColumn("base", F.when(safe == "", "node").otherwise(safe))
    block = F.struct("d", F.substring("rel_path", 1, 24))
    numbered = running(base, ["base"], block, ["d", "rel_path"], sums={"k": F.lit(1)})
    nodes = numbered.select("rel_path", "title", F.when(F.col("k") == 1, F.col("base")).otherwise(
        F.concat("base", F.lit("_"), (F.col("k") - 1).cast("string"))).alias("node"))
    local = (links.where(~F.col("link").rlike("^https?://")).join(nodes.select("rel_path", F.col("node").alias("src")), "rel_path")
             .withColumn("target", relative_target("rel_path", "link")))
    edges = (local.join(nodes.select(F.col("rel_path").alias("target"), F.col("node").alias("dst")), "target")
             .where("src <> dst").select("rel_path", "ord", "src", "dst"))
    return nodes, edges
