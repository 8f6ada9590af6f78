"""Incremental maintenance: what is new or changed, keyed merges, and batch twins of the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import embed_input, strip, text_hash
from ..functions.urls import normalize_url
from .sequences import day_block, first_rows, id_block, neighbour, running

INDEX_ADVISED_AT = 20_000  # chunks from which an inverted index pays off
EMBED_BATCH = 32


# --- new and changed rows -------------------------------------------------------------------------

def embedding_semi(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    return embeddings.where(F.col("model") == model).join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def orphan_embeddings(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def embedding_todo(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks with text whose stored hash is absent, of another model or of other text."""
    wanted = chunks.where(strip("text") != "").select(
        "chunk_id", embed_input("context_prefix", "text").alias("input")).withColumn("text_hash", text_hash("input"))
    stored = embeddings.where(F.col("model") == model).select("chunk_id", "text_hash")
    return wanted.join(stored, ["chunk_id", "text_hash"], "left_anti")


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    expected = chunks.agg(F.count_if(strip("text") != "")).scalar()
    rows = embeddings.where(F.col("model") == model).agg(F.count("*").alias("stored")).withColumn("expected", expected)
    percent = F.when(F.col("expected") == 0, 100).otherwise(F.least(
        F.lit(100), F.bround(100 * F.col("stored") / F.col("expected"), 0))).cast("bigint")
    return rows.withColumn("percent", percent)


def url_new(pages: DataFrame, cache: DataFrame, order: Column, force: bool = False) -> DataFrame:
    """First row of each normalised address that is not stored yet."""
    rows = first_rows(pages.withColumn("url", normalize_url("url")), ["url"], [order])
    return rows if force else rows.join(cache.select("url"), "url", "left_anti")


def asset_new(files: DataFrame, assets: DataFrame, order: Column) -> DataFrame:
    """One file of each new content: copies in the batch and contents already stored are dropped."""
    return first_rows(files, ["digest"], [order]).join(assets.select("digest"), "digest", "left_anti")


def import_missing(legacy: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    return legacy.join(table.select(key), key, "left_anti")


def keyed_upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Insert new keys; for known keys replace only the `update` columns. Changes must have one row per key."""
    update = list(update) if update is not None else [c for c in changes.columns if c not in keys]
    rest = [c for c in table.columns if c not in keys]
    old = table.select(*keys, F.struct(*rest).alias("__old"))
    new = changes.select(*keys, F.struct(*[c for c in changes.columns if c not in keys]).alias("__new"))
    joined = old.join(new, list(keys), "full_outer")

    def cell(c: str) -> Column:
        if c not in changes.columns:
            return F.col(f"__old.{c}")
        fresh = F.col("__new").isNotNull() if c in update else F.col("__old").isNull()
        return F.when(fresh, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))

    return joined.select(*keys, *[cell(c).alias(c) for c in rest])


def session_upsert(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions after appending turns: newest time, and the preview of the latest new user turn if there is one.

    sessions: session_id, created_at, updated_at, preview. turns: session_id, turn, role, content, at_time."""
    said = F.when(F.col("role") == "user", F.col("turn"))
    fresh = turns.groupBy("session_id").agg(
        F.min("at_time").alias("created_at"), F.max("at_time").alias("updated_at"),
        F.max_by(F.substring("content", 1, 80), said).alias("preview"))
    old = sessions.select("session_id", F.struct("created_at", "updated_at", "preview").alias("o"))
    new = fresh.select("session_id", F.struct("created_at", "updated_at", "preview").alias("n"))
    return old.join(new, "session_id", "full_outer").select(
        "session_id", F.coalesce("o.created_at", "n.created_at").alias("created_at"),
        F.coalesce("n.updated_at", "o.updated_at").alias("updated_at"),
        F.coalesce(F.nullif("n.preview", F.lit("")), "o.preview", F.lit("")).alias("preview"))


def bulk_set_status(pages: DataFrame, wanted: DataFrame, status: str = "refined") -> DataFrame:
    """Outcome per requested path, each path once: changed, skipped because already so, or error."""
    path = F.replace(strip("path"), F.lit("\\"), F.lit("/"))
    asked = wanted.select(path.alias("rel_path")).where("rel_path <> ''").distinct()
    unsafe = F.col("rel_path").startswith("/") | F.concat(F.lit("/"), "rel_path", F.lit("/")).contains("/../")
    known = pages.select("rel_path", F.col("status").alias("old"))
    return asked.join(known, "rel_path", "left").select(
        "rel_path", F.when(unsafe | F.col("old").isNull(), "error").when(F.col("old") == status, "skipped")
        .otherwise(status).alias("outcome"))


def apply_status(pages: DataFrame, outcomes: DataFrame, status: str = "refined") -> DataFrame:
    changes = outcomes.where(F.col("outcome") == status).select("rel_path", F.lit(status).alias("status"))
    return keyed_upsert(pages, changes, ["rel_path"], ["status"])


# --- chunk index ----------------------------------------------------------------------------------

def upsert_page_index(store: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace all chunks of the changed pages; pages that now have no chunk disappear."""
    return store.join(changed.select("rel_path").distinct(), "rel_path", "left_anti").select(*store.columns).unionByName(
        fresh.select(*store.columns))


def remove_pages(store: DataFrame, paths: DataFrame) -> DataFrame:
    return store.join(paths.select("rel_path").distinct(), "rel_path", "left_anti").select(*store.columns)


def phrase_rows(chunks: DataFrame) -> DataFrame:
    """Rows of the phrase index: title and content, chunks without text left out."""
    title = F.coalesce("title", F.lit(""))
    return chunks.where(strip("text") != "").select(
        "chunk_id", "rel_path", title.alias("title"),
        F.when(title != "", F.concat(title, F.lit("\n"), "text")).otherwise(F.col("text")).alias("content"))


def index_status(chunks: DataFrame, embeddings: DataFrame, phrases: DataFrame) -> DataFrame:
    count = lambda df: df.agg(F.count("*")).scalar()
    return chunks.agg(F.count("*").alias("chunks")).select(
        "chunks", count(embeddings).alias("embeddings"), count(phrases).alias("phrase_rows"),
        (F.col("chunks") >= INDEX_ADVISED_AT).alias("index_advised"))


def embed_rows(todo: DataFrame, model: str, embed: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> DataFrame:
    """Call a text-to-vector function on the rows of `embedding_todo`, a fixed number of texts per call."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                vectors = embed(part["input"].tolist())
                kept = [(i, v) for i, v in zip(range(len(part)), vectors) if v]
                yield pd.DataFrame({
                    "chunk_id": [part["chunk_id"].iloc[i] for i, _ in kept], "model": model,
                    "text_hash": [part["text_hash"].iloc[i] for i, _ in kept],
                    "dim": pd.Series([len(v) for _, v in kept], dtype="int32"), "vector": [v for _, v in kept]})

    return todo.select("chunk_id", "text_hash", "input").mapInPandas(
        run, "chunk_id string, model string, text_hash string, dim int, vector array<float>")


def rerank_rows(hits: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """Call a (query, text) scoring function on hits; gives the (query_id, position, relevance) rows reranking takes."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            values = score(list(zip(frame["query"], frame["text"])))
            yield pd.DataFrame({"query_id": frame["query_id"], "position": frame["position"],
                                "relevance": pd.Series(values, dtype="float64", index=frame.index)})

    return hits.select("query_id", "position", "query", "text").mapInPandas(run, "query_id bigint, position bigint, relevance double")


def sync_embeddings(embeddings: DataFrame, chunks: DataFrame, model: str, embed: Callable) -> DataFrame:
    """Stored vectors after dropping those of dead chunks and embedding the new or changed ones."""
    fresh = embed_rows(embedding_todo(chunks, embeddings, model), model, embed)
    live = embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return keyed_upsert(live, fresh, ["chunk_id"])


# --- batch twins of streaming jobs ----------------------------------------------------------------

def monotone_changes(events: DataFrame, key: str, arrival: str, ts: str, width: int = 65536) -> DataFrame:
    """Events whose time is later than every earlier arrival of their key."""
    seen = running(events, [key], id_block(arrival, width), [arrival], maxes={"__latest": F.col(ts)}, inclusive=False)
    return seen.where(F.col("__latest").isNull() | (F.col(ts) > F.col("__latest"))).drop("__latest")


def debounced_batches(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """One row per burst: it fires when `gap` has passed without another event of the key."""
    at = F.col(ts).cast("timestamp")
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events")).select(
        key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "events")


def last_seen(heartbeats: DataFrame, licenses: DataFrame) -> DataFrame:
    """Latest valid heartbeat per licence; revoked, unknown-device and expired ones are rejected."""
    own = licenses.select("id", F.col("device_id").alias("owner"), "status", "expires_at")
    judged = heartbeats.join(own, "id", "left")
    ok = (F.col("status") == "active") & (F.col("device_id") == F.col("owner")) & (F.col("expires_at") >= F.col("ts"))
    return judged.groupBy("id").agg(
        F.max(F.when(ok, F.col("ts"))).alias("last_seen_at"), F.count_if(ok).alias("accepted"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("rejected"))


def rolling_active(heartbeats: DataFrame, days: int = 7) -> DataFrame:
    """Distinct devices seen in the `days` days up to and including each day.

    A sweep: a device is active from each of its days until `days` later or its next day, whichever is first. Starts and ends are
    counted per day, and their running sum over the calendar is the result. A device adds two numbers a day, whatever `days` is."""
    daily = heartbeats.select("device_id", F.to_date("ts").alias("d")).distinct()
    coming = F.lead("d").over(W.partitionBy("device_id").orderBy("d"))  # a device has one row a day
    spans = daily.select("d", F.least(F.date_add("d", days), F.coalesce(coming, F.date_add("d", days))).alias("until"))
    moves = spans.select(F.explode(F.array(F.struct(F.col("d").alias("day"), F.lit(1).alias("n")), F.struct(F.col("until").alias("day"), F.lit(-1).alias("n")))).alias("m"))
    moves = moves.groupBy("m.day").agg(F.sum("m.n").alias("n"))
    edges = daily.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a is not null")
    calendar = edges.select(F.explode(F.sequence("a", "b")).alias("day"))  # one row a day
    counted = calendar.join(moves, "day", "left").select("day", F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)).alias("devices"))
    return counted.where("devices > 0")


def rolling_active_sketch(heartbeats: DataFrame, days: int = 7) -> DataFrame:
    """As `rolling_active`, estimated: one HyperLogLog sketch a day, and unions of the sketches of `days` days."""
    daily = heartbeats.groupBy(F.to_date("ts").alias("d")).agg(F.hll_sketch_agg("device_id").alias("s"))
    spread = daily.select("s", F.max("d").over(W.partitionBy()).alias("last"), F.explode(F.sequence("d", F.date_add("d", days - 1))).alias("day"))
    return spread.where(F.col("day") <= F.col("last")).groupBy("day").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("devices"))


def order_lifecycle(events: DataFrame) -> DataFrame:
    """State of the order before each event and what the event did.

    Until the first payment or release of a pending order its state is decided by the last create or cancel event;
    afterwards it is free until a payment, then paid for good. So two aggregates and a running maximum replace a
    per-order fold: events of one order may be spread over many tasks."""
    at = F.struct("ts", "event_id", "kind")
    opens = F.when(F.col("kind").isin("create", "cancel"), at)
    rows = running(events, ["order_id"], day_block("ts"), ["ts", "event_id"], maxes={"__last": opens}, inclusive=False)
    rows = rows.withColumn("__open", F.coalesce(F.col("__last.kind") == "create", F.lit(False)))
    settled = rows.groupBy("order_id").agg(F.min(F.when(F.col("kind").isin("pay", "free") & F.col("__open"), at)).alias("__first"))
    rows = rows.join(settled, "order_id")
    paid = rows.groupBy("order_id").agg(F.min(F.when((F.col("kind") == "pay") & (at >= F.col("__first")), at)).alias("__paid"))
    rows = rows.join(paid, "order_id")
    before = (F.when(F.col("__paid").isNotNull() & (at > F.col("__paid")), "paid")
              .when(F.col("__first").isNotNull() & (at > F.col("__first")), "free")
              .when(F.col("__open"), "pending").otherwise("none"))
    kind, state = F.col("kind"), F.col("state_before")
    outcome = (F.when(kind == "touch", "ignored")
               .when((kind == "create") & (state == "none"), "pending")
               .when((kind == "pay") & state.isin("pending", "free"), "paid")
               .when((kind == "free") & (state == "pending"), "free")
               .when((kind == "cancel") & (state == "pending"), "deleted")
               .when(((kind == "pay") & (state == "paid")) | ((kind == "free") & (state == "free")), "unchanged")
               .otherwise("rejected"))
    return rows.withColumn("state_before", before).withColumn("outcome", outcome).select(*events.columns, "state_before", "outcome")


def retry_state(attempts: DataFrame) -> DataFrame:
    """Queue after the attempts so far: sent, or waiting with the last error."""
    last = attempts.groupBy("id").agg(F.max_by(F.struct("ok", "error"), F.col("attempt")).alias("l"),
                                      F.count("*").alias("attempts"), F.bool_or("ok").alias("sent"))
    return last.select("id", "attempts", "sent", F.when(F.col("sent"), "").otherwise(F.col("l.error")).alias("last_error"))


def oldest_unmailed(feedback: DataFrame, limit: int) -> DataFrame:
    return feedback.where("mailed = 0").orderBy("created_at", "id").limit(limit)


def rate_limit(events: DataFrame, key: str, ts: str, limit: int = 8, window_seconds: int = 3600) -> DataFrame:
    """Accept an event if fewer than `limit` accepted ones of its client lie in the trailing window.

    Whether an event counts depends on those accepted before it, so a run of close events is one sequence. Runs are
    cut wherever a client pauses for a whole window (nothing before the pause matters after it) and spread by
    (client, run); each task then reads its rows in order and remembers at most `limit` times."""
    order = [ts, "event_id"]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = events.withColumn("__t", micros)
    paired = neighbour(timed, [key], day_block(ts), order, ["__t"], "__prev", following=False)
    fresh = F.col("__prev").isNull() | (F.col("__t") - F.col("__prev.__t") >= window_seconds * 1_000_000)
    runs = running(paired.withColumn("__new", fresh.cast("int")).drop("__prev"), [key], day_block(ts), order, sums={"__run": F.col("__new")})
    placed = runs.repartition(key, "__run").sortWithinPartitions(key, "__run", *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    span, names = window_seconds * 1_000_000, list(events.columns)

    def judge(frames: Iterator) -> Iterator:
        from collections import deque

        current, kept = None, deque()
        for frame in frames:
            flags = []
            for client, run, t in zip(frame[key], frame["__run"], frame["__t"]):
                if (client, run) != current:
                    current, kept = (client, run), deque()
                while kept and t - kept[0] >= span:
                    kept.popleft()
                ok = len(kept) < limit
                if ok:
                    kept.append(t)
                flags.append(ok)
            yield frame.assign(accepted=flags)[[*names, "accepted"]]

    return placed.select(*events.columns, "__run", "__t").mapInPandas(judge, f"{fields}, accepted boolean")
