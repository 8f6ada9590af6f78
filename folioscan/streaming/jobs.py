"""Structured Streaming jobs.

Each job shares its rules with a batch twin in operators.incremental. Queries run with `availableNow` by default: all
waiting input is processed and the query ends; pass a trigger for a continuous run. Checkpoints belong in the shared
folder, so a restarted query goes on where it stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import incremental as N
from ..operators.chunking import chunk_rows
from ..operators.sequences import first_rows
from ..session import materialize
from ..sources.buckets import KeyedTable
from ..sources.readers import fingerprint
from ..sources.writers import exists, upsert_index

NOW = {"availableNow": True}


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str,
                trigger: dict[str, Any] | None = None):
    """Run `step` on every micro-batch; waits for the end of a run over the available input."""
    trigger = trigger or NOW
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if "availableNow" in trigger:
        query.awaitTermination()
    return query


def latest_pages(batch: DataFrame) -> DataFrame:
    """One row per page of a batch: the newest where a `modified` column says so."""
    if "modified" in batch.columns:
        return first_rows(batch, ["rel_path"], [F.desc("modified")])
    return batch.dropDuplicates(["rel_path"])


def stream_ingest(pages: DataFrame, index_path: str, checkpoint: str, trigger: dict[str, Any] | None = None):
    """New or changed pages (rel_path, title, body, optionally modified) to the chunk index."""

    def step(batch: DataFrame, batch_id: int) -> None:
        latest = latest_pages(batch)
        upsert_index(chunk_rows(latest.select("rel_path", "title", "body")), latest, index_path)

    return run_batches(pages, step, checkpoint, trigger)


def changed_files(spark, root: str, first_seen: str | None = None) -> DataFrame:
    """File stream of a folder. With `first_seen`, files older than that time are only taken as already known."""
    files = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length bigint, content binary")
             .option("recursiveFileLookup", True).load(root))
    return files.where(F.col("modificationTime") > F.lit(first_seen).cast("timestamp")) if first_seen else files


def stream_new_contents(files: DataFrame, digest: str, path: str, checkpoint: str, trigger: dict[str, Any] | None = None, buckets: int = 16):
    """Append rows whose content digest is neither repeated in the batch nor stored before.

    Rows lie in hash buckets of the digest; a batch reads the digests of its own buckets and writes only its new rows."""

    def step(batch: DataFrame, batch_id: int) -> None:
        place = F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")
        fresh = materialize(batch.dropDuplicates([digest]).withColumn("bucket", place), "fresh")
        if exists(batch.sparkSession, path):
            mine = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most as many as there are buckets
            # A batch that is run again after a failure writes to its own folders and replaces them.
            known = batch.sparkSession.read.parquet(path).where(F.col("bucket").isin(mine) & (F.col("batch") != batch_id))
            fresh = fresh.join(known.select(digest), digest, "left_anti")
        (fresh.withColumn("batch", F.lit(batch_id)).repartition("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path))

    return run_batches(files, step, checkpoint, trigger)


def dedup_stream(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First event of each key within the watermark delay; state is dropped as the watermark passes."""
    return (events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", delay)
            .dropDuplicatesWithinWatermark(keys).drop("__at"))


def debounced_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Bursts as session windows; a burst is emitted once the watermark has passed its end."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events")).select(
        key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "events")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Events of a key judged in event-time order, whatever order they arrive in.

    An event waits in a map under its millisecond, with a timer set to it. Timers fire in order once the watermark has passed them, so a key
    needs memory for one millisecond of events at a time; what has been judged is deleted. What is remembered of a key beyond that is
    bounded. It goes when `forget` says so in event time, or `ttl` milliseconds of processing time after its last change (None: stays)."""

    memory = "value string"

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", "rows string")
        self.held = handle.getValueState("held", self.memory, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            at = (row["at_ms__"],)
            if self.waiting.containsKey(at):
                self.waiting.updateValue(at, (self.waiting.getValue(at)[0] + "\n" + row["packed__"],))
            else:
                self.waiting.updateValue(at, (row["packed__"],))
                self.handle.registerTimer(at[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        before = self.held.get() if self.held.exists() else None
        after, out = before, []
        if self.waiting.containsKey((at,)):
            rows = [json.loads(line) for line in self.waiting.getValue((at,))[0].split("\n")]
            for row in sorted(rows, key=lambda r: (r["us__"], r["order__"])):
                after, verdict = self.judge(after, row)
                if verdict is not None:
                    out.append(Row(event=json.dumps(row["row__"]), verdict=verdict))
            self.waiting.removeKey((at,))
        if after is not None and (end := self.forget(after)) is not None:
            if end <= at:
                after = None
            elif after != before and not self.waiting.containsKey((end,)):
                self.handle.registerTimer(end)
        if after is None and before is not None:
            self.held.clear()
        elif after != before:
            self.held.update(after)
        yield from out

    def judge(self, memory: tuple | None, row: dict) -> tuple[tuple | None, str | None]:
        """What is remembered after the event, and the verdict on it (None: not passed on)."""
        raise NotImplementedError

    def forget(self, memory: tuple) -> int | None:
        """The millisecond from which the memory no longer matters."""
        return None

    def close(self) -> None:
        pass


class Later(Ordered):
    memory = "latest bigint"

    def judge(self, memory, row):
        if memory is None or row["value__"] > memory[0]:
            return (row["value__"],), ""
        return memory, None


class Limiter(Ordered):
    """At most `limit` accepted times of the trailing window, comma-joined; gone when the last of them has left the window."""

    memory = "kept string"

    def __init__(self, limit: int, span: int):
        super().__init__()
        self.limit, self.span = limit, span

    def judge(self, memory, row):
        now = row["us__"]
        kept = [t for t in map(int, memory[0].split(",")) if now - t < self.span] if memory else []
        ok = len(kept) < self.limit
        return (",".join(map(str, [*kept, now] if ok else kept)),), "true" if ok else "false"

    def forget(self, memory):
        return (max(map(int, memory[0].split(","))) + self.span) // 1000 + 1


# State after each event kind, by state before; anything else leaves the state as it is.
MOVES = {("none", "create"): "pending", ("pending", "pay"): "paid", ("free", "pay"): "paid",
         ("pending", "free"): "free", ("pending", "cancel"): "none"}


class Lifecycle(Ordered):
    memory = "state string"

    def judge(self, memory, row):
        state = memory[0] if memory else "none"
        return (MOVES.get((state, row["row__"]["kind"]), state),), state


def _judged(events: DataFrame, key: str, at: Column, order: str, delay: str, judge: Ordered, value: Column | None = None) -> DataFrame:
    """`events` (columns of plain types) with `verdict`, judged in the order of `at`, then `order`, inside each key. Events later than `delay` are
    dropped. Runs on the RocksDB state store: waiting events lie on disk, not in the task's memory."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    whole = F.struct(*[F.col(c).cast("string").alias(c) for c in events.columns])
    extra = [] if value is None else [value.alias("value__")]
    packed = F.to_json(F.struct(whole.alias("row__"), F.unix_micros("at__").alias("us__"), F.col(order).alias("order__"), *extra), {"ignoreNullFields": "false"})
    timed = events.withColumn("at__", at.cast("timestamp")).withWatermark("at__", delay).select(
        F.col(key), "at__", F.unix_millis("at__").alias("at_ms__"), packed.alias("packed__"))
    out = timed.groupBy(key).transformWithState(judge, "event string, verdict string", "Append", "EventTime")
    strings = out.select(F.from_json("event", ", ".join(f"`{c}` string" for c in events.columns)).alias("e"), "verdict")
    return strings.select(*[F.col(f"e.{f.name}").cast(f.dataType).alias(f.name) for f in events.schema.fields], "verdict")


def monotone_stream(events: DataFrame, key: str, arrival: str, ts: str, delay: str = "0 seconds", ttl: int | None = None) -> DataFrame:
    """Pass an event only if its `ts` is later than that of every earlier one of its key; `arrival` (a number or a time) orders them.

    A key keeps its latest time; with `ttl`, only that many milliseconds after it last rose."""
    number = F.timestamp_seconds(F.col(arrival) + 1) if events.schema[arrival].dataType.typeName() in ("integer", "long") else F.col(arrival)
    value = F.unix_micros(F.col(ts).cast("timestamp"))
    return _judged(events, key, number, arrival, delay, Later(ttl), value).drop("verdict")


def rate_limit_stream(events: DataFrame, key: str, ts: str, limit: int = 8, window_seconds: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """Accept an event if fewer than `limit` accepted ones of its client lie in the trailing window.

    A client keeps at most `limit` times, and is forgotten when the last accepted one has left the window."""
    judged = _judged(events, key, F.col(ts), "event_id", delay, Limiter(limit, window_seconds * 1_000_000))
    return judged.select(*events.columns, (F.col("verdict") == "true").alias("accepted"))


def lifecycle_stream(events: DataFrame, delay: str = "0 seconds", ttl: int | None = None) -> DataFrame:
    """Order states event by event; illegal moves change nothing. An order keeps one word; with `ttl`, only that many milliseconds after
    its last move."""
    return _judged(events, "order_id", F.col("ts"), "event_id", delay, Lifecycle(ttl)).withColumnRenamed("verdict", "state_before")


def last_seen_stream(heartbeats: DataFrame, licenses: DataFrame) -> DataFrame:
    """Running latest valid heartbeat per licence, for output mode update."""
    own = licenses.select("id", F.col("device_id").alias("owner"), "status", "expires_at")
    ok = (F.col("status") == "active") & (F.col("device_id") == F.col("owner")) & (F.col("expires_at") >= F.col("ts"))
    return heartbeats.join(own, "id").where(ok).groupBy("id").agg(F.max("ts").alias("last_seen_at"))


def rolling_active_stream(heartbeats: DataFrame, days: int = 7, delay: str = "1 day") -> DataFrame:
    """Approximate distinct devices per sliding window of `days`, advancing daily."""
    timed = heartbeats.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", f"{days} days", "1 day").alias("w")).agg(
        F.approx_count_distinct("device_id").alias("devices")).select(F.col("w.end").alias("until"), "devices")


def fingerprint_changes(before: DataFrame, after: DataFrame, key: str = "dir") -> DataFrame:
    """Whether each folder's fingerprint differs from the one stored; new folders count as changed."""
    old = before.select(key, F.struct("files", "newest", "digest").alias("old"))
    new = after.select(key, F.struct("files", "newest", "digest").alias("new"))
    return new.join(old, key, "left").select(key, (~F.col("new").eqNullSafe(F.col("old"))).alias("changed"), "new.*")


FILES = "dir string, path string, length bigint, modificationTime timestamp"


def watch_stream(files: DataFrame, path: str, changed: Callable[[DataFrame, int], None], checkpoint: str,
                 trigger: dict[str, Any] | None = None):
    """Watch folders: after each batch of new or changed files (dir, path, length, modificationTime), `changed` is given the fingerprints of the
    folders that differ from what was last known. Known files are a `KeyedTable` by folder, so a batch reads its own folders' buckets.

    `changed` runs before the files count as known: a batch that is run again after a failure reports its folders again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable(batch.sparkSession, path, ("dir",))
        fresh = first_rows(batch.select("dir", "path", "length", "modificationTime"), ["dir", "path"], [F.desc("modificationTime"), F.desc("length")])
        fresh = materialize(fresh, "files")
        dirs = fresh.select("dir").distinct()
        held = table.near(dirs)
        held = batch.sparkSession.createDataFrame([], FILES) if held is None else held.join(dirs, "dir", "left_semi")
        after = held.join(fresh.select("dir", "path"), ["dir", "path"], "left_anti").unionByName(fresh)
        changed(fingerprint_changes(fingerprint(held, ["dir"]), fingerprint(after, ["dir"])).where("changed").drop("changed"), batch_id)
        table.merge(fresh, lambda old, new: old.join(new.select("dir", "path"), ["dir", "path"], "left_anti").unionByName(new))

    return run_batches(files, step, checkpoint, trigger)


def upsert_stream(changes: DataFrame, path: str, keys: list[str], newest: Column, checkpoint: str,
                  trigger: dict[str, Any] | None = None):
    """Keep a `KeyedTable` current: the newest change of each key in a batch replaces or adds its row; only the buckets of these keys are touched.

    Running a batch again gives the same table, so a restart after a failure is safe."""
    def step(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable(batch.sparkSession, path, tuple(keys))
        table.merge(first_rows(batch, keys, [newest]), lambda held, new: N.keyed_upsert(held, new, keys))

    return run_batches(changes, step, checkpoint, trigger)


def session_stream(turns: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None):
    """Sessions, a `KeyedTable`, kept current from a stream of turns."""

    def step(batch: DataFrame, batch_id: int) -> None:
        empty = batch.selectExpr("session_id", "at_time as created_at", "at_time as updated_at", "content as preview")
        KeyedTable(batch.sparkSession, path, ("session_id",)).merge(batch, N.session_upsert, empty)

    return run_batches(turns, step, checkpoint, trigger)


VECTORS = "rel_path string, chunk_id string, model string, text_hash string, dim int, vector array<float>"


def embedding_stream(pages: DataFrame, chunks_path: str, vectors_path: str, model: str, embed: Callable, checkpoint: str,
                     trigger: dict[str, Any] | None = None):
    """After each batch of page changes, embed the chunks that are new or changed and forget dead ones. Vectors are a `KeyedTable` by page: only
    the changed pages are hashed again, and only their buckets written."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = latest_pages(batch)
        chunks = materialize(chunk_rows(latest.select("rel_path", "title", "body")), "chunks")
        upsert_index(chunks, latest, chunks_path)

        def fold(held: DataFrame, changed: DataFrame) -> DataFrame:
            mine, others = held.join(changed, "rel_path", "left_semi"), held.join(changed, "rel_path", "left_anti")
            fresh = N.sync_embeddings(mine.drop("rel_path"), chunks, model, embed).join(chunks.select("chunk_id", "rel_path"), "chunk_id")
            return others.unionByName(fresh.select(*others.columns))

        KeyedTable(spark, vectors_path, ("rel_path",)).merge(latest.select("rel_path"), fold, spark.createDataFrame([], VECTORS))

    return run_batches(pages, step, checkpoint, trigger)


QUEUE = "id string, payload string, sent boolean, attempts int, last_error string"


def retry_stream(items: DataFrame, path: str, send: Callable[[Iterator], Iterator], checkpoint: str,
                 trigger: dict[str, Any] | None = None):
    """Queue new items, then try every unsent one, in order of its id inside each task; failures keep their error and stay queued.

    items: id, payload. `send` maps pandas frames (id, payload) to frames (id, ok, error) inside tasks. Sent items lie in a `KeyedTable` of
    their own and are not read again but for the buckets of new ids; `retry_queue` shows both."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting, sent = KeyedTable(spark, f"{path}/waiting", ("id",)), KeyedTable(spark, f"{path}/sent", ("id",))
        fresh = materialize(batch.dropDuplicates(["id"]).selectExpr("id", "payload", "false as sent", "0 as attempts", "'' as last_error"), "new")
        if (done := sent.near(fresh)) is not None:
            fresh = fresh.join(done.select("id"), "id", "left_anti")
        queue = waiting.read()
        queue = fresh if queue is None else queue.unionByName(fresh.join(queue.select("id"), "id", "left_anti"))
        queue = materialize(queue, "queue")
        stale = queue.limit(0)
        if (done := sent.near(queue)) is not None:  # sent, but a stop kept the batch from taking them off the queue
            stale = queue.join(done.select("id"), "id", "left_semi").withColumn("sent", F.lit(True))
            queue = queue.join(done.select("id"), "id", "left_anti")
        tried = queue.select("id", "payload").repartitionByRange("id").sortWithinPartitions("id").mapInPandas(send, "id string, ok boolean, error string")
        after = materialize(queue.join(tried, "id", "left").selectExpr(
            "id", "payload", "coalesce(ok, false) as sent", "attempts + if(ok is null, 0, 1) as attempts",
            "case when coalesce(ok, false) then '' when ok is null then last_error else error end as last_error"), "tried")
        empty = spark.createDataFrame([], QUEUE)
        sent.merge(after.where("sent"), lambda held, new: held.join(new, "id", "left_anti").unionByName(new), empty)
        waiting.merge(after.unionByName(stale), lambda held, new: held.join(new, "id", "left_anti").unionByName(new.where("not sent")), empty)

    return run_batches(items, step, checkpoint, trigger)


def retry_queue(spark, path: str) -> DataFrame:
    """Sent and waiting items; one that a stopped batch left in both counts as sent."""
    parts = [KeyedTable(spark, f"{path}/{name}", ("id",)).read() for name in ("sent", "waiting")]
    sent, waiting = [spark.createDataFrame([], QUEUE) if p is None else p for p in parts]
    return sent.unionByName(waiting.join(sent.select("id"), "id", "left_anti"))
