"""Readers, writers and streaming jobs on real files."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from folioscan.operators import corpus as P
from folioscan.operators import incremental as N
from folioscan.operators.chunking import chunk_rows
from folioscan.sources import readers as R
from folioscan.sources import writers as O
from folioscan.sources.tables import export_all, write_export
from folioscan.sources.buckets import KeyedTable
from folioscan.streaming import jobs as J


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_read_pages(spark, folder):
    put(folder, "notes/a b.md", "---\ntitle: \"A B\"\ntags: [x, 'y']\nlinks: [c]\ncreated: 2026-01-01\npinned: true\n---\nbody\n")
    put(folder, "notes/plain.md", "no front matter")
    put(folder, "inbox/in.md", "---\ntype: source\n---\nz")
    put(folder, "inbox/inbox-processed/old.md", "old")
    put(folder, "other/x.md", "outside")
    rows = {r.rel_path: r for r in R.read_pages(spark, folder).collect()}
    assert set(rows) == {"notes/a b.md", "notes/plain.md", "inbox/in.md"}
    a = rows["notes/a b.md"]
    assert (a.title, a.tags, a.links, a.updated, a.status, a.type, a.pinned, a.body) == ("A B", ["x", "y"], ["c"], "2026-01-01", "draft", "note", True, "body\n")
    assert rows["notes/plain.md"].title == "plain" and rows["notes/plain.md"].body == "no front matter"
    assert {r.rel_path for r in R.read_pages(spark, folder, include_inbox=False).collect()} == {"notes/a b.md", "notes/plain.md"}


def test_inventory_and_fingerprint(spark, folder):
    put(folder, "d/a.md", "1")
    put(folder, "d/b.PNG", b"\x89")
    put(folder, "d/c.xyz", "skip")
    files = {r.rel_path: (r.category, r.mime) for r in R.read_files(spark, folder).collect()}
    assert files == {"d/a.md": ("documents", "text/markdown"), "d/b.PNG": ("images", "image/png")}
    stats = R.dir_stats(R.list_files(spark, folder)).first()
    assert (stats.file_count, stats.supported_count) == (3, 2)
    before = R.dir_fingerprint(spark, folder).first()
    put(folder, "d/a.md", "12")
    spark.catalog.clearCache()
    assert R.dir_fingerprint(spark, folder).first().digest != before.digest


def test_logs_and_sessions(spark, folder):
    put(folder, "log/a.jsonl", '{"id": 1, "q": "x"}\n\nbroken {\n{"id": 2, "q": "y"}\n')
    assert sorted(r.id for r in R.read_jsonl(spark, folder + "/log", "id int, q string").where("id is not null").collect()) == [1, 2]
    O.append_log(spark.createDataFrame([(3, "z")], "id int, q string"), folder + "/log2")
    O.append_log(spark.createDataFrame([(4, "w")], "id int, q string"), folder + "/log2")
    assert spark.read.json(folder + "/log2").count() == 2
    doc = {"id": "s1", "updated": "2026-01-01", "turns": [{"role": "user", "content": "hi"}, {"role": "system", "content": "no"}, {"role": "assistant", "content": " "}]}
    put(folder, "sessions/s1.json", json.dumps(doc, indent=1))
    put(folder, "sessions/bad.json", "{")
    assert [tuple(r)[:4] for r in R.read_session_docs(spark, folder + "/sessions").collect()] == [("s1", 0, "user", "hi")]


def test_decode(spark):
    rows = spark.createDataFrame([(1, bytearray("中文知识".encode("gbk"))), (2, bytearray(b"\xef\xbb\xbfok")), (3, bytearray("é".encode()))], "i int, b binary")
    assert [r.t for r in rows.orderBy("i").select(R.decode_text("b").alias("t")).collect()] == ["中文知识", "ok", "é"]


def test_front_matter_lists(spark):
    text = """---
title: "A: b"
tags:
  - web
  - "two, words"
  - https://x.org/a
links: [one, "t, wo"]
empty:
folder_ids:
- f1
status: draft
status: published
---
body"""
    row = R.page_rows(spark.createDataFrame([("concepts/a.md", text), ("concepts/b.md", "- no front matter\n: here")], "rel_path string, text string")).where("rel_path = 'concepts/a.md'").first()
    assert (row.title, row.status, row.body) == ("A: b", "published", "body")
    assert (row.tags, row.links, row.folder_ids) == (["web", "two, words", "https://x.org/a"], ["one", "t, wo"], ["f1"])


def test_index_upsert(spark, folder):
    page = lambda p, body: (p, "T", body)
    schema = "rel_path string, title string, body string"
    path = folder + "/index"
    O.write_index(chunk_rows(spark.createDataFrame([page(f"n/{i}.md", f"word{i} text") for i in range(20)], schema)), path)
    changed = spark.createDataFrame([page("n/3.md", "fresh words"), page("n/99.md", "added")], schema)
    O.upsert_index(chunk_rows(changed), changed, path)
    got = {r.rel_path: r.text for r in O.read_index(spark, path).collect()}
    assert len(got) == 21 and "fresh words" in got["n/3.md"] and "added" in got["n/99.md"] and "word4" in got["n/4.md"]
    gone = spark.createDataFrame([page(f"n/{i}.md", "") for i in [*range(20), 99]], schema)
    O.upsert_index(chunk_rows(gone.where("false")), gone, path)
    assert O.read_index(spark, path).count() == 0
    for i in range(O.MOST_CHANGES):
        one = spark.createDataFrame([page("n/5.md", f"turn {i}")], schema)
        O.upsert_index(chunk_rows(one), one, path)
    assert [r.text for r in O.read_index(spark, path).collect()] == [O.read_index(spark, path).first().text] and f"turn {i}" in O.read_index(spark, path).first().text
    assert sum(n.endswith("-change") for n in O.versions(spark, path)[-3:]) < O.MOST_CHANGES


def test_chunks_are_written_where_their_pages_lie(spark, folder):
    """No shuffle of the chunks, which hold their page's text several times over; and no join is run to learn how many splits a table has."""
    from folioscan.plans.fixtures import Tables

    pages = spark.range(0, 60, 1, 3).select(F.concat(F.lit("n/"), F.col("id").cast("string")).alias("rel_path"), F.lit("T").alias("title"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.lit(900)), lambda i: F.concat(F.lit("word"), (i * F.col("id") % 5000).cast("string")))).alias("body"))
    O.write_index(chunk_rows(pages), folder + "/even")
    O.write_index(chunk_rows(pages), folder + "/dealt", dealt=True)
    rows = lambda name: sorted(map(tuple, O.read_index(spark, f"{folder}/{name}").select("chunk_id", "text", "parent_text").collect()), key=str)
    assert len(rows("dealt")) > 600 and rows("dealt") == rows("even")
    held = [os.path.join(d, f) for d, _, fs in os.walk(folder + "/dealt") for f in fs if f.endswith(".parquet")]
    assert len(held) == 3 and all(".zstd." in f for f in held)
    t = Tables(spark, "/root/testdata/sf0.001")
    stops = t.documents.groupBy("doc_id").agg(F.raise_error(F.concat(F.lit("it ran "), F.max("lang"))).alias("x")).repartition(3)
    assert t.spread(stops, "doc_id", scan=t.documents).columns == ["doc_id", "x"]


def test_a_stopped_write_loses_nothing(spark, folder):
    schema, path = "rel_path string, title string, body string", folder + "/index"
    O.write_index(chunk_rows(spark.createDataFrame([(f"n/{i}.md", "T", f"word{i} text") for i in range(4)], schema)), path)
    os.makedirs(path + "/0000000002-whole")  # a whole version whose job died
    spark.createDataFrame([("n/1.md",)], "rel_path string").write.parquet(path + "/0000000003-change/rows")  # a change without its last part
    assert O.read_index(spark, path).count() == 4 and O.versions(spark, path) == ["0000000001-whole"]
    changed = spark.createDataFrame([("n/1.md", "T", "fresh")], schema)
    O.upsert_index(chunk_rows(changed), changed, path)
    got = {r.rel_path: r.text for r in O.read_index(spark, path).collect()}
    assert len(got) == 4 and "fresh" in got["n/1.md"] and "word2" in got["n/2.md"]
    O.replace_table(O.read_index(spark, path).where("rel_path <> 'n/0.md'"), path)
    assert O.read_index(spark, path).count() == 3


def test_reports_and_export(spark, folder):
    pages = spark.createDataFrame(
        [("notes/a.md", "A", "note", ["t"], "2026-01-01", "", "draft", ["b.md", "../gone.md"]), ("notes/b.md", "B", "note", [], "2026-01-02", "2026-02-01", "refined", [])],
        "rel_path string, title string, type string, tags array<string>, created string, updated string, status string, links array<string>")
    links = pages.select("rel_path", F.posexplode("links").alias("ord", "link"))
    rows = O.render_index_reports(pages, links, P.page_stats(pages), spark.createDataFrame([("why?",)], "question string"), "2026-03-01 00:00")
    text = {}
    for r in rows.orderBy("report", "section", "key").collect():
        text.setdefault(r.report, []).append(r.line)
    assert set(text) == set(O.REPORTS)
    assert "- [A](../notes/a.md) — `note` / `draft`" in text["tags"] and "## (无标签)" in text["tags"]
    assert "  A --> B" in text["knowledge-map"] and "- [A](../notes/a.md) → `../gone.md`" in text["open-questions"] and "- why?" in text["open-questions"]
    assert text["recent"][-2].startswith("| 2026-02-01 | [B]")
    O.write_reports(rows, folder + "/reports")
    assert spark.read.text(folder + "/reports").count() == rows.count()
    table = export_all({"orders": pages.select("title", "status"), "events": links.select("ord")})
    write_export(table, folder + "/csv", split=True)
    assert sorted(os.listdir(folder + "/csv"))[-2:] == ["_table=events", "_table=orders"]


EVENT = "event_id bigint, user_id string, ts timestamp_ntz, kind string, order_id string"


def events(spark):
    rng, rows, t = random.Random(5), [], dt.datetime(2026, 1, 1)
    for i in range(300):
        t += dt.timedelta(minutes=rng.choice([1, 5, 30, 120]))
        at = t - dt.timedelta(days=1) if i % 25 == 24 else t
        rows.append((i, "hot" if rng.random() < 0.5 else f"u{rng.randrange(4)}", at, rng.choice(["create", "pay", "free", "cancel", "touch"]), f"o{rng.randrange(8)}"))
    return spark.createDataFrame(rows, EVENT)


def streamed(spark, folder, df, build, mode="append", order="event_id", parts=5):
    """Feed the rows as files, one per micro-batch, and collect what the stream wrote."""
    src = folder + "/src"
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = "out_" + os.path.basename(folder).replace("-", "_")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


LAST = (9_999, "end", dt.datetime(2027, 1, 1), "touch", "end")  # moves the watermark past all others


def judged(spark, folder, df, build, **more):
    """What a stream of ordered state says of `df`, once a last event has let all timers fire; rows of that event may be missing."""
    got = streamed(spark, folder, df.union(spark.createDataFrame([LAST], EVENT)), build, **more)
    return [r for r in got.collect() if r.event_id != LAST[0]]


def test_monotone_stream_equals_batch(spark, folder):
    df = events(spark)
    want = {tuple(r) for r in N.monotone_changes(df, "user_id", "event_id", "ts", 64).collect()}
    got = [tuple(r) for r in judged(spark, folder, df, lambda s: J.monotone_stream(s, "user_id", "event_id", "ts"))]
    assert set(got) == want and len(got) == len(want) and 0 < len(want) < 300


def test_rate_limit_stream_equals_batch(spark, folder):
    df = events(spark).where("event_id % 25 <> 24")
    want = {(r.event_id, r.accepted) for r in N.rate_limit(df, "user_id", "ts", 2, 3600).collect()}
    got = [(r.event_id, r.accepted) for r in judged(spark, folder, df, lambda s: J.rate_limit_stream(s, "user_id", "ts", 2, 3600))]
    assert set(got) == want and len(got) == len(want) and len({a for _, a in want}) == 2


def test_lifecycle_stream_equals_batch(spark, folder):
    df = events(spark).where("event_id % 25 <> 24")
    want = {(r.event_id, r.state_before) for r in N.order_lifecycle(df).collect()}
    got = {(r.event_id, r.state_before) for r in judged(spark, folder, df, J.lifecycle_stream)}
    assert got == want and {s for _, s in want} == {"none", "pending", "free", "paid"}


def test_events_out_of_order_are_put_in_order(spark, folder):
    """Every batch mixes times a day apart; within the delay the stream still judges in event-time order."""
    df = events(spark).where("event_id % 25 <> 24")
    shuffled = df.withColumn("event_id", F.pmod(F.col("event_id") * 7, F.lit(301)))  # files are cut by this number, not by time
    want = {(r.event_id, r.accepted) for r in N.rate_limit(shuffled, "user_id", "ts", 2, 3600).collect()}
    got = {(r.event_id, r.accepted) for r in judged(spark, folder, shuffled, lambda s: J.rate_limit_stream(s, "user_id", "ts", 2, 3600, delay="60 days"), parts=3)}
    assert got == want


def test_a_client_is_forgotten_after_its_window(spark, folder):
    """State rows: none is left of clients whose window is over, and none of events that were judged."""
    start = dt.datetime(2026, 1, 1)
    rows = [(i, f"u{i}", start + dt.timedelta(minutes=i), "touch", "o") for i in range(40)]
    q = J.rate_limit_stream(files_stream(spark, folder + "/in", [[r] for r in (*rows[:1], *rows[1:], LAST)], EVENT), "user_id", "ts", 2, 60)
    run = q.writeStream.format("noop").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    left = spark.read.format("statestore").option("path", folder + "/cp").option("stateVarName", "held").load()
    waiting = spark.read.format("statestore").option("path", folder + "/cp").option("stateVarName", "waiting").load()
    assert left.count() <= 1 and waiting.count() <= 1


def test_debounced_stream_equals_batch(spark, folder):
    df = events(spark).where("event_id % 25 <> 24")
    closing = spark.createDataFrame([(999, "end", dt.datetime(2027, 1, 1), "touch", "o")], EVENT)
    want = {tuple(r) for r in N.debounced_batches(df, "user_id", "ts", "1 hour").collect()}
    got = {tuple(r) for r in streamed(spark, folder, df.union(closing), lambda s: J.debounced_stream(s, "user_id", "ts", "1 hour", "0 seconds")).collect()}
    assert got == want


def test_dedup_and_last_seen_streams(spark, folder):
    df = events(spark).where("event_id % 25 <> 24")
    twice = df.union(df.withColumn("event_id", F.col("event_id")))
    got = streamed(spark, folder + "/a", twice, lambda s: J.dedup_stream(s, ["event_id"], "ts", "40 days"))
    assert got.count() == df.count()
    lic = spark.createDataFrame([("hot", "hot", "active", dt.datetime(2030, 1, 1)), ("u1", "u1", "revoked", dt.datetime(2030, 1, 1))],
                                "id string, device_id string, status string, expires_at timestamp_ntz")
    beats = df.selectExpr("event_id", "user_id as id", "user_id as device_id", "ts")
    out = streamed(spark, folder + "/b", beats, lambda s: J.last_seen_stream(s, lic), mode="update")
    want = {r.id: r.last_seen_at for r in N.last_seen(beats, lic).where("last_seen_at is not null").collect()}
    assert {r.id: r.t for r in out.groupBy("id").agg(F.max("last_seen_at").alias("t")).collect()} == want
    windows = streamed(spark, folder + "/c", beats, lambda s: J.rolling_active_stream(s, 2, "0 seconds"))
    assert windows.count() > 0


def files_stream(spark, folder, frames, schema):
    for frame in frames:
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")


def test_table_streams(spark, folder):
    turns = [[("s1", 0, "user", "hello", "t0"), ("s1", 1, "assistant", "a", "t1")], [("s1", 2, "user", "again", "t2"), ("s2", 0, "user", "new", "t3")]]
    schema = "session_id string, turn bigint, role string, content string, at_time string"
    J.session_stream(files_stream(spark, folder + "/s", turns, schema), folder + "/sessions", folder + "/cp1")
    got = {r.session_id: (r.created_at, r.updated_at, r.preview) for r in KeyedTable(spark, folder + "/sessions", ("session_id",)).read().collect()}
    assert got == {"s1": ("t0", "t2", "again"), "s2": ("t3", "t3", "new")}
    changes = [[(1, "a", 1), (1, "b", 2)], [(1, "c", 3), (2, "d", 4)]]
    J.upsert_stream(files_stream(spark, folder + "/u", changes, "id int, name string, v int"), folder + "/table", ["id"], F.desc("v"), folder + "/cp2")
    assert {r.id: r.name for r in KeyedTable(spark, folder + "/table", ("id",)).read().collect()} == {1: "c", 2: "d"}

    def send(frames):
        for f in frames:
            yield f.assign(ok=f["payload"] != "bad", error="refused")[["id", "ok", "error"]]

    J.retry_stream(files_stream(spark, folder + "/r", [[("1", "ok"), ("2", "bad")], [("3", "ok")]], "id string, payload string"), folder + "/queue", send, folder + "/cp3")
    queue = {r.id: (r.sent, r.attempts, r.last_error) for r in J.retry_queue(spark, folder + "/queue").collect()}
    assert queue == {"1": (True, 1, ""), "2": (False, 2, "refused"), "3": (True, 1, "")}


def test_embedding_stream(spark, folder):
    pages = [[("n/a.md", "A", "some words"), ("n/b.md", "B", "other words")], [("n/a.md", "A", "changed words")]]
    stream = files_stream(spark, folder + "/p", pages, "rel_path string, title string, body string")
    J.embedding_stream(stream, folder + "/chunks", folder + "/vectors", "m", lambda texts: [[float(len(x))] * 8 for x in texts], folder + "/cp")
    chunks, vectors = O.read_index(spark, folder + "/chunks"), KeyedTable(spark, folder + "/vectors", ("rel_path",)).read()
    assert N.embedding_todo(chunks, vectors, "m").count() == 0 and vectors.count() == chunks.count()
    assert all(r.dim == 8 for r in vectors.collect())


def test_watched_folders_report_changes(spark, folder):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    schema = "dir string, path string, length bigint, modificationTime timestamp"
    batches = [[("a", "a/1", 3, at(1)), ("b", "b/1", 3, at(1))], [("a", "a/1", 3, at(1)), ("b", "b/2", 5, at(2))], [("a", "a/1", 4, at(3)), ("c", "c/1", 1, at(3))]]
    seen = []
    J.watch_stream(files_stream(spark, folder + "/w", batches, schema), folder + "/known", lambda df, i: seen.append({r.dir: r.files for r in df.collect()}), folder + "/cp")
    assert seen == [{"a": 1, "b": 1}, {"b": 2}, {"a": 1, "c": 1}]
    assert KeyedTable(spark, folder + "/known", ("dir",)).read().count() == 4
