"""Chunking, tokens, parsers and retrieval on hand-written rows."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from folioscan.functions import html as H
from folioscan.functions import parsing as X
from folioscan.functions import text as T
from folioscan.operators import activity as A
from folioscan.operators import chunking as K
from folioscan.operators import corpus as P
from folioscan.operators import graph as G
from folioscan.operators import search as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_tokens_of_cjk_runs(spark):
    assert one(spark, T.tokenize("t"), t="知识图谱 ab_1 好 你好") == ["知识图谱", "知识", "识图", "图谱", "ab_1", "好", "你好", "你好"]
    assert one(spark, T.tokenize_plain("t"), t="Éa 知识") == ["a", "知识"]


TABLE = "| a | b |\n|---|---|\n" + "\n".join(f"| row{i} | {'x' * 8} |" for i in range(20))


def test_table_rows_are_never_cut(spark):
    doc = spark.createDataFrame([(1, TABLE, "")], "id int, text string, title string")
    pieces = [r.piece for r in doc.select(F.explode(K.document_array("text", None, 120, 20)).alias("piece")).collect()]
    assert len(pieces) >= 2
    rows = [ln for p in pieces for ln in p.splitlines()]
    assert all(ln.startswith("|") and ln.endswith("|") for ln in rows)
    assert [ln for ln in rows if "row" in ln] == TABLE.splitlines()[2:]
    assert all(p.splitlines()[:2] == TABLE.splitlines()[:2] for p in pieces)


def test_html_table_keeps_rows(spark):
    html = "<table><tr><th>h</th></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(40)) + "</table>"
    pieces = one(spark, K.html_table_array("t", 120), t=html)
    assert len(pieces) > 3 and all(p.startswith("<table><tr><th>h</th></tr>") and p.endswith("</table>") for p in pieces)
    assert "".join(p[len("<table><tr><th>h</th></tr>"):-len("</table>")] for p in pieces) == html[len("<table><tr><th>h</th></tr>"):-len("</table>")]


def test_headings_become_prefixes_and_documents_are_covered(spark):
    text = "lead words\n\n# One\n\n" + "alpha beta. " * 60 + "\n\n## Two\n\nshort\n\nalso short\n\n# Empty\n"
    pieces = one(spark, K.document_array("t", None, 200, 20), t=text)
    assert pieces[0] == "lead words" and any(p.startswith("【One】") for p in pieces)
    assert pieces[-1] == "【Two】\nshort\n\nalso short"
    assert all(len(p) <= 200 for p in pieces)
    assert one(spark, K.document_array("t", None, 200, 20), t="") == []
    long = one(spark, K.plain_windows("t", 480, 80), t="y" * 5000)
    assert long[0] == "y" * 480 and len(long) == 13 and sum(map(len, long)) - 80 * 12 == 5000
    with pytest.raises(ValueError):
        K.plain_windows("t", 80, 80)


def test_parent_child_rows(spark):
    text = "# A\n\n" + "first sentence here. " * 40 + "\n\n# B\n\n" + "second part text. " * 40
    doc = spark.createDataFrame([("n/a.md", "T", text, [])], "rel_path string, title string, text string, tags array<string>")
    rows = K.chunk_parent_child(doc, ["rel_path"], "text", None, 400, 160, 40).collect()
    assert len(rows) > 4 and all(r.text and r.parent_text and len(r.text) <= 160 for r in rows)
    index = K.chunk_rows(doc.withColumnRenamed("text", "body"), 400, 160, 40).collect()
    assert [r.chunk_id for r in index] == [f"n/a.md#{i}" for i in range(len(index))]
    assert all(r.parent_id.startswith("n/a.md#p") and r.tokens for r in index)


def test_pack_sentences(spark):
    text = "一句话。" * 30
    parts = one(spark, K.pack_sentences("t", 40), t=text)
    assert "".join(parts) == text and all(len(p) <= 41 for p in parts)


def test_html(spark):
    page = "<html><title>A &amp; B</title><style>x{}</style><body><h1>Hi</h1><p>one <b>two</b><br>three</p><script>z</script></body>"
    assert one(spark, H.html_title("t"), t=page) == "A & B"
    assert [s.strip() for s in one(spark, H.html_text("t"), t=page).split("\n") if s.strip()] == ["A & B", "Hi", "one two", "three"]
    assert one(spark, H.html_to_plain("t"), t="a<br/>b</p>c&lt;d&gt;") == "a\nb\nc<d>"
    assert one(spark, H.unescape_full("t"), t="a&copy;&#233;&hellip;&#x1F600;&nosuch;&amp;lt; & &#0;z") == "a©é…😀&nosuch;&lt; & \ufffdz"


def test_parsers(spark):
    raw = 'text ```json\n{"edges":[{"source":"A","target":"B","label":"x"}]}\n``` more'
    assert [e.source for e in one(spark, X.json_edges("t"), t=raw)] == ["A"]
    assert one(spark, X.json_edges("t"), t="nothing") is None
    blocks = "<<<MEMORY>>>\nm1\n<<<SKILL_TITLE>>> s <<<PRINCIPLE_TITLE>>>无<<<PRINCIPLE_BODY>>>无"
    row = X.tagged_blocks(spark.createDataFrame([(blocks,)], "raw string"), "raw").first()
    assert (row.memory, row.skill_title, row.skill_body, row.principle_empty) == ("m1", "s", "", True)
    body = "x\n\n### 核心假设\n\n- one\n* two\n\n## next\n- no"
    assert one(spark, T.section_items("t", "核心假设", 8), t=body) == ["one", "two"]
    assert one(spark, T.version_key("t"), t="2.10.x") == [2, 10, 0]
    assert one(spark, T.page_hint("t"), t="a --- 第12页 --- b") == 12
    assert one(spark, T.query_variants("t"), t="什么是知识图谱？")[:3] == ["什么是知识图谱？", "什么是知识图谱", "知识图谱"]
    rules = X.rule_blocks(spark.createDataFrame([(1, "# h\n\n### r_0a1b2c3d · 偏好 2026-01-02 03:04 <!-- enabled: false -->\n- **触发问题**：q\n- **规则**：r\n\n### free\nbody")], "doc int, t string"), "t", ["doc"]).orderBy("ord").collect()
    assert [(r.id, r.enabled, r.at, r.question, r.text, r.kind) for r in rules] == [
        ("r_0a1b2c3d", False, "2026-01-02 03:04", "q", "r", "偏好"), ("", True, "", "", "body", "规则")]


def test_caption_lines(spark):
    vtt = "WEBVTT\n\n1\n00:01 --> 00:02\n<c>hello</c>\nhello\n\n2\n00:02 --> 00:03\nhello\nworld"
    lines = spark.createDataFrame([(1, i, s) for i, s in enumerate(vtt.split("\n"))], "doc int, pos bigint, line string")
    assert [r.line for r in A.collapse_repeats(lines, ["doc"], 3).orderBy("pos").collect()] == ["hello", "world"]


def test_owner_expansion(spark):
    q = spark.createDataFrame([(1, "我的电话是多少"), (2, "weather"), (3, "what did Anna say")], "query_id int, text string")
    rows = A.query_alias_expand(q, {"real_name": "Anna", "nickname": "An", "aliases": "A1,A2"}).orderBy("query_id", "position").collect()
    assert {r.query_id for r in rows} == {1, 3} and [r.text for r in rows if r.query_id == 1][:4] == ["Anna", "Anna 工作", "Anna 记录", "An"]


def test_folder_scope(spark):
    pages = spark.createDataFrame([("notes/a.md", ["f1"]), ("notes/b.md", [])], "rel_path string, folder_ids array<string>")
    assets = spark.createDataFrame([("assets/x.pdf", "sources/x.md", ["f1"])], "rel_path string, wiki_page string, folder_ids array<string>")
    dirs = spark.createDataFrame([("D:\\docs", ["f1"])], "path string, folder_ids array<string>")
    assert sorted(r.path for r in P.folder_scope(["f1"], pages, assets, dirs).collect()) == [
        "@external:D:/docs", "assets/x.pdf", "notes/a.md", "sources/x.md"]


def test_parse_quality_flags(spark):
    docs = spark.createDataFrame([("a", "tiny"), ("b", TABLE), ("c", "见 第3页-表格 的内容，" + "字" * 60)], "name string, text string")
    rows = {r.name: r for r in P.parse_quality(docs).collect()}
    assert rows["a"].issues and not rows["b"].issues and rows["b"].table_chunks >= 1 and rows["c"].issues


def test_fusion_prefers_the_shared_chunk(spark):
    lists = spark.createDataFrame([(1, "keyword", "a", 2.0), (1, "keyword", "b", 1.0), (1, "vector", "b", 2.0), (1, "vector", "c", 1.0)],
                                  "query_id bigint, list string, chunk_id string, score double")
    assert S.best(S.rrf(lists, 10), 1).first().chunk_id == "b"


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, rel_path string, title string, text string, ord bigint").withColumn("tokens", T.tokenize("text"))


@pytest.mark.parametrize("most", [S.AUTOMATON_BYTES, 0])
def test_phrase_scores_equal_sqlite(spark, monkeypatch, most):
    monkeypatch.setattr(S, "AUTOMATON_BYTES", most)
    words = ["alpha", "beta", "gamma", "知识图谱", "aaaa", "ab\\Eab"]
    rows = [(f"c{i}", f"p{i % 7}", "" if i % 5 == 0 else f"Title {words[i % 6]}", " ".join(words[(i * j) % 6] for j in range(1, 3 + i % 9)), i) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(chunk_id unindexed, title, content, tokenize='trigram')")
    con.executemany("insert into f values (?,?,?)", [(c, t, f"{t}\n{x}" if t else x) for c, _, t, x, _ in rows])
    asked = ["alpha beta", "知识图", "aaa", "title gam", "zz", "nothing here", "b\\Ea"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, phrase string")
    got = {(r.query_id, r.chunk_id): r.score for r in S.bm25_phrase(q, chunks(spark, rows), 1000).collect()}
    want = {}
    for i, text in enumerate(asked):
        quoted = '"' + text.replace('"', '""') + '"'
        for c, s in con.execute("select chunk_id, bm25(f) from f where f match ?", (quoted,)).fetchall() if len(text) >= 3 else []:
            want[(i, c)] = max(0.0, -s)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 20


def test_top_scores_equal_full_scores(spark):
    rows = [(f"c{i}", f"p{i % 9}", f"doc {i % 4}", " ".join(f"w{(i * k) % 13}" for k in range(1, 12)) + ("### 核心要点" if i % 8 == 0 else ""), i) for i in range(80)]
    q = spark.createDataFrame([(1, "w1 w2 doc"), (2, "w5"), (3, "absent"), (4, "")], "query_id bigint, text string")
    full = S.best(S.tfidf_scores(q, chunks(spark, rows)), 5).drop("rank")
    top = S.tfidf_top(q, chunks(spark, rows), 5)
    key = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 5)) for r in df.collect())
    assert key(full) == key(top) and len(key(top)) == 10


def test_vector_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id bigint, vector array<float>")
    v = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0, 0.0]), ("d", [])], "chunk_id string, vector array<float>")
    got = {(r.query_id, r.chunk_id): r.score for r in S.vector_scores(q, v, 10).collect()}
    assert got[(1, "a")] == 1.0 and all(s == 0.0 for k, s in got.items() if k != (1, "a")) and len(got) == 8


def test_graph(spark):
    pages = spark.createDataFrame([("notes/a.md", "Alpha", "note"), ("concepts/b.md", "Beta", "concept"), ("notes/c.md", "Gamma", "note")],
                                  "rel_path string, title string, type string")
    links = spark.createDataFrame([("notes/a.md", 0, "beta"), ("notes/a.md", 1, "c"), ("notes/a.md", 2, "nowhere"), ("notes/c.md", 0, "notes/c.md")],
                                  "rel_path string, ord int, link string")
    edges = G.resolve_links(links, pages)
    assert sorted((r.rel_path, r.target) for r in edges.collect()) == [
        ("notes/a.md", "concepts/b.md"), ("notes/a.md", "notes/c.md"), ("notes/c.md", "notes/c.md")]
    hits = spark.createDataFrame([(1, "notes/a.md#0", "notes/a.md", 1.0, 1)], "query_id bigint, chunk_id string, rel_path string, score double, rank int")
    nodes = G.subgraph_nodes(hits, edges)
    assert {r.rel_path: r.score for r in nodes.collect()} == {"notes/a.md": 1.0, "concepts/b.md": 0.85, "notes/c.md": 0.85}
    named = nodes.join(pages, "rel_path").selectExpr("query_id as graph", "rel_path as id", "title", "node as ord")
    known = G.subgraph_edges(nodes, edges).withColumnRenamed("query_id", "graph")
    inferred = spark.createDataFrame([(1, "Beta", "gamma", "causes", "强", 1), (1, "Alpha", "Alpha", "self", "中", 2), (1, "Alpha", "Beta", "dup", "?", 3)],
                                     "graph bigint, source string, target string, label string, strength string, ord int")
    merged = G.merge_inferred(named, known, inferred).collect()
    assert [(r.source, r.target, r.strength) for r in merged if r.source_type == "inferred"] == [("concepts/b.md", "notes/c.md", "强")]
    store = spark.createDataFrame([(f"{p}#{i}", p, i) for p in ("notes/a.md", "concepts/b.md", "notes/c.md") for i in range(3)],
                                  "chunk_id string, rel_path string, ord int")
    grown = {r.chunk_id: r.retrieval for r in G.graph_expand(hits, edges, pages, store, hops=2, final_k=10).collect()}
    assert grown == {"notes/a.md#0": "seed", "concepts/b.md#0": "graph-hop1", "concepts/b.md#1": "graph-hop1",
                     "notes/c.md#0": "graph-hop1", "notes/c.md#1": "graph-hop1"}


def test_upper_median(spark):
    rows = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)] + [("h", 7)], "g string, v int")
    assert {r.g: r.median for r in P.upper_median(rows, "g", "v").collect()} == {"g": 3, "h": 7}


@pytest.mark.parametrize("most", [S.AUTOMATON_BYTES, 0])
def test_any_number_of_phrases(spark, monkeypatch, most):
    monkeypatch.setattr(S, "AUTOMATON_BYTES", most)
    asked = spark.range(10_001).select(F.col("id").alias("query_id"), F.concat(F.lit("term"), "id", F.lit(" ")).alias("q"))
    asked = asked.unionByName(spark.createDataFrame([(20_000, ""), (20_001, "a"), (20_002, "zz"), (20_003, None), (20_004, "term7 ")], "query_id long, q string"))
    rows = spark.createDataFrame([(1, "term7 term10000 out"), (2, "a"), (3, ""), (4, None), (1, "term7 term10000 out")], "n long, hay string")
    got = sorted((r["n"], r["query_id"]) for r in S.containing(rows, "hay", asked, ["n"]).collect())
    assert got == sorted([(1, 7), (1, 10_000), (1, 20_000), (1, 20_004)] * 2 + [(2, 20_000), (2, 20_001), (3, 20_000)])


def test_unicode_blanks(spark):
    rows = spark.createDataFrame([("p", "first\n\u3000\nsecond\n\n#\u3000Head\n\nunder it")], "k string, t string")
    assert [r["col"] for r in rows.select(F.explode(K.paragraph_array("t"))).collect()] == ["first", "second", "#\u3000Head", "under it"]
    assert [(r.heading, r.body.replace("\u3000", "")) for r in K.split_sections(rows, ["k"], "t").collect()] == [("", "first\n\nsecond"), ("Head", "under it")]
    assert one(spark, T.strip_markdown("t"), t="#\u3000Head\n-\u00a0item") == "Head item"
