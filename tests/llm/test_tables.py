"""URL rules, tool calls, oracle comparison and the pipeline."""

import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm.queries import LISTED_LABELS, ORACLES, QUERIES, URL_RULES
from folioscan.llm.toolchat import canonical, faults, link_calls, strict_json
from folioscan.llm.urlfilter import judge_urls
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


class Named:
    def __init__(self, key):
        self.run, self.oracle = QUERIES[key], ORACLES[key]


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, key):
    assert compare(spark, connect(SF), Named(key), SF) == ""


def brute_verdict(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    bad = any(x in listed for x in host.split("."))
    return host, path, best and best[1], best[2] if best else "block" if bad else "allow"


URLS = [None, "", "no scheme", "http://", "://x.org", "HTTP://A.ORG/Path?q#f", "http://example.org/en/1", "http://sub.Example.org/en/19?x", "http://notexample.org/es/", "http://com/fr/",
        "https://a.b.com/de/x#y", "http://x.com?/fr/", "http://org", "http://www.free-bets.example.net/x", "http://a..b.net/\nx", "http://u.net/" + "y" * 5000, "a://b://c.org/", "http://x.com/fr/"]


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_urls_match_brute_force(spark, most_bytes):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://x.org/"), (3, "http://x.org/")] + [(100 + i, f"http://h{i}.free-bets.h{i % 7}.net/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    found = judge_urls(pages, URL_RULES, F.split("domain", r"\.")[0].isin(*LISTED_LABELS), rate=0.3, most_bytes=most_bytes).collect()
    assert sorted(map(repr, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found))) == sorted(map(repr, ((i, *brute_verdict(u, LISTED_LABELS)) for i, u in rows)))
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_calls_are_linked_ordered_and_checked(spark):
    schemas = {"f": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}
    calls = [(1, f"c{i}", i, "f", json.dumps({"n": i + 1, "tags": ["ü"]}), f"c{i - 1}" if i else None) for i in range(70)]
    calls += [(2, "a", 0, "f", '{"n": 0, "z": 1}', "b"), (2, "b", 1, "f", "not json", "a"), (3, "a", 4, "g", None, None), (3, "a", 2, "f", '{"n":2}', "missing"), (None, "a", 0, "f", "{}", None),
              (3, None, 1, "f", '{"n": true}', None), (4, "self", 0, None, "[1]", "self")]
    results = [(1, f"c{i}", 100 + i, f"r{i}") for i in range(69)] + [(3, "a", 9, "late"), (3, "a", 5, None), (3, "x", 6, "nobody asked"), (3, None, 7, "loose")]
    rows = link_calls(spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, after string").withColumn("status", F.lit(0)),
                      spark.createDataFrame(results, "conv_id long, call_id string, position long, content string"), schemas).collect()
    got = {(r["conv_id"], r["call_id"], r["status"]): r for r in rows}
    assert len(rows) == 70 + 2 + 1 + 1 + 1 + 1 + 1 + 1
    assert all(got[1, f"c{i}", "linked"]["level"] == i and got[1, f"c{i}", "linked"]["faults"] == [] for i in range(69)) and got[1, "c69", "unanswered"]["level"] == 69
    assert got[1, "c1", "linked"]["record"] == '{"arguments":{"n":2,"tags":["ü"]},"id":"c1","name":"f","result":"r1"}'
    assert got[2, "a", "cycle"]["level"] is None and got[2, "a", "cycle"]["faults"] == ["arguments.z: unknown", "arguments.n: range"] and got[2, "b", "cycle"]["faults"] == ["arguments: no JSON"]
    assert got[3, "a", "linked"]["record"] == '{"arguments":{"n":2},"id":"a","name":"f","result":null}' and got[3, "a", "linked"]["level"] == 0
    assert got[3, "x", "orphan"]["level"] is None and (4, "self", "cycle") in got and got[4, "self", "cycle"]["faults"] == ["name: unknown tool"]
    assert link_calls(spark.createDataFrame([], "conv_id long, call_id string, position long, name string, arguments string, after string"),
                      spark.createDataFrame([], "conv_id long, call_id string, position long, content string"), schemas).count() == 0


def test_schema_faults():
    assert faults(3.5, {"type": "integer"}) == ["arguments: not integer"] and faults(True, {"type": "number"}) == ["arguments: not number"]
    assert faults("abc", {"type": "string", "maxLength": 2}) == ["arguments: length"] and faults("a", {"enum": ["b"]}) == ["arguments: not one of the allowed values"]
    assert faults([1, "x"], {"type": "array", "items": {"type": "integer"}}) == ["arguments[1]: not integer"]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    prose = "The house stands on a hill and from its windows the whole valley with its river and its fields can be seen in the morning. " * 3
    code = "three ships with cargo for the northern towns while a small crew waits on the quay for papers, " * 2
    odd = [(90001, prose + leak, "en", "s", 1), (90002, "In the harbour lie " + code + " api_key = 'Zx81Kq77Lm42' ends here.", "en", "s", 1), (90003, None, None, None, None), (90004, "", "en", "s", 0),
           (90005, "1234 5678", "en", "s", 9), (90002, "Nobody has seen a text with this id which is quite another one, and long enough to be compared with the rest of them.", "en", "s", 1), (None, "words without an id of their own", "en", None, 1)]
    whole = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("detected", F.lit("mine")).withColumn("mix_weight", F.col("doc_id") * 2)
    now, seen, rows = whole, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialize(stage(spark, now, SF), name)
        rows[name] = now.collect()
        seen[name] = {r["doc_id"]: r for r in rows[name]}
    assert not {90003, 90004, 90005} & set(seen["language"]) and len(seen["language"]) >= 0.98 * docs.count()
    assert 90001 in seen["near_duplicates"] and 90001 not in seen["decontamination"]
    assert now.columns == [c for c in whole.columns if c != "mix_weight"] + ["mix_weight", "mix_copies"]
    assert all("mine" == r["detected"] and r["mix_copies"] > 0 for r in seen["mixing"].values())
    texts = [r["text"] for r in seen["near_duplicates"].values()]
    assert len(texts) == len(set(texts)) and None in seen["secrets"]
    for name in ("near_duplicates", "decontamination"):  # both texts under one id stay
        assert sorted("Zx81Kq77Lm42" in r["text"] for r in rows[name] if r["doc_id"] == 90002) == [False, True]
    kept = next(r for r in rows["secrets"] if r["doc_id"] == 90002 and "harbour" in r["text"])
    assert "Zx81Kq77Lm42" not in kept["text"] and "[secret]" in kept["text"] and kept["n_chars"] == len(kept["text"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, whole.limit(0), SF).count() == 0


def test_the_rest_works_without_this_subpackage():
    code = """
        import builtins, sys
        real = builtins.__import__
        def gone(name, globals=None, locals=None, fromlist=(), level=0):
            if "llm" in name or name == "corpus_pipeline":
                raise ModuleNotFoundError(name)
            return real(name, globals, locals, fromlist, level)
        builtins.__import__ = gone
        import __spark_entry__ as e
        assert not [k for k in e.queries() if k.startswith("op") or k == "pipeline"] and len(e.queries()) > 150 and e.oracle_sql()
    """
    assert subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, timeout=120).returncode == 0


@pytest.mark.parametrize("text", ['{"a": NaN}', "[Infinity]", "-Infinity", '{"a": 1, "a": 2}', "1e999", "", "{"])
def test_what_is_no_json(text):
    with pytest.raises(ValueError):
        strict_json(text)


def test_numbers_types_and_values():
    assert canonical(strict_json('{"b": 1.0, "a": [1e2, 0.5, -0.0, true]}')) == '{"a":[100,0.5,0,true],"b":1}'
    either = {"type": ["integer", "null"], "enum": [1, None, 2.0]}
    assert [faults(v, either) for v in (1, None, 2)] == [[], [], []]
    assert faults(True, {"enum": [1]}) == ["arguments: not one of the allowed values"] and faults("x", either) == ["arguments: not integer or null"]


def test_refused_arguments_keep_their_text(spark):
    calls = spark.createDataFrame([(1, "a", 0, "f", '{"n": NaN}', None), (1, "b", 1, "f", '{"n": 2.0}', "a"), (1, "c", 2, "f", '{"n":1,"n":2}', "b")],
                                  "conv_id long, call_id string, position long, name string, arguments string, after string")
    results = spark.createDataFrame([], "conv_id long, call_id string, position long, content string")
    got = {r["call_id"]: r for r in link_calls(calls, results, {"f": {"properties": {"n": {"type": "integer"}}}}).collect()}
    assert [got[k]["faults"] for k in "abc"] == [["arguments: no JSON"], [], ["arguments: no JSON"]]
    assert [json.loads(got[k]["record"])["arguments"] for k in "abc"] == ['{"n": NaN}', {"n": 2}, '{"n":1,"n":2}']
    assert '"n":2}' in got["b"]["record"]
