"""Licence, secret and line scans against plain Python, on real and awkward texts."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioscan.llm.licenses import Index, scan_licenses, templates
from folioscan.llm.quality import clean_lines, repeated_words
from folioscan.llm.queries import QUERIES
from folioscan.llm.secrets import base_spans, candidates, redact, scan_secrets

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t ", "word", "x" * 300_000, "a b c d e f g h " * 40, "Ünï cödé — 漢字 …", "the same line here.\nthe same line here.\n", "MIT license mit LICENSE",
       "GNU General Public License, Apache License; CC-BY: cc by", 'api_key = "AbC123xyz987QQ" token:short secret=abcdef12', "AKIA" + "A1" * 9 + " " + "0123456789abcdef" * 3,
       "ſecret=abcdefgh Key password:'longenough'", "#" * 50 + " | home | about | contact |", "licensed under the apache license version 2 0 " * 3]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id at all"), (10_001, "word")], "doc_id long, text string")
    return real.unionByName(odd).withColumns({"n_words": F.lit("clash"), "labels": F.lit(1), "spans": F.lit(2)})


def test_licenses_match_brute_force(docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = docs.select("doc_id", "text").collect()
    want = {}
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        want[r["doc_id"], r["text"]] = (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), sorted({x for _, x in at}))
    found = scan_licenses(docs, ["doc_id"]).collect()
    assert len(found) == len(rows)
    assert sorted((r["n_words"], r["n_base"], r["first_word"] or -1, r["last_word"] or -1, r["base_labels"]) for r in found) == sorted(
        (a, b, c or -1, d or -1, e) for a, b, c, d, e in (want[r["doc_id"], r["text"]] for r in rows))
    for r in found:
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_notices_survive_small_changes(spark):
    texts = [(1, "Preamble. Licensed under the Apache License, Version 2.0. End"), (2, "apache trees have a license to grow, version 2 of them"),
             (3, "Permission is hereby granted to any person that is now obtaining a copy of this software and associated documentation files, to deal in "
                 "the Software without restriction"), (4, "Released under the MIT License. Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[1]["labels"] == ["apache", "apache-2.0"] and got[1]["score"] == 1.0
    assert got[2]["labels"] == [] and got[3]["labels"] == ["mit-notice"] and 0.75 <= got[3]["score"] < 1
    assert got[4]["labels"] == ["cc-by", "cc-by-nc-4.0", "mit", "mit-release"]


def brute_notices(words, least=0.75):
    """Every start of every template, one place for a chain of starts that are at most two words apart."""
    found = []
    for t in templates():
        n, slack, near, size = len(t.words), 0 if t.base else 2, [], len(words)
        for start in range(-n, size + 1):
            hits = sum(w in words[max(start + i - slack, 0):max(start + i + slack + 1, 0)] for i, w in enumerate(t.words))
            span = words[max(start - slack, 0):max(start + n + slack, 0)]
            whole = all(any(tuple(span[i:i + len(k)]) == k for i in range(len(span))) for k in t.keys)
            if hits < n * (1.0 if t.base else least) - 1e-9 or not whole:
                continue
            exact = sum(0 <= start + i < size and words[start + i] == w for i, w in enumerate(t.words))
            if near and start - near[-1][2] <= slack and not t.base:
                near.append((hits / n, exact, start))
            else:
                found += [(t.label, max(near, key=lambda x: (x[0], x[1], -x[2])))] if near else []
                near = [(hits / n, exact, start)]
        found += [(t.label, max(near, key=lambda x: (x[0], x[1], -x[2])))] if near else []
    return sorted((label, max(best[2], 0), best[0]) for label, best in found)


def test_every_notice_is_found_wherever_its_words_also_stand():
    rng, known = random.Random(3), templates()
    vocabulary = sorted({w for t in known for w in t.words})
    index = Index(known, 1000, {w: rng.randrange(1000) for w in vocabulary}, 0.75)
    seen = 0
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            notice = list(rng.choice(known).words)
            for _ in range(rng.randrange(0, 1 + len(notice) // 3)):
                spot = rng.randrange(len(notice))
                notice[spot:spot + rng.randrange(2)] = [rng.choice([b"other", *vocabulary])] * rng.randrange(2)
            words += notice + [rng.choice([b"filler", *vocabulary]) for _ in range(rng.randrange(30))]
        got = sorted((label, start, score) for label, start, score, _ in index.match(words))
        assert got == brute_notices(words)
        seen += any(score < 1 for _, _, score in got)
    assert seen > 20


def brute_spans(text):
    kinds = {"assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
             "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    keep = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    found = [(m.start(), k, m.end()) for k, p in enumerate(kinds.values()) for m in p.finditer(text) if keep[list(kinds)[k]](m)]
    return [f"{list(kinds)[k]}:{s}:{e}" for s, k, e in sorted(found)]


def test_secrets_match_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    found = scan_secrets(docs, ["doc_id"]).collect()
    assert len(found) == len(rows)
    of = lambda spans: [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
    assert sorted(of(r["base"]) for r in found) == sorted(brute_spans(r["text"] or "") for r in rows)
    assert all(set(of(r["base"])) <= set(of(r["spans"])) for r in found)
    assert any(r["base"] for r in found)


def test_novel_strings_are_found_and_words_are_not(spark):
    key = hashlib.sha256(b"x").hexdigest().upper()[:40]
    texts = [(1, f"client.auth({key}) # connect"), (2, "authentication_handler_configuration_2 is a name; auth with authentication_handler_configuration_2 here")]
    texts += [(10 + i, "auth uses authentication_handler_configuration_2 when it starts") for i in range(5)]
    got = {r["doc_id"]: r for r in scan_secrets(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[1]["spans"]] == [("novel", 12, 52)]
    assert got[2]["spans"] == [] and "[secret]" in got[1]["redacted"] and key not in got[1]["redacted"]
    assert redact("abcdefgh", [("a", 1, 4), ("b", 2, 5), ("c", 6, 7)]) == "a[secret]f[secret]h"


def test_keys_near_long_names_and_before_words_are_found(spark):
    key = hashlib.sha256(b"y").hexdigest().upper()[:40]
    texts = [f"AWS_SECRET_ACCESS_KEY_PRODUCTION = '{key}'", f"client_secret_for_the_billing = '{key}'", f"signature_verification_secret_value = '{key}'",
             f"credentials: user_one_two_three_four / {key}", f"{key} is the api key, not the api_key", f"secret_token={key}"]
    got = scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    assert len(got) == len(texts) and all(key not in r["redacted"] for r in got)


def test_digest_query(spark):
    rows = QUERIES["op5_secrets"](spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(",".join(brute_spans(text[r["doc_id"]])).encode()).hexdigest()


def test_long_runs_of_sensitive_words_take_linear_time():
    start = time.time()
    assert candidates("token" * 1_000_000) == [] and base_spans("token" * 1_000_000) == []
    assert candidates("token " * 200_000) == []
    assert time.time() - start < 20
    assert candidates("tokentoken_x = 'A1b2C3d4E5f6G7h8I9'") == [(16, 34)]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spots = {}
    for i in range(len(words) - 7):
        spots.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_matches_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    found = clean_lines(docs.drop("n_words"), ["doc_id"]).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[c] for c in cols) for r in found) == sorted(brute_quality(r["text"] or "") for r in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and r["kept_chars"] <= r["word_chars"]


def test_lines_go_first(spark):
    prose = "This is a plain sentence that says something of use to the reader.\n" * 1
    page = "Home | About | Contact | Login\n" + prose + "We use cookies, see our cookie policy.\n" + "It goes on for quite a while with more words in it, as prose does.\nshort stub"
    junk = "Home | News | Tags | Search\n" * 4 + "one two three four five six seven eight nine ten eleven twelve."
    got = {r["doc_id"]: r for r in clean_lines(spark.createDataFrame([(1, page), (2, junk)], "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[1]["kept"] and "cookie" not in got[1]["clean_text"] and "plain sentence" in got[1]["clean_text"]
    assert (got[1]["n_navigation"], got[1]["n_boilerplate"], got[1]["n_punctuation"]) == (1, 1, 1)
    assert not got[2]["kept"]


def test_repeats_of_colliding_windows():
    assert repeated_words([b"a"] * 9) == 9 and repeated_words([b"a"] * 8) == 0 and repeated_words([]) == 0
    words = [b"%d" % i for i in range(20)]
    assert repeated_words(words + words[3:11]) == 16


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for scan in (scan_licenses, scan_secrets, clean_lines):
        assert scan(none, ["doc_id"]).count() == 0
