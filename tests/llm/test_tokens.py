"""Token counts against the tokenizer's own, text by text."""

import random

import public_tokenizers
import pytest
import sentencepiece

from folioscan.llm import tokens
from folioscan.llm.queries import QUERIES
from folioscan.llm.tokens import Lengths, Splitter, count_tokens

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_query_matches_the_tokenizer(spark, model):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r["text"] or ""
        n = len(model.encode(text))
        want[r["doc_id"]] = (len(text.encode()), n, n > 4096)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op12_token_counts"](spark, SF).collect()}
    assert got == want and any(x[2] for x in got.values())


def test_odd_texts(model, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 500)  # the cache starts again many times
    rng = random.Random(1)
    letters = "ab \n\t▁é日<s>/\x00 1.,  {[_—😀́　\xa0'"
    texts = ["", " ", "▁", "\n", "<s> x </s><unk><0x41>", "word " * 20000, "x" * 50_000, " " * 3000, "\n" * 3000, "a▁▁b", "1" * 400]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    with open(PATH, "rb") as file:
        counts = Lengths(file.read(), ["▁a", "▁b", "b"], bytes([1, 1, 1]))
    got = [n for at in range(0, len(texts), 64) for n in counts.of(texts[at:at + 64])]
    assert got == [len(model.encode(t)) for t in texts]
    assert max(map(len, counts.known)) <= tokens.LONGEST


def test_pre_tokens_rebuild_the_text(model):
    split = Splitter(model)
    text = "  The cat, (sat)\n\nupon a▁mat...  "
    assert "".join(split(text)) == "▁" + text.replace(" ", "▁") and "▁The" in split("The cat") and split("") == []


@pytest.mark.parametrize("rows", [1, 10_000])
def test_odd_rows(spark, model, rows):
    data = [(1, "same text here"), (1, "same text here"), (None, "no id"), (2, None), (3, ""), (4, "y " * 5000), (5, "z" * 100_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'mine' as n_tokens", "1 as over_limit")
    found = count_tokens(docs, ["doc_id"], PATH, sample_rows=rows).collect()
    want = sorted((d or 0, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in data)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == want
    assert count_tokens(docs.limit(0), ["doc_id"], PATH).count() == 0
