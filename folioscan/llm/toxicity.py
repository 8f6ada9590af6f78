"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each later model also sees the earlier categories'
probabilities. In training those are out-of-fold predictions, so a later model meets them as unsure as they are on new
texts. The last link is the label itself."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .licenses import words_of

SPACE = 1 << 18      # hashed features
PREFIXES = (4, 5)    # besides whole words, their beginnings: inflected and compound forms
MEMO = 200_000       # words remembered by a task
# Words that make a labelled text an example of a category.
CATEGORIES = {
    "insult": ("clown", "fool", "idiot", "loser", "moron", "stupid"),
    "contempt": ("disgusting", "pathetic", "scum", "trash", "vermin", "worthless"),
}
FINAL = "toxic"


def feature_reader() -> Callable[[str], list[int]]:
    """Distinct hashed features of a text: words and their beginnings."""
    memo: dict[bytes, tuple[int, ...]] = {}

    def of_word(word: bytes) -> tuple[int, ...]:
        found = memo.get(word)
        if found is None:
            found = (zlib.crc32(word) % SPACE, *(zlib.crc32(b"^" + word[:k]) % SPACE for k in PREFIXES if len(word) >= k))
            if len(memo) < MEMO:
                memo[word] = found
        return found

    def read(text: str) -> list[int]:
        return sorted({f for word in set(words_of(text.lower())) for f in of_word(word)})

    return read


@dataclass
class Link:
    """One linear model: weights of hashed features, of the earlier categories, and an offset."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    offset: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, most: int = 512, penalty: float = 1e-3, steps: int = 150) -> Link:
    """Logistic regression on the `most` features that tell the classes apart best, by accelerated gradient steps."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=SPACE).astype(float)
    hit = np.bincount(flat, weights=y[owner], minlength=SPACE)
    rate = y.mean() if len(y) else 0.0
    gap = (hit - seen * rate) / np.sqrt(seen * max(rate * (1 - rate), 1e-9) + 1.0)
    gap[seen < 3] = 0.0
    chosen = np.argsort(-np.abs(gap), kind="stable")[:most]
    chosen = np.sort(chosen[np.abs(gap[chosen]) > 0])
    place = np.full(SPACE, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen) + extra.shape[1] + 1), np.float32)
    x[:, -1] = 1.0
    x[:, len(chosen):-1] = extra
    spot = place[flat]
    x[owner[spot >= 0], spot[spot >= 0]] = 1.0
    w = np.zeros(x.shape[1])
    momentum, ahead = 1.0, w
    step = 4.0 / max(np.linalg.norm(x, 2) ** 2 / max(len(rows), 1), 1e-6) if len(rows) else 0.0
    for _ in range(steps):
        grad = x.T @ (sigmoid(x @ ahead) - y) / max(len(rows), 1) + penalty * np.append(ahead[:-1], 0.0)
        new = ahead - step * grad
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return Link(chosen, w[:len(chosen)], w[len(chosen):-1], float(w[-1]))


def predict(link: Link, rows: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
    dense = np.zeros(SPACE)
    dense[link.features] = link.weights
    return sigmoid(np.array([dense[r].sum() for r in rows]) + extra @ link.earlier + link.offset)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities; a half where there is nothing to learn from."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(y) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + hits[-1])
    last = np.append(p[order][1:] != p[order][:-1], True)  # cut between different values only
    at = int(np.where(last, f1, -1.0).argmax())
    low = p[order][at + 1] if at + 1 < len(y) else 0.0
    return float((p[order][at] + low) / 2)


def train_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], folds: int = 3) -> tuple[dict[str, Link], float, dict[str, np.ndarray]]:
    """Links in the order of `labels`, the cut of the last one, and all out-of-fold probabilities.

    Row i is in fold i % folds. A category whose fold-mates hold one class only still fits: its model is the offset."""
    count = len(rows)
    extra = np.zeros((count, 0))
    fold = np.arange(count) % folds
    links, held_out = {}, {}
    for name, y in labels.items():
        out = np.zeros(count)
        for k in range(folds):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(inside) and len(outside):
                model = fit([rows[i] for i in inside], extra[inside], y[inside])
                out[outside] = predict(model, [rows[i] for i in outside], extra[outside])
        links[name] = fit(rows, extra, y)
        held_out[name] = out
        extra = np.column_stack([extra, out])
    return links, best_threshold(out, labels[name]), held_out


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """Features and labels of at most `sample` labelled texts, chosen by a hash of their key.

    Only the chosen keys are joined to the texts, and only their features come back."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y__"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(sample)
    near = docs.select(F.col(key), F.col(text).alias("text__in")).join(F.broadcast(chosen), key)  # `sample` rows at most
    hashes = {c: {zlib.crc32(w.encode()) % SPACE for w in words} for c, words in CATEGORIES.items()}
    read = map_texts(near, [key, "y__"], "text__in", "f array<int>", lambda: (lambda r: lambda value: (r(value),))(feature_reader()))
    found = read.dropDuplicates([key]).orderBy(F.xxhash64(key), key).toArrow()
    column = found.column("f").combine_chunks()
    rows = [np.asarray(v, np.int64) for v in column.to_pylist()]
    y = np.array(found.column("y__").to_pylist(), float)
    out = {c: np.array([float(bool(t) and not h.isdisjoint(r.tolist())) for r, t in zip(rows, y)]) for c, h in hashes.items()}
    return rows, out | {FINAL: (y > 0).astype(float)}


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text",
                   label: str = "toxic", sample: int = 8000, folds: int = 3) -> DataFrame:
    """`keep`, `p_<category>` for each link of the chain, and `toxic`, for every row.

    The chain is trained on at most `sample` labelled texts, the bound of all that reaches the driver; every text is scored,
    in one narrow scan. `toxic` holds where the last probability reaches the cut that was best out of fold. Null and empty
    texts have no features: only the offsets speak, and they are never called toxic. Labels that are null or lack a text are
    left out; of several labels for a key the highest counts. Without any labelled text nothing is toxic. Repeated rows get
    equal scores; other columns are not read. An empty table gives no rows."""
    rows, y = training_rows(docs, labels, key, text, label, sample)
    links, cut, _ = train_chain(rows, y, folds) if rows else ({c: Link(np.empty(0, int), np.empty(0), np.zeros(i), -30.0) for i, c in enumerate(y)}, 0.5, {})

    def make():
        read = feature_reader()
        dense = []
        for link in links.values():
            w = np.zeros(SPACE, np.float32)
            w[link.features] = link.weights
            dense.append(w)

        def score(value: str) -> tuple:
            features = np.array(read(value), np.int64)
            p: list[float] = []
            for link, w in zip(links.values(), dense):
                z = float(w[features].sum()) + float(np.dot(link.earlier, p)) + link.offset
                p.append(float(sigmoid(np.array(z))))
            return (*p, bool(len(features)) and p[-1] >= cut)

        return score

    return map_texts(docs, keep, text, ", ".join(f"p_{c} double" for c in links) + ", toxic boolean", make)
