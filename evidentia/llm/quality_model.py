"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by its words (the mean of learnt vectors, by hash) and by counts
of its characters and words, and encoded by a small network; gated attention weighs the encodings, and the weighted mean
is scored. Only documents have labels, so what the attention looks at, and what words are worth, is learnt from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import release, single_thread, slices, text_buffer, words
from .labelled import FOLDS, SAMPLE, prior, training_sample
from .store import crc_mod

single_thread()

PASSAGE = 64  # words
HIDDEN, GATE = 32, 16
SLOTS, WORD = 4096, 8  # vectors of words, by hash, and their size
WORDY = 0.02  # pull of the words' vectors to nothing, so that rare words are not learnt by heart
EPOCHS = 14
CUT = 0.3  # documents that score less are rejected

# Character classes: each ASCII symbol is one, then upper, lower, digit, space, line end, control, other.
_CLASS = np.full(256, 38, np.int64)
_symbols = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_symbols] = np.arange(len(_symbols))
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[:33], _CLASS[32], _CLASS[10] = 32, 33, 34, 37, 35, 36
CLASSES = 39
EXTRA = 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features [passages, CLASSES + EXTRA], first passage of each text and the end, slot of every word, words of each passage).
    A text has a passage for every PASSAGE words begun and one at least; a passage reaches from its first word to the next's."""
    hashes, at = words(data, offsets)
    bounds = np.searchsorted(at, offsets)
    n_words = np.diff(bounds)
    bags = np.maximum(1, -(-n_words // PASSAGE))
    firsts = np.append(0, np.cumsum(bags))
    total = int(firsts[-1])
    own = np.arange(len(at)) - np.repeat(bounds[:-1], n_words)  # place of a word in its text
    bag = np.repeat(firsts[:-1], n_words) + own // PASSAGE
    begins = np.zeros(total, np.int64)
    begins[firsts[:-1]] = offsets[:-1]
    heads = np.flatnonzero((own % PASSAGE == 0) & (own > 0))
    begins[bag[heads]] = at[heads]
    sizes = np.diff(np.append(begins, offsets[-1]))
    counts = np.bincount(np.repeat(np.arange(total), sizes) * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES)
    chars = np.maximum(sizes, 1)[:, None]
    in_bag = np.bincount(bag, minlength=total)
    some = np.maximum(in_bag, 1)
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (bag[1:] == bag[:-1])) if len(hashes) else np.zeros(0, bool)
    order = np.lexsort((hashes, bag))
    twice = np.append(False, (hashes[order][1:] == hashes[order][:-1]) & (bag[order][1:] == bag[order][:-1])) if len(hashes) else np.zeros(0, bool)
    extra = np.stack(
        [
            np.bincount(bag, same, total) / some, np.bincount(bag[order], twice, total) / some, sizes / some / 10, np.log1p(in_bag) / 4,
            np.log1p(np.repeat(n_words, bags)) / 8, in_bag == 0, counts[:, : len(_symbols)].sum(1) / some / 2,
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(counts / chars), extra], axis=1).astype(np.float32), firsts, (hashes >> np.uint64(40)).astype(np.int64) % SLOTS, in_bag


class Attention:
    """Weights of encoder, gated attention and score, and the features' scales."""

    def __init__(self, width: int, share: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {
            "t": np.zeros((SLOTS, WORD), np.float32), "w": np.concatenate([init(width, HIDDEN), init(WORD, HIDDEN)]), "b": np.zeros(HIDDEN, np.float32), "v": init(HIDDEN, GATE), "u": init(HIDDEN, GATE), "a": init(GATE, 1)[:, 0],
            "o": init(HIDDEN, 1)[:, 0], "c": np.array([np.log(share / (1 - share))], np.float32),
        }

    def forward(self, x: np.ndarray, firsts: np.ndarray, slots: np.ndarray, in_bag: np.ndarray) -> dict:
        p, starts, sizes = self.p, firsts[:-1], np.diff(firsts)
        mean = np.zeros((len(x), WORD), p["t"].dtype)
        some = in_bag > 0
        if len(slots):
            mean[some] = np.add.reduceat(p["t"][slots], (np.cumsum(in_bag) - in_bag)[some], axis=0) / in_bag[some, None]
        x = np.concatenate([np.clip((x - self.mean) / self.scale, -6, 6), mean], axis=1)
        h = np.tanh(x @ p["w"] + p["b"])
        tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (tv * su) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        return {"x": x, "h": h, "tv": tv, "su": su, "a": a, "z": z, "s": s, "sizes": sizes, "starts": starts, "slots": slots, "in_bag": in_bag}

    def gradient(self, f: dict, y: np.ndarray, weight: np.ndarray) -> dict:
        p, d = self.p, (f["s"] - y) * weight / weight.sum()
        dz = np.repeat(d[:, None] * p["o"], f["sizes"], axis=0)
        da = (dz * f["h"]).sum(1)
        inner = np.repeat(np.add.reduceat(da * f["a"], f["starts"]), f["sizes"])
        de = f["a"] * (da - inner)
        dg = de[:, None] * p["a"]
        dv, du = dg * f["su"] * (1 - f["tv"] ** 2), dg * f["tv"] * f["su"] * (1 - f["su"])
        dh = (dz * f["a"][:, None] + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        per_word = np.repeat((dh @ p["w"][-WORD:].T) / np.maximum(f["in_bag"], 1)[:, None], f["in_bag"], axis=0)
        dt = np.stack([np.bincount(f["slots"], per_word[:, k], SLOTS) for k in range(WORD)], axis=1)
        return {"t": dt, "w": f["x"].T @ dh, "b": dh.sum(0), "v": f["h"].T @ dv, "u": f["h"].T @ du, "a": (f["tv"] * f["su"]).T @ de, "o": f["z"].T @ d, "c": d.sum(keepdims=True)}


def fit_attention(texts: list[str], y: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 3) -> Attention:
    """Adam on batches of documents. With one label only, the score of every text is the prior."""
    net = Attention(CLASSES + EXTRA, share, seed)
    if len(set(y.tolist())) < 2:
        net.p["o"] *= 0
        return net
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    parts = [passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
    x, firsts = np.concatenate([p[0] for p in parts]), np.append(0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts])))
    slots, in_bag = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    word_at = np.append(0, np.cumsum(in_bag))
    net.mean, net.scale = x.mean(0), x.std(0) + 0.02
    rng, moments, step = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}, 0
    ones = y.mean()
    weight = np.where(y == 1, share / ones, (1 - share) / (1 - ones))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            docs = order[at : at + 64]
            sizes = firsts[docs + 1] - firsts[docs]
            own = np.append(0, np.cumsum(sizes))
            rows = np.repeat(firsts[docs] - own[:-1], sizes) + np.arange(own[-1])
            spans = np.stack([word_at[firsts[docs]], word_at[firsts[docs + 1]]], axis=1)
            mine = np.concatenate([slots[i:j] for i, j in spans.tolist()])
            g = net.gradient(net.forward(x[rows], own, mine, in_bag[rows]), y[docs], weight[docs])
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, v in g.items():
                m, s = moments[k]
                v = v + (WORDY / len(y) if k == "t" else 1e-4) * net.p[k]
                m[...] = 0.9 * m + 0.1 * v
                s[...] = 0.99 * s + 0.01 * v * v
                net.p[k] = (net.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _scores(texts: pa.Array, net: Attention) -> np.ndarray:
    data, offsets = text_buffer(texts)
    scores = [np.zeros(0)]
    for a, b in slices(offsets):
        scores.append(net.forward(*passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))["s"].astype(np.float64))
    return np.concatenate(scores)


def _score(batches: Iterator[pa.RecordBatch], net: Attention) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), net))], names=["doc_id", "score"])


def _accept(batches: Iterator[pa.RecordBatch], net: Attention, text: str, cut: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_scores(batch.column(batch.schema.get_field_index(text)), net) >= cut))
    release()


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Attention:
    rows = training_sample(docs, labels, label, sample, doc_id, text)
    return fit_attention(rows["text"].tolist(), rows["y"].to_numpy(), prior(labels, label))


def quality_classifier(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, cut: float = CUT
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The model is fitted on at most `sample` labelled rows outside the held-out fold; every whole text is scored, whatever
    its number of passages. Null and empty texts are one empty passage; without labels of both kinds every text gets the
    prior; repeated rows get equal scores; null ids are scored; no rows give no rows.
    """
    net = quality_model(docs, labels, label, doc_id, text, sample)
    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: _score(b, net), "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def quality_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all columns, that the classifier accepts; texts are scored in place, so nothing is joined."""
    net = quality_model(docs, labels, label, doc_id, text, sample)
    return docs.mapInArrow(lambda b: _accept(b, net, text, cut), docs.schema)
