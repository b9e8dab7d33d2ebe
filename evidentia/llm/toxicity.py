"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, so tokens get theirs by contrast: in a toxic document the tokens whose form (the word or a stem)
occurs significantly more in toxic documents are toxic, every other token is not. A two-state chain is fitted to these by
gradient ascent with forward-backward marginals. What it sees of a token is more than what labels it: its word and stems,
its stem together with that of the token before and of the one after it, and its shape (case, length, symbols beside it);
those that contrast get weights. The marginals are aggregated per document, and a logistic head, fitted to documents that
the chain did not see, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import _BYTE, _LOWER, _POWER, mixed, slices, text_buffer
from .labelled import FOLDS, SAMPLE, prior, training_sample
from .store import crc_mod

STEMS = (4, 5, 6, 7, 8)  # a token's forms: the whole word and its first bytes
FORMS = 1 + len(STEMS) + 3  # and its stem with those of its neighbours, and its shape
SLOTS = 1 << 18  # of the table that tells most features without weight at once
STEPS = 60  # of the chain's fit
BLOCK = 128  # tokens that a scan takes one after the other; blocks run side by side

_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"*#@$%!0123456789", np.uint8)] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forms: hashes [tokens, FORMS], byte starts, byte ends) of the runs of letters, lower-cased in ASCII and Latin-1 without
    a change of length. A form that a token lacks (a stem longer than it, a neighbour at a text's end) is 0."""
    low = _LOWER[data]
    up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[up] += 0x20
    inside = _LETTER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros((0, FORMS), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(first[at])
    lengths = np.diff(np.append(cuts, len(at)))
    starts = at[cuts]
    place = np.minimum(np.arange(len(at)) - np.repeat(cuts, lengths), len(_POWER) - 1)
    forms = np.zeros((len(starts), FORMS), np.uint64)
    forms[:, 0] = mixed(np.add.reduceat(_BYTE[low[at]] * _POWER[place], cuts))
    total, padded = np.zeros(len(starts), np.uint64), np.append(low, np.zeros(max(STEMS), np.uint8))
    for k in range(max(STEMS)):
        total = total + np.where(lengths > k, _BYTE[padded[starts + k]] * _POWER[k], np.uint64(0))
        if k + 1 in STEMS:
            forms[:, 1 + STEMS.index(k + 1)] = np.where(lengths > k, mixed(total + np.uint64(k + 1)), np.uint64(0))
    k = 1 + len(STEMS)
    stem = np.where(forms[:, 1] != 0, forms[:, 1], forms[:, 0])
    text = np.searchsorted(offsets, starts, "right") - 1
    same = text[1:] == text[:-1]
    both = np.where(same, mixed(stem[:-1] * _POWER[3] + stem[1:]), np.uint64(0))
    forms[1:, k], forms[:-1, k + 1] = both, np.where(same, both ^ np.uint64(0x5851F42D4C957F2D), np.uint64(0))
    capitals = np.add.reduceat((low[at] != data[at]).astype(np.int64), cuts)
    case = np.where(capitals == 0, 0, np.where(capitals == lengths, 1, np.where((capitals == 1) & (low[starts] != data[starts]), 2, 3)))
    near = lambda i: (i >= offsets[text]) & (i < offsets[text + 1]) & _MARK[data[np.clip(i, 0, len(data) - 1)]]
    shape = case + 4 * np.minimum(lengths, 15) + 64 * near(starts - 1) + 128 * near(starts + lengths)
    forms[:, k + 2] = mixed(shape.astype(np.uint64) + np.uint64(1 << 40))
    return forms, starts, starts + lengths


def scan(p: np.ndarray, q: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """r[i] = (p[i] + q[i] r[i-1]) / (s[i] + t[i] r[i-1]), r[-1] = 1, for all i. Blocks first compose their maps side by
    side, one pass joins the blocks, and a second pass side by side fills them in: exact, without a step per token."""
    n = len(p)
    cols = max(1, -(-n // BLOCK))

    def shaped(x: np.ndarray, rest: float) -> np.ndarray:
        return np.ascontiguousarray(np.append(x, np.full(cols * BLOCK - n, rest)).reshape(cols, BLOCK).T)

    p, q, s, t = shaped(p, 0.0), shaped(q, 1.0), shaped(s, 1.0), shaped(t, 0.0)
    a, b, c, d = p[0], q[0], s[0], t[0]  # the map so far: (a + b r) / (c + d r)
    for i in range(1, BLOCK):
        a, b, c, d = p[i] * c + q[i] * a, p[i] * d + q[i] * b, s[i] * c + t[i] * a, s[i] * d + t[i] * b
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    start, r = np.empty(cols), 1.0
    for k, (w, x, y, z) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        start[k] = r
        r = min(1e30, max(1e-30, (w + x * r) / (y + z * r)))
    out = np.empty((BLOCK, cols))
    for i in range(BLOCK):
        out[i] = start = np.clip((p[i] + q[i] * start) / (s[i] + t[i] * start), 1e-30, 1e30)
    return out.T.ravel()[:n]


@dataclass
class Chain:
    """marks: the forms with weights, sorted; move[i, j]: score of going from state i to j."""

    marks: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray
    begin: float
    head: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(SLOTS, bool)
        self.maybe[(self.marks & np.uint64(SLOTS - 1)).astype(np.int64)] = True

    def hits(self, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, number of the form) of every form that has a weight."""
        token, form = np.nonzero(self.maybe[(forms & np.uint64(SLOTS - 1)).astype(np.int64)])
        held = forms[token, form]
        at = np.minimum(np.searchsorted(self.marks, held), max(len(self.marks) - 1, 0))
        right = self.marks[at] == held if len(self.marks) else np.zeros(len(held), bool)
        return token[right], at[right]

    def ratios(self, hits: tuple[np.ndarray, np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emission odds, forward and backward odds of state 1) of the tokens of texts that begin at bounds[:-1]."""
        n = int(bounds[-1])
        e = np.exp(np.clip(self.bias + np.bincount(hits[0], self.weights[hits[1]], n), -20, 20))
        m = np.exp(self.move)
        full = bounds[:-1][bounds[1:] > bounds[:-1]]
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        p, q, s, t = e * m[0, 1], e * m[1, 1], np.full(n, m[0, 0]), np.full(n, m[1, 0])
        p[full], q[full], s[full], t[full] = e[full] * np.exp(self.begin), 0, 1, 0
        ahead = scan(p, q, s, t)
        nxt = np.append(e[1:], 1.0)
        p, q, s, t = np.full(n, m[1, 0]), m[1, 1] * nxt, np.full(n, m[0, 0]), m[0, 1] * nxt
        p[last], q[last], s[last], t[last] = 1, 0, 1, 0
        back = scan(p[::-1], q[::-1], s[::-1], t[::-1])[::-1]
        return e, ahead, back

    def marginals(self, forms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not len(forms):
            return np.zeros(0)
        _, ahead, back = self.ratios(self.hits(forms), bounds)
        odds = ahead * back
        return odds / (1 + odds)

    def score(self, marginals: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(aggregate(marginals, bounds) @ self.head, -30, 30)))


def aggregate(marginals: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: 1, greatest marginal, log of 1 + expected toxic tokens, chance that any is toxic, expected share of
    toxic tokens, log of its tokens. Texts without tokens have all but the first 0."""
    n = np.diff(bounds)
    out = np.zeros((len(n), 6))
    out[:, 0] = 1
    full = n > 0
    if full.any():
        at = bounds[:-1][full]
        total = np.add.reduceat(marginals, at)
        out[full, 1] = np.maximum.reduceat(marginals, at)
        out[full, 2] = np.log1p(total)
        out[full, 3] = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(marginals, 1 - 1e-9)), at))
        out[full, 4] = np.minimum(1, 10 * total / n[full])
        out[full, 5] = np.log1p(n[full]) / 10
    return out


def _lexicon(forms: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Forms that tokens of toxic documents have significantly more often than their share of tokens explains."""
    share, found = max(toxic.mean(), 1e-6), []
    for k in range(forms.shape[1]):
        values, inverse, count = np.unique(forms[:, k], return_inverse=True, return_counts=True)
        ones = np.bincount(inverse, toxic, len(values))
        expected = count * share
        lift = np.log((ones + 0.5) / (expected + 0.5) * (count * (1 - share) + 0.5) / (count - ones + 0.5))
        found.append(values[((ones - expected) / np.sqrt(expected + 1) >= 4) & (lift >= 1.5) & (values != 0)])
    return np.unique(np.concatenate(found))


def fit_chain(texts: list[str], y: np.ndarray, share: float, steps: int = STEPS) -> Chain:
    """Fit chain and head; share is the wanted prior of label 1. With one label only, every score is that prior."""
    empty = Chain(np.zeros(0, np.uint64), np.zeros(0), -8.0, np.array([[0.0, -1.0], [-0.5, 0.5]]), -1.0, np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    if len(set(y.tolist())) < 2:
        return empty
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    parts, counts = [], []
    for i, j in slices(offsets):
        own = offsets[i : j + 1] - offsets[i]
        some, starts, _ = tokens(data[offsets[i] : offsets[j]], own)
        parts.append(some)
        counts.append(np.diff(np.searchsorted(starts, own)))
    forms, bounds = np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))
    del parts
    use = (np.arange(len(y)) * 2654435761 % 2**32 / 2**32) < 0.6  # the chain learns from these, the head from the others

    def chosen(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(mask, np.diff(bounds))
        return forms[rows], np.append(0, np.cumsum(np.diff(bounds)[mask]))

    f, b = chosen(use)
    toxic = np.repeat(y[use] == 1, np.diff(b))
    words = _lexicon(f, toxic) if len(f) else np.zeros(0, np.uint64)
    if not len(words):
        return empty
    chain = Chain(words, np.ones(len(words)), -4.0, empty.move.copy(), -1.0, empty.head)
    hits = chain.hits(f)
    named = np.isin(f[:, : 1 + len(STEMS)], _lexicon(f[:, : 1 + len(STEMS)], toxic)).any(1)
    target = (named & toxic).astype(np.float64)
    starts_at = b[:-1][np.diff(b) > 0]
    inner = np.ones(len(f), bool)
    inner[starts_at] = False
    inner = np.flatnonzero(inner)
    grads = [np.zeros(len(words)), 0.0, np.zeros((2, 2)), 0.0]
    for _ in range(steps):
        e, ahead, back = chain.ratios(hits, b)
        odds = ahead * back
        rest = target - odds / (1 + odds)
        m = np.exp(chain.move)
        r, k = ahead[inner - 1], e[inner] * back[inner]
        joint = np.stack([m[0, 0] + 0 * r, m[0, 1] * k, m[1, 0] * r, m[1, 1] * r * k])
        joint /= joint.sum(0)
        was, now = target[inner - 1], target[inner]
        seen = np.stack([(1 - was) * (1 - now), (1 - was) * now, was * (1 - now), was * now])
        g = [np.bincount(hits[1], rest[hits[0]], len(words)) - 0.1 * chain.weights, rest.sum(), (seen - joint).sum(1).reshape(2, 2) - 0.1 * chain.move, rest[starts_at].sum() - 0.1 * chain.begin]
        for i, x in enumerate(g):
            grads[i] = grads[i] + np.square(x)
        step = [0.5 * x / np.sqrt(v + 1e-6) for x, v in zip(g, grads, strict=True)]
        chain.weights = chain.weights + step[0]
        chain.bias, chain.move, chain.begin = float(chain.bias + step[1]), chain.move + step[2], float(chain.begin + step[3])
    f, b = chosen(~use)
    x, z = aggregate(chain.marginals(f, b), b), y[~use].astype(float)
    ones = max(z.mean(), 1e-3) if len(z) else share
    weight = np.where(z == 1, share / ones, (1 - share) / max(1 - ones, 1e-3))
    head = empty.head.astype(float)

    def likely(head: np.ndarray) -> float:
        v = x @ head
        return float((weight * (z * v - np.logaddexp(0, v))).sum() - 0.025 * head @ head)

    for _ in range(30):  # Newton steps of a weighted logistic regression, halved where they go too far
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (z - p)) - 0.05 * head)
        while likely(head + step) < likely(head) and np.abs(step).max() > 1e-9:
            step = step / 2
        head = head + step
    chain.head = head
    return chain


def _score(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        scores, spans = [], []
        for a, b in slices(offsets):
            raw, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            forms, starts, ends = tokens(raw, own)
            bounds = np.searchsorted(starts, own)
            p = chain.marginals(forms, bounds)
            scores.append(chain.score(p, bounds))
            found: list[list[dict]] = [[] for _ in range(b - a)]
            bad = np.flatnonzero(p >= 0.5)
            if len(bad):
                points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points before each byte
                doc = np.searchsorted(bounds, bad, "right") - 1
                fresh = np.append(True, (np.diff(bad) > 1) | (np.diff(doc) > 0))
                first, last = bad[fresh], bad[np.append(np.flatnonzero(fresh)[1:], len(bad)) - 1]
                for d, i, j in zip(doc[fresh].tolist(), first.tolist(), last.tolist(), strict=True):
                    found[d].append({"start": int(points[starts[i]] - points[own[d]]), "end": int(points[ends[j]] - points[own[d]])})
            spans += found
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, cut: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, spans (code-point offsets, end exclusive).

    The model is fitted on at most `sample` labelled rows outside the held-out fold; every whole text is scored. Null and
    empty texts have no tokens and get the head's score for that; without labels of both kinds every text gets the prior.
    Repeated rows get equal scores; null ids are scored (and held out or not as empty text); no rows give no rows.
    """
    rows = training_sample(docs, labels, label, sample, doc_id, text)
    chain = fit_chain(rows["text"].tolist(), rows["y"].to_numpy(), prior(labels, label))
    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda b: _score(b, chain), "doc_id long, score double, spans array<struct<start: int, end: int>>"
    )
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "spans")
