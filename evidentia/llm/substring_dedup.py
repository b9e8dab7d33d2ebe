"""Substring dedup by compact windows.

A text is its sequence of tokens (hashed 5-word shingles). For a hash function, a node of the Cartesian tree over the
tokens' hash values with at least WINDOW tokens below it is a compact window: all subsequences that contain its place
and stay inside have the same min-hash. Of these only the subsequences of WINDOW tokens matter, since a passage has at
least one, so a compact window is kept as the interval of their first places. A passage that two texts share makes at
least two functions agree on it, so
1. only tokens that are a minimum somewhere are compared between documents, to find the ones several documents hold;
2. in documents that hold such tokens the intervals of every two functions are joined: where they overlap, the two minima
   belong to one subsequence, and together they are its key;
3. documents with one key meet at two hubs (the least and the greatest document), never as all pairs. A document that
   quotes a few words of a passage holds hardly ever two minima of one of its subsequences, so it is no hub;
4. pairs of regions that share keys are verified on the tokens themselves;
5. verified pairs contract, and what a hub's family still holds apart (regions with a key outside every verified passage,
   and all outside its largest component) is compared with the members that hold the same keys, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .grams import BITS, WORDS, gram_hashes, mixed, pack48, slices, text_buffer, unpack48, words
from .jaccard_join import shared_grams, shared_lists
from .store import drop, keep, written_alone

PASSAGE = 50  # words that a repeated passage has at least
WINDOW = PASSAGE - WORDS + 1
FUNCTIONS = 4
SHARE = 0.8  # of a passage's tokens
LEAST = math.ceil(SHARE * WINDOW)  # tokens that two passages have in common at least
MEAN = math.ceil(2 * SHARE / (1 + SHARE) * WINDOW)  # tokens of the other in WINDOW of one's own, in the mean of both passages
BLOCK = 1024  # regions of a block in the last comparison
MASS = 1 << 20  # tokens of a block in the last comparison, on average
STEP = 1024  # places that are looked up at a time

_SEEDS = mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def streams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, where each row's tokens begin and the end) for runs of texts. WORDS - 1 zeros end
    every text with a word, so no window reaches over."""
    data, offsets = text_buffer(texts)
    for a, b in slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        hashes, at = words(data[offsets[a] : offsets[b]], own)
        bounds = np.searchsorted(at, own)
        tokens = np.append(gram_hashes(hashes), np.zeros(min(len(hashes), WORDS - 1), np.uint64)) >> np.uint64(64 - BITS)
        for k in range(1, WORDS):
            ends = bounds[1:] - k
            tokens[ends[ends >= bounds[:-1]]] = 0
        yield a, b, tokens, bounds


def _slide(h: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best of every n consecutive values."""
    span = 1
    while span * 2 <= n:
        h, span = best(h[:-span], h[span:]), span * 2
    return best(h[: len(h) - (n - span)], h[n - span :]) if n > span else h


def values(tokens: np.ndarray, f: int) -> np.ndarray:
    """The hash values of a function, never 0 but between texts."""
    return np.where(tokens == 0, np.uint64(0), mixed(tokens ^ _SEEDS[f]) | np.uint64(1))


def nodes(tokens: np.ndarray, f: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash values, the least of every `window` of them, minima)."""
    h = values(tokens, f)
    if len(tokens) < window:
        return h, h[:0], np.zeros(0, np.int64)
    low = _slide(h, window, np.minimum)
    high = _slide(np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)]), window, np.maximum)
    return h, low, np.flatnonzero((high == h) & (h != 0))


def minima(tokens: np.ndarray, f: int, window: int = WINDOW) -> np.ndarray:
    """Places that are the minimum of some `window` tokens of one text: the nodes of the Cartesian tree with so many
    tokens below them."""
    return nodes(tokens, f, window)[2]


def runs(tokens: np.ndarray, f: int, window: int = WINDOW, own: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the minimum, first and last begin) of the compact windows: every `window` tokens that begin in this interval
    have their minimum there (of equal tokens the first). Subsequences that reach over a text's end are in none. own: what
    nodes gives, where it is known."""
    if len(tokens) < window:
        return (np.zeros(0, np.int64),) * 3
    h, low, at = own or nodes(tokens, f, window)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    last = np.append(first[1:], len(low)) - 1
    inside = low[first] != 0
    first, last = first[inside], last[inside]
    # The place is the first one at or after the interval's begin that has the value.
    known, rank = np.unique(h[at], return_inverse=True)
    order = np.sort(rank * (len(h) + 1) + at)
    wanted = np.searchsorted(known, low[first]) * (len(h) + 1)
    return order[np.searchsorted(order, wanted + first)] - wanted, first, last


def sequence_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits for each text's token sequence; texts of fewer than WORDS words have no use for theirs."""
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    total = np.append(np.uint64(0), np.cumsum(mixed(tokens + mixed(place.astype(np.uint64) + np.uint64(1)))))
    return mixed(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, tokens, bounds in streams(batch.column(1)):
            ids.append(sequence_ids(tokens, bounds))
            n.append(np.diff(bounds))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(ids)), pa.array(np.concatenate(n), pa.int64())], names=["doc_id", "seq_id", "n_words"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    seen: set[int] = set()  # equal texts of a task go once
    for batch in batches:
        for a, b, tokens, bounds in streams(batch.column(0)):
            at = np.unique(np.concatenate([minima(tokens, f) for f in range(FUNCTIONS)]))
            cuts, ids = np.searchsorted(at, bounds), sequence_ids(tokens, bounds).tolist()
            for k, i in enumerate(ids):
                if cuts[k + 1] > cuts[k] and i not in seen:
                    seen.add(i)
                    yield i, np.unique(tokens[at[cuts[k] : cuts[k + 1]]])


_REGION = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("tokens", pa.binary()), ("key", pa.list_(pa.int64())), ("c", pa.list_(pa.int32()))])
_REGION_SQL = "doc_id long, start int, tokens binary, key array<long>, c array<int>"


def keys(tokens: np.ndarray, use: np.ndarray, own: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first and last begin of the subsequences) where the compact windows of two functions overlap: the interval
    join of their runs, for every two functions. use tells which tokens count, own has the functions' nodes. The last four bits of a key name the functions."""
    found, each = [], []
    for f in range(FUNCTIONS):
        c, first, last = runs(tokens, f, own=own[f])
        good = use[c]
        each.append((c[good], first[good], last[good]))
    for f in range(FUNCTIONS):
        for g in range(f):
            (c, i, j), (d, k, m) = each[f], each[g]
            if not len(c) or not len(d):
                continue
            # Runs of one function are disjoint and in order, so a run of f meets a range of g's.
            begin, end = np.searchsorted(m, i), np.searchsorted(k, j, "right")
            many = np.maximum(end - begin, 0)
            x = np.repeat(np.arange(len(c)), many)
            y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
            key = mixed(tokens[c[x]] * np.uint64(0x9E3779B97F4A7C15) + mixed(tokens[d[y]])) & ~np.uint64(15) | np.uint64(1 << f | 1 << g)
            begin = np.maximum(i[x], k[y])
            found.append((key.view(np.int64), np.maximum(c[x], begin), begin, np.minimum(j[x], m[y])))  # of repeated tokens the first may lie before
    return tuple(np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _regions_of(ids: list[int], tokens: np.ndarray, bounds: np.ndarray, shared: np.ndarray) -> pa.RecordBatch | None:
    """Regions of texts: what subsequences cover whose two minima are shared tokens (numbers text << BITS | token, sorted)."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64)
    by_function = [nodes(tokens, f) for f in range(FUNCTIONS)]
    at = np.unique(np.concatenate([x[2] for x in by_function]))
    mark = text[at] << np.uint64(BITS) | tokens[at]
    use = np.zeros(len(tokens), bool)
    if len(shared):
        use[at] = shared[np.minimum(np.searchsorted(shared, mark), len(shared) - 1)] == mark
    key, c, first, last = keys(tokens, use, by_function)
    if not len(key):
        return None
    order = np.argsort(first, kind="stable")
    key, c, first, end = key[order], c[order], first[order], last[order] + WINDOW
    reach = np.maximum.accumulate(end)
    cuts = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    a, b = first[cuts], np.append(reach[cuts[1:] - 1], reach[-1])
    region = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(key))))
    order = np.lexsort((c, key, region))
    key, c, region = key[order], c[order], region[order]
    once = np.append(True, (key[1:] != key[:-1]) | (region[1:] != region[:-1]))
    key, c, region = key[once], c[once], region[once]
    own = text[a].astype(np.int64)
    base = bounds[own]
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(region, minlength=len(cuts)))), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[k] for k in own], pa.int64()), pa.array(a - base, pa.int32()),
            pa.array([pack48(tokens[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
            pa.ListArray.from_arrays(offsets, pa.array(key, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(c - base[region], pa.int32())),
        ],
        schema=_REGION,
    )


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, shared = batch.column(0).to_pylist(), batch.column(2)
        for a, b, tokens, bounds in streams(batch.column(1)):
            lists = shared.slice(a, b - a)
            marks = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy()).astype(np.uint64) << np.uint64(BITS) | lists.flatten().to_numpy().astype(np.uint64)
            if (out := _regions_of(ids[a:b], tokens, bounds, np.sort(marks))) is not None:
                yield out


class Index:
    """A region's tokens in order of value, to find where it holds another one's."""

    def __init__(self, tokens: np.ndarray):
        self.size, self.tokens = len(tokens) + 1, tokens
        self.place = np.argsort(tokens, kind="stable")
        self.sorted = tokens[self.place]
        self.repeats = bool((self.sorted[1:] == self.sorted[:-1]).any())
        if self.repeats:  # (first of the token, place) as one number, in order
            self.both = np.searchsorted(self.sorted, self.sorted) * self.size + self.place

    def matches(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): places of x whose token is here, in order, and its place here. Of a token that is here several times the place
        nearest to the diagonal of the last one that is here once."""
        at = np.searchsorted(self.sorted, x)
        i = np.flatnonzero(self.sorted[np.minimum(at, len(self.sorted) - 1)] == x)
        at = at[i]
        j = self.place[at]
        if not self.repeats or not len(i):
            return i, j
        last = np.searchsorted(self.sorted, x[i], "right")
        once = last - at == 1
        if once.all():
            return i, j
        seen = np.maximum.accumulate(np.where(once, np.arange(len(i)), -1))
        first = int(np.argmax(once))
        aim = np.clip(i + (j - i)[np.where(seen < 0, first, seen)], 0, self.size - 1)
        k = np.searchsorted(self.both, at * self.size + aim)
        low, high = np.maximum(k - 1, at), np.minimum(k, last - 1)
        near, far = self.place[low], self.place[high]
        return i, np.where(np.abs(near - aim) <= np.abs(far - aim), near, far)


def _ranges(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """The longest ranges of matches whose similarity is SHARE, in runs of rising places on both sides; ranges do not overlap.

    k matches on spans of m and n tokens are similar where k >= SHARE (m + n - k), so with `level` below, where the level of
    a range's end is at most 1.8 - 1.6 below that of its begin.
    """
    shift = j - i
    alike = np.abs(np.diff(shift)) <= WINDOW
    good = np.append(alike, False) | np.append(False, alike)  # a match that is far from both neighbours' diagonals is none
    kept = np.flatnonzero(good)
    i, j = i[kept], j[kept]
    cuts = np.flatnonzero(np.append(True, j[1:] <= j[:-1])) if len(j) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(j))
    level = (1 + SHARE) * np.arange(len(i)) - SHARE * i - SHARE * j
    big = ends - cuts >= LEAST
    rest = list(zip(cuts[big].tolist(), ends[big].tolist(), strict=True))
    while rest:
        a, b = rest.pop()
        own = level[a:b]
        most = np.maximum.accumulate(own[::-1])[::-1]
        size = np.searchsorted(-most, -own + (1 - SHARE) + 1e-9, "right") - np.arange(b - a)
        at = int(np.argmax(size))
        if size[at] < LEAST:
            continue
        begin, end = a + at, a + at + int(size[at])
        yield int(kept[begin]), int(kept[end - 1])
        rest += [(p, q) for p, q in ((a, begin), (end, b)) if q - p >= LEAST]


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two ranges, 0 if that of the PASSAGEs they belong to (strange tokens fill up what is short of
    WINDOW) is below SHARE."""
    s, t = np.unique(x), np.unique(y)
    both = len(np.intersect1d(s, t, assume_unique=True))
    union = len(s) + len(t) - both
    return both / union if both >= SHARE * (union + max(0, WINDOW - len(x)) + max(0, WINDOW - len(y))) - 1e-9 else 0.0


def verified(x: np.ndarray, y: Index, x0: int, y0: int) -> list[tuple[int, int, int, int, float]]:
    """(x begin, x end, y begin, y end, similarity) of passages that two regions share, in order of x. A passage's common
    tokens stand in one order on both sides; its similarity is that of the two sets of tokens."""
    i, j = y.matches(x)
    if len(i) < LEAST:
        return []
    out = []
    for first, last in _ranges(i, j):
        a, b, c, d = int(i[first]), int(i[last]) + 1, int(j[first]), int(j[last]) + 1
        if similarity := _similarity(x[a:b], y.tokens[c:d]):
            out.append((a + x0, b + x0, c + y0, d + y0, similarity))
    return sorted(out)


_PAIR_SQL = "doc_id long, start int, twin_id long, twin_at int, start_word int, end_word int, twin_start int, twin_end int, n_hashes int, similarity double"
_PAIR = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int32()), ("twin_id", pa.int64()), ("twin_at", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32()),
        ("twin_start", pa.int32()), ("twin_end", pa.int32()), ("n_hashes", pa.int32()), ("similarity", pa.float64()),
    ]
)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    twin, index = None, None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if (r["twin_id"], r["twin_at"]) != twin:  # rows come in order of their twins
                twin, index = (r["twin_id"], r["twin_at"]), Index(unpack48(r["twin_tokens"]))
            for a, b, c, d, s in verified(unpack48(r["tokens"]), index, r["start"], r["twin_at"]):
                rows.append(
                    {
                        "doc_id": r["doc_id"], "start": r["start"], "twin_id": r["twin_id"], "twin_at": r["twin_at"], "start_word": a, "end_word": b + WORDS - 1,
                        "twin_start": c, "twin_end": d + WORDS - 1, "n_hashes": r["n_hashes"], "similarity": s,
                    }
                )
        yield pa.RecordBatch.from_pylist(rows, schema=_PAIR)


class Holders:
    """Which members of a block hold a token, and which tokens several documents hold."""

    def __init__(self, tokens: list[np.ndarray], docs: np.ndarray):
        flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])
        order = np.argsort(flat, kind="stable")
        self.tokens, self.owner, self.size = flat[order], owner[order], len(tokens)
        doc = docs[self.owner]
        self.common = np.unique(self.tokens[1:][(self.tokens[1:] == self.tokens[:-1]) & (doc[1:] != doc[:-1])])

    def shared(self, x: np.ndarray) -> np.ndarray:
        """Which tokens of x several documents hold."""
        if not len(self.common):
            return np.zeros(len(x), bool)
        return self.common[np.minimum(np.searchsorted(self.common, x), len(self.common) - 1)] == x

    def near(self, x: np.ndarray, at: np.ndarray, who: np.ndarray) -> np.ndarray:
        """For each pair of a place of x and a member, whether x has WINDOW tokens around the place of which the member holds
        enough for a passage (LEAST: 1, MEAN: 2, else 0); STEP places at a time, so memory does not grow with x."""
        out = np.zeros(len(at), np.int8)
        for step in np.unique(at // STEP).tolist():
            mine = np.flatnonzero(at // STEP == step)
            begin = max(0, int(at[mine].min()) - WINDOW + 1)
            some = x[begin : int(at[mine].max()) + WINDOW]
            if len(some) < WINDOW:
                continue
            low, high = np.searchsorted(self.tokens, some), np.searchsorted(self.tokens, some, "right")
            many = high - low
            col = np.repeat(np.arange(len(some)), many)
            row = self.owner[np.arange(len(col)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
            members, slot = np.unique(who[mine], return_inverse=True)
            place = np.full(self.size, -1)
            place[members] = np.arange(len(members))
            use = place[row] >= 0
            held = np.zeros((len(members), len(some) + 1), np.int16)
            held[place[row[use]], col[use] + 1] = 1
            np.cumsum(held, axis=1, out=held)
            count = held[:, WINDOW:] - held[:, :-WINDOW]
            here, most = at[mine] - begin, count.shape[1]
            for least in (LEAST, MEAN):
                dense = np.zeros((len(members), most + 1), np.int16)  # how many dense windows begin before a place
                np.cumsum(count >= least, axis=1, out=dense[:, 1:])
                out[mine] += dense[slot, np.minimum(here + 1, most)] > dense[slot, np.clip(here - WINDOW + 1, 0, most)]
        return out


def near_held(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of a region, whether WINDOW tokens around it have LEAST that are held."""
    total = np.append(0, np.cumsum(held))
    dense = np.append(0, np.cumsum(total[WINDOW:] - total[:-WINDOW] >= LEAST))
    last = len(dense) - 1
    return dense[np.minimum(at + 1, last)] > dense[np.clip(at - WINDOW + 1, 0, last)]


def _in_family(tokens: bytes, g: int) -> np.ndarray:
    """A region's tokens, numbered anew for its family."""
    return mixed(unpack48(tokens) ^ mixed(np.array([g]).view(np.uint64))) >> np.uint64(64 - BITS)


def _family_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for k, g, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield k, np.unique(_in_family(tokens, g))


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of regions with the tokens that others of their family hold: the ids of those where some key stands among enough of them."""
    for batch in batches:
        places, held = batch.column(4), batch.column(5)
        good = []
        for i, (k, g, start, tokens) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            if near_held(np.isin(_in_family(tokens, g), held[i].values.to_numpy().view(np.uint64)), places[i].values.to_numpy() - start).any():
                good.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], names=["alive"])


def _dense(y: np.ndarray, x: Index, at: np.ndarray) -> bool:
    """Whether y has WINDOW tokens around one of the places of which x holds MEAN."""
    some = y[max(0, int(at.min()) - WINDOW + 1) : int(at.max()) + WINDOW]
    total = np.append(0, np.cumsum(x.sorted[np.minimum(np.searchsorted(x.sorted, some), len(x.sorted) - 1)] == some))
    return len(some) >= WINDOW and bool((total[WINDOW:] - total[:-WINDOW] >= MEAN).any())


def _compare(table: pa.Table) -> pa.Table:
    """Passages that connect what is apart among the regions of one family (of one pair of its blocks): each row (a region that
    is apart) is verified with the regions that hold its open keys (all its keys, if it is not in their component), those
    with most keys first, unless they are connected and all its keys lie in verified passages. Side 0 is a row, 1 a region that rows
    meet, 2 is sent once and is both. Regions are taken in order of their ids, so the result does not depend on the order of rows."""
    side, order = table.column("side").to_numpy(), np.lexsort([table.column(c).to_numpy() for c in ("start", "doc_id")])
    left, right = order[side[order] != 1], order[side[order] != 0]
    table = table.take(np.append(left, right))
    side = np.repeat([0, 1], [len(left), len(right)])
    docs, starts = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
    lists = [table.column(c).combine_chunks() for c in ("key", "c", "open")]
    cuts = np.append(0, np.cumsum(lists[0].value_lengths().to_numpy()))
    key, place, open_ = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    open_ = open_.astype(bool).copy()
    owner = np.repeat(np.arange(len(docs)), np.diff(cuts))
    root = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
    columns = np.flatnonzero(side[owner] == 1)
    columns = columns[np.argsort(key[columns], kind="stable")]
    rows = np.flatnonzero(side == 0)
    still = np.flatnonzero((side == 1) & ~table.column("live").to_numpy())  # no rows, but what covers their open keys is news
    row_of = {(docs[k], starts[k]): k for k in [*still.tolist(), *rows.tolist()]}
    known: dict[int, Index] = {}
    found, tried = [], set()
    if len(rows) and len(columns):
        tokens = [unpack48(t) for t in table.column("tokens").to_pylist()]
        holders = Holders(tokens, docs)

    def close(k: int, begin: int, end: int) -> bool:
        """Whether the places cover an open key of region k; it is open no more."""
        at = slice(cuts[k], cuts[k + 1])
        inside = open_[at] & (begin <= place[at]) & (place[at] < end)
        open_[at] &= ~inside
        return bool(inside.any())

    for k in rows.tolist():
        own = np.arange(cuts[k], cuts[k + 1])
        own = own[near_held(holders.shared(tokens[k]), place[own] - starts[k])]  # no member is near the others
        low, high = np.searchsorted(key[columns], key[own]), np.searchsorted(key[columns], key[own], "right")
        many = high - low
        n = np.repeat(own, many)
        m = columns[np.arange(len(n)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
        j = owner[m]
        use = (docs[j] != docs[k]) & (open_[n] | (root[j] != root[k]))
        n, m, j = n[use], m[use], j[use]
        if not len(n):
            continue
        level = holders.near(tokens[k], place[n] - starts[k], j)
        order = np.argsort(j, kind="stable")
        order = order[level[order] > 0]
        if not len(order):
            continue
        twins, count = np.unique(j[order], return_counts=True)
        by_twin = dict(zip(twins.tolist(), np.split(order, np.cumsum(count)[:-1]), strict=True))
        mine: Index | None = None
        for t in twins[np.argsort(-count, kind="stable")].tolist():
            name = (docs[k], starts[k]), (docs[t], starts[t])
            pairs = by_twin[t]
            if (max(name), min(name)) in tried or (root[k] == root[t] and not open_[n[pairs]].any()):
                continue
            if level[pairs].max() < 2:  # then the twin's side has to make up for it
                mine = mine or Index(tokens[k])
                if not _dense(tokens[t], mine, place[m[pairs]] - starts[t]):
                    continue
            tried.add((max(name), min(name)))
            if t not in known:
                known[t] = Index(tokens[t])
            for a, b, c, d, similarity in verified(tokens[k], known[t], int(starts[k]), int(starts[t])):
                news = close(k, a, b) | (name[1] in row_of and close(row_of[name[1]], c, d)) | (root[k] != root[t])
                root[root == root[t]] = root[k]
                if news:
                    found.append((docs[k], starts[k], docs[t], starts[t], a, b + WORDS - 1, c, d + WORDS - 1, 0, similarity))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * len(_PAIR), _PAIR, strict=True)], schema=_PAIR)


def _number(doc: str, start: str) -> Column:
    return F.xxhash64(doc, start)


def family_members(windows: DataFrame, hubs: DataFrame, found: DataFrame) -> DataFrame:
    """(g, doc_id, start, w, size, root), written: the regions of every family with their keys, which of these are open, and what they
    are connected with. A key's family is that of its least document's first region that holds it."""
    family = keep(hubs.where("twin_id = low").groupBy("k", "low").agg(F.min("twin_at").alias("at")).select("k", _number("low", "at").alias("g")))
    sides = found.select("doc_id", "start", "start_word", "end_word").union(found.select("twin_id", "twin_at", "twin_start", "twin_end"))
    covered = keep(sides.distinct().groupBy(F.col("doc_id").alias("d"), F.col("start").alias("s")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("covered")))
    edges = found.select(_number("doc_id", "start").alias("a"), _number("twin_id", "twin_at").alias("b"))
    roots = written_alone(found.sparkSession, lambda: components(edges, "a", "b"))
    inside = F.exists("covered", lambda p: (F.col("c") >= p["start_word"]) & (F.col("c") <= p["end_word"] - WORDS))
    known = windows.join(family, F.col("key") == F.col("k")).join(covered, (F.col("doc_id") == F.col("d")) & (F.col("start") == F.col("s")), "left")
    own = F.struct("key", "c", (~F.coalesce(inside, F.lit(False))).alias("open"))
    members = known.groupBy("g", "doc_id", "start").agg(F.collect_list(own).alias("w"), F.max("size").alias("size"))
    members = members.join(roots, _number("doc_id", "start") == F.col("node"), "left").select("g", "doc_id", "start", "w", "size", F.coalesce("root", _number("doc_id", "start")).alias("root"))
    members = keep(members)
    drop(family, covered, roots)
    return members


def rest_pairs(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows like found's, written, for what the hubs left apart; members are dropped.

    Regions that are apart go to every block of their family, the others to one, so a task gets a pair of blocks whatever the size
    of the family, and what is connected costs one copy. A region that a block would get as both goes there once. A region can
    only be like another one if WINDOW tokens around one of its keys have LEAST that others of the family hold. In families of
    several blocks tokens are counted first, in fragments of the hash order, and regions that do not pass are not apart; so documents
    that have but a phrase in common, however many, are not compared pair by pair.
    """
    sums = members.groupBy("g", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass"))
    largest = keep(sums.groupBy("g").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.sum("mass").alias("mass")))
    apart = (F.col("root") != F.col("most.root")) | F.exists("w", lambda x: x["open"])
    id_ = F.shiftleft(F.xxhash64("g", "doc_id", "start"), 1) + F.col("apart").cast("int")  # its last bit tells what is apart
    judged = members.join(largest.where("n > 1"), "g").withColumn("apart", apart).select(id_.alias("id"), "g", "doc_id", "start", "w", "size", "root", "n", "mass", "apart")
    judged = keep(judged)
    drop(members, largest)
    blocks = lambda n, mass: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(mass) / MASS)).cast("int")
    large = blocks("n", "mass") > 1
    wide = keep(judged.where(large).join(regions.select("doc_id", "start", "tokens"), ["doc_id", "start"]).select("id", "g", "start", "tokens", F.col("w.c").alias("c")))
    counted = shared_grams(wide.select("id", "g", "tokens"), _family_tokens)
    held = shared_lists(counted).where("id & 1 = 1").select("id", F.col("grams").alias("held"))
    alive = keep(wide.join(held, "id").select("id", "g", "start", "tokens", "c", "held").mapInArrow(_alive, "alive long"))
    drop(wide, counted)
    live = F.col("apart") & (~large | F.col("alive").isNotNull())
    flagged = judged.join(alive, F.col("id") == F.col("alive"), "left").withColumn("live", live)
    many = keep(flagged.where("live").groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("row_mass")))
    dealt = flagged.join(many, "g").withColumn("rows", blocks("m", "row_mass")).withColumn("columns", blocks("n", "mass"))
    block = lambda n: F.pmod(_number("doc_id", "start"), n).cast("int")
    whole = dealt.select("g", "doc_id", "start", "w", "root", "live", "rows", "columns", block(F.col("rows")).alias("row"), block(F.col("columns")).alias("column"))
    place = lambda side, i, j: F.struct(side.cast("int").alias("side"), i.alias("i"), j.alias("j"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_row = F.transform(to("columns"), lambda j: place(F.when(j == F.col("column"), 2).otherwise(0), F.col("row"), j))
    as_column = F.transform(F.filter(to("rows"), lambda i: ~F.col("live") | (i != F.col("row"))), lambda i: place(F.lit(1), i, F.col("column")))
    full = whole.join(regions.select("doc_id", "start", "tokens"), ["doc_id", "start"]).withColumn("at", F.explode(F.when(F.col("live"), F.concat(as_row, as_column)).otherwise(as_column)))
    parts = full.select("g", "at.i", "at.j", "at.side", "doc_id", "start", "root", "live", "tokens", F.col("w.key").alias("key"), F.col("w.c").alias("c"), F.col("w.open").alias("open"))
    rest = keep(parts.groupBy("g", "i", "j").applyInArrow(_compare, _PAIR_SQL))
    drop(judged, alive, many)
    return rest


def with_families(rows: DataFrame) -> DataFrame:
    """rows with family_id: one number for all passages that pairs connect. Passages of a document that overlap are one, so who
    copies a family reads its members without walking from pair to pair. If rows are a table that keep wrote, it goes."""
    mine, theirs = ("doc_id", "start_word", "end_word"), ("twin_id", "twin_start", "twin_end")
    ends = rows.select(*mine).union(rows.select(*theirs)).distinct()
    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    apart = F.col("start_word") >= F.coalesce(F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = ends.withColumn("new", F.when(apart, F.col("start_word"))).withColumn("at", F.last("new", ignorenulls=True).over(w))
    places = keep(begun.select(*[F.col(c).alias(f"_{c}") for c in mine], F.xxhash64("doc_id", "at").alias("node")))

    def at(df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
        on = [F.col(c) == F.col(f"_{m}") for c, m in zip(columns, mine, strict=True)]
        return df.join(places.withColumnRenamed("node", name), on).drop(*[f"_{m}" for m in mine])

    placed = keep(at(at(rows, mine, "a"), theirs, "b"))
    drop(places, rows)
    roots = components(placed.select("a", "b").distinct(), "a", "b")
    return placed.join(roots, F.col("a") == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "a").alias("family_id"))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per repeated passage of a document and twin it was compared with: doc_id, start_word, end_word (exclusive),
    twin_id, twin_start, twin_end, n_hashes, similarity, family_id (one number for all passages that pairs connect).

    Passages have at least about PASSAGE words and lie in different documents; of many documents that share one, each is
    paired with the least and the greatest id and, where that leaves something apart, with others of the family until it is
    connected (n_hashes is 0 for these), so rows grow with the documents and not with their pairs. Texts with equal
    word sequences are one class: each of its documents has a row for the whole text (twin: the class's least id, or for that
    one its greatest), and the least id stands for all in further pairs. A passage within one document only is not reported.
    Null, empty and short texts and rows without id take no part; rows that repeat an id are one document; no rows give none.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = keep(own.mapInArrow(_texts, "doc_id long, seq_id long, n_words long").where(F.col("n_words") >= PASSAGE))
    classes = keep(texts.groupBy(F.col("seq_id").alias("id")).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    zero, whole = F.lit(0), F.col("n_words").cast("int")
    copies = texts.join(classes.where("rep <> last"), F.col("seq_id") == F.col("id")).select(
        "doc_id", zero.alias("start_word"), whole.alias("end_word"), F.when(F.col("doc_id") == F.col("rep"), F.col("last")).otherwise(F.col("rep")).alias("twin_id"),
        zero.alias("twin_start"), whole.alias("twin_end"), F.lit(FUNCTIONS).alias("n_hashes"), F.lit(1.0).alias("similarity"),
    )
    counted = shared_grams(own.select("text"), _candidates)
    wanted = keep(classes.join(shared_lists(counted), "id").select("rep", "grams"))
    regions = keep(own.join(wanted, F.col("doc_id") == F.col("rep")).select("doc_id", "text", "grams").mapInArrow(_regions, _REGION_SQL))
    drop(counted, wanted)
    size = (F.length("tokens") * 8 / BITS).cast("long").alias("size")
    windows = regions.select("doc_id", "start", size, F.explode(F.arrays_zip("key", "c")).alias("w")).select("doc_id", "start", "size", "w.*")
    ends = keep(windows.groupBy(F.col("key").alias("of")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high"))
    # Written before anything is grouped by key, so that the windows of a common key can be split among tasks.
    windows = keep(windows.join(ends, F.col("key") == F.col("of")).drop("of"))
    drop(ends)
    hubs = keep(
        windows.where("doc_id = low OR doc_id = high")
        .select(F.col("key").alias("k"), F.col("doc_id").alias("twin_id"), F.col("start").alias("twin_at"), "low").distinct()
    )
    sides = windows.select("doc_id", "start", "key", F.explode(F.array("low", "high")).alias("twin")).where("twin <> doc_id")
    met = sides.join(hubs, (F.col("key") == F.col("k")) & (F.col("twin") == F.col("twin_id")))
    functions = F.expr("bit_count(bit_or(key & 15))").cast("int")
    pairs = keep(met.groupBy("doc_id", "start", "twin_id", "twin_at").agg(functions.alias("n_hashes")))
    # Columns get no other names on the way, so both joins read one exchange of the regions.
    mine, theirs = (regions.select("doc_id", "start", "tokens").alias(side) for side in ("mine", "theirs"))
    met = pairs.alias("p").join(mine, (F.col("p.doc_id") == F.col("mine.doc_id")) & (F.col("p.start") == F.col("mine.start")))
    both = met.join(theirs, (F.col("p.twin_id") == F.col("theirs.doc_id")) & (F.col("p.twin_at") == F.col("theirs.start")))
    both = both.select("p.doc_id", "p.start", "mine.tokens", "p.twin_id", "p.twin_at", F.col("theirs.tokens").alias("twin_tokens"), "p.n_hashes")
    found = keep(both.mapInArrow(_verify, _PAIR_SQL))
    drop(pairs)
    members = family_members(windows, hubs, found)
    drop(windows, hubs)
    rest = rest_pairs(members, regions)
    drop(regions)
    passage = ["doc_id", "start_word", "end_word", "twin_id", "twin_start", "twin_end"]
    rows = found.unionByName(rest).groupBy(*passage).agg(F.max("n_hashes").alias("n_hashes"), F.max("similarity").alias("similarity"))
    every = keep(copies.unionByName(rows))
    drop(texts, classes, found, rest)
    return with_families(every)
