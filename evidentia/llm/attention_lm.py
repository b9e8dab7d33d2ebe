"""Language-model scores from causal self-attention over subword ids and word counts of the whole corpus.

A text is a stream of symbols: its subword ids, each with a mark whether it ends a word, and an end. The network, trained
in numpy, has one attention layer with learnt weights for distance. A text is scored in blocks: the queries of a block
see its own symbols and the block before (overlapping windows under a causal mask that also ends at a text's begin), so
each symbol is scored once with 16 to 31 symbols of context. The output is a class of symbols, and a symbol within its class
has its share of the learnt ones. Words end where their last symbol says so, so the words after a context share one
probability; a word's is mixed (MIX) from what the network gives its symbols and its share of all training words.

What is learnt grows with the input and is learnt where the texts are: every training text goes whole, in windows of
words, as symbols to a written table; tasks over it count symbols, then take gradient steps from common
weights, whose changes are averaged (ROUNDS times). Counts of words cover all training texts: words above a share of
1 / MOST_COMMON are at most that many and go to every task, all other occurrences meet their counts in fragments of the
hash order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import single_thread, slices, text_buffer, words
from .store import crc_mod, keep, partitions
from .tokens import word_ids

single_thread()

FOLDS = 10
SPAN = 64  # words of a window
PIECE = 1 << 17  # bytes of text whose windows are a row
ROUNDS = 2  # of training, each over its own part of the learnt windows
BLOCK, HEAD, WIDE = 16, 8, 16
INPUTS, SINGLE, GROUPS = 4096, 96, 32  # symbols with own embeddings, symbols that are a class of their own, further classes
CLASSES = SINGLE + GROUPS
BATCH = 128  # blocks of a gradient step
MIX = 0.5  # weight of the network against the counts
MOST_COMMON = 1 << 20
FLUSH = 1 << 21  # words counted together by a task
FAN_IN, SLICES = 64, 32  # of sums over tasks
START, END = 0, 1  # the symbols before and after a text; a subword id x is 2 + 2 x, and one more where it ends a word


def symbols_of(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all words of all texts, number of them for each word, number of words for each text). A word of which the
    vocabulary keeps nothing is one symbol beyond it."""
    memory = word_ids(path)
    ids, per_word, per_text = memory.of_texts(texts)
    if not per_word.all():
        empty = np.flatnonzero(per_word == 0)
        ids = np.insert(ids, np.append(0, np.cumsum(per_word))[empty], memory.size)
        per_word = np.maximum(per_word, 1)
    flat = ids.astype(np.int64) * 2 + 2
    flat[np.cumsum(per_word) - 1] += 1
    return flat, per_word, per_text


class AttentionLM:
    """One table by input symbol (query, key, value, rest), the distance weights, and the layers after attention."""

    DENSE = ("d", "o", "h", "u", "c")

    def __init__(self, counts: np.ndarray, seed: int = 11):
        """counts: of every symbol in what is learnt."""
        rng = np.random.default_rng(seed)
        self.counts = counts
        self.order = np.argsort(-counts, kind="stable")
        self.place = np.full(len(counts), INPUTS - 1, np.int32)
        self.place[self.order[: INPUTS - 1]] = np.arange(min(INPUTS - 1, len(counts)))
        self.group = np.full(len(counts), CLASSES - 1, np.int16)
        self.group[self.order[:SINGLE]] = np.arange(min(SINGLE, len(counts)))
        init = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[-1])).astype(np.float32)
        self.table = np.concatenate([init(INPUTS, HEAD), init(INPUTS, HEAD), init(INPUTS, HEAD), init(INPUTS, WIDE)], axis=1)
        self.p = {"d": np.zeros(2 * BLOCK, np.float32), "o": init(HEAD, WIDE), "h": np.zeros(WIDE, np.float32), "u": init(WIDE, CLASSES)}
        self._share()
        i, j = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None]
        self.back = np.clip(i - j, 0, 2 * BLOCK - 1)
        self.future = np.where(j > i, np.float32(-1e9), np.float32(0))

    def _share(self) -> None:
        smooth = self.counts + 0.05
        share = np.bincount(self.group, smooth, CLASSES)
        self.within = np.log(smooth / share[self.group]).astype(np.float32)
        self.p["c"] = np.log(np.maximum(share, 1e-12) / share.sum()).astype(np.float32)

    def middle(self) -> np.ndarray:
        """Symbols that have an embedding but are no class of their own."""
        return self.order[SINGLE : min(INPUTS - 1, int((self.counts > 2).sum()))]

    def cluster(self, before: np.ndarray, seed: int = 13) -> None:
        """Classes of the middle symbols by what precedes them (k-means); before: counts [symbol, preceding single or other]."""
        rest = self.middle()
        if len(rest) > GROUPS:
            rng = np.random.default_rng(seed)
            table = np.sqrt((before + 0.01) / (before + 0.01).sum(1, keepdims=True))
            centres = table[rng.choice(len(rest), GROUPS - 1, replace=False)]
            for _ in range(12):
                near = np.argmax(table @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
                for g in range(GROUPS - 1):
                    if (near == g).any():
                        centres[g] = table[near == g].mean(0)
            self.group[rest] = SINGLE + near
            self._share()

    def streams(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(input rows, targets, begin of each place's piece, which places are real). Every piece begins with a block, so its score
        does not depend on the pieces around it; what is left of its last block is filled."""
        room = -(-sizes // BLOCK) * BLOCK
        starts, ends = np.cumsum(room) - room, np.cumsum(sizes)
        at = np.arange(len(symbols)) + np.repeat(starts - (ends - sizes), sizes)
        y, real = np.full(int(room.sum()), END, np.int64), np.zeros(int(room.sum()), bool)
        y[at], real[at] = symbols, True
        x = np.append(START, y[:-1])[: len(y)]
        x[starts[room > 0]] = START
        return self.place[x], y, np.repeat(starts, room), real

    def _pieces(self, x: np.ndarray, begin: np.ndarray, a: int, b: int, weights: bool = True) -> dict:
        """Forward pass of the blocks a..b of a stream; the block before them gives keys and values only. Without weights, "e" holds
        attention before it is divided by its sums."""
        p, n = self.p, b - a
        lead = a > 0
        at = x[(a - lead) * BLOCK : b * BLOCK]
        rows = self.table[at]
        k, v = rows[:, HEAD : 2 * HEAD].reshape(-1, BLOCK, HEAD), rows[:, 2 * HEAD : 3 * HEAD].reshape(-1, BLOCK, HEAD)
        if not lead:
            k, v = (np.concatenate([np.zeros((1, BLOCK, HEAD), np.float32), t]) for t in (k, v))
        k, v = np.concatenate([k[:-1], k[1:]], axis=1), np.concatenate([v[:-1], v[1:]], axis=1)
        own = rows[BLOCK:] if lead else rows
        q = own[:, :HEAD].reshape(n, BLOCK, HEAD)
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += p["d"][self.back] + self.future
        first = begin[a * BLOCK : b * BLOCK : BLOCK] - np.arange(a, b) * BLOCK + BLOCK  # place of the piece's begin among the keys
        s[first > 0, :, :BLOCK] = -1e9  # a piece begins with a block, so it has none or all of the block before
        if np.abs(q).max() * np.abs(k).max() * HEAD + np.abs(p["d"]).max() > 40:
            np.minimum(s, 40, out=s)
        np.exp(s, out=s)
        total = (s.reshape(-1, 2 * BLOCK) @ np.ones((2 * BLOCK, 1), s.dtype)).reshape(n, BLOCK, 1)
        if weights:
            s /= total
        o = np.matmul(s, v)
        o = (o if weights else o / total).reshape(-1, HEAD)
        wide = np.empty((n * BLOCK, WIDE + 1), s.dtype)  # with a one, so that the product adds the classes' own weights
        wide[:, WIDE] = 1
        h = wide[:, :WIDE]
        np.maximum(own[:, 3 * HEAD :] + (o @ p["o"] + p["h"]), 0, out=h)
        last = np.concatenate([p["u"], p["c"][None]])
        z = wide @ last
        if max(1, h.max()) * np.abs(last).sum(0).max() > 60:  # seldom: a pass over z that is not needed otherwise
            np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        return {"at": at, "lead": lead, "q": q, "k": k, "v": v, "e": s, "o": o, "h": h, "z": z, "n": n}

    def log_probs(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of every symbol of the texts; sizes are theirs in turn."""
        x, y, begin, real = self.streams(symbols, sizes)
        out, blocks = np.empty(len(y), np.float32), len(y) // BLOCK
        for a in range(0, blocks, 256):
            b = min(blocks, a + 256)
            z, t = self._pieces(x, begin, a, b, weights=False)["z"], y[a * BLOCK : b * BLOCK]
            own = z.ravel()[np.arange(0, z.size, CLASSES) + self.group[t]]
            out[a * BLOCK : b * BLOCK] = np.log(np.maximum(own / (z @ np.ones(CLASSES, z.dtype)), 1e-30)) + self.within[t]
        return out[real]

    def gradient(self, f: dict, target: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """(rows of the table, their gradients, gradients of the rest) of the mean loss of the real places."""
        p, n = self.p, f["n"]
        z, weight = f["z"], real / np.float32(max(1, real.sum()))
        dz = z * (weight / (z @ np.ones(CLASSES, z.dtype)))[:, None]  # one pass over the largest array
        dz[np.arange(len(target)), target] -= weight
        dh = (dz @ p["u"].T) * (f["h"] > 0)
        do = (dh @ p["o"].T).reshape(n, BLOCK, HEAD)
        de = np.matmul(do, f["v"].transpose(0, 2, 1))
        ds = f["e"] * (de - ((de * f["e"]).reshape(-1, 2 * BLOCK) @ np.ones((2 * BLOCK, 1), de.dtype)).reshape(n, BLOCK, 1))
        dq, dk, dv = np.matmul(ds, f["k"]), np.matmul(ds.transpose(0, 2, 1), f["q"]), np.matmul(f["e"].transpose(0, 2, 1), do)
        every = np.zeros((n + 1, BLOCK, 3 * HEAD + WIDE), np.float32)
        every[1:, :, :HEAD] = dq
        every[1:, :, 3 * HEAD :] = dh.reshape(n, BLOCK, WIDE)
        for at, d in ((HEAD, dk), (2 * HEAD, dv)):
            every[:-1, :, at : at + HEAD] += d[:, :BLOCK]
            every[1:, :, at : at + HEAD] += d[:, BLOCK:]
        every = (every if f["lead"] else every[1:]).reshape(-1, 3 * HEAD + WIDE)
        order = np.argsort(f["at"], kind="stable")
        rows = f["at"][order]
        heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        dense = {"o": f["o"].T @ dh, "h": dh.sum(0), "u": f["h"].T @ dz, "c": np.ones(len(dz), dz.dtype) @ dz, "d": np.bincount(self.back.ravel(), ds.sum(0).ravel(), 2 * BLOCK).astype(np.float32)}
        return rows[heads], np.add.reduceat(every[order], heads, axis=0), dense

    def learn(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], seed: int = 12) -> np.ndarray:
        """Gradient steps over pieces of symbols, then what changed: the table's rows and the rest, each times the places that it
        was learnt from, and these numbers."""
        rng = np.random.default_rng(seed)
        table, dense = self.table.copy(), {k: v.copy() for k, v in self.p.items()}
        seen, rest = np.full_like(table, 1e-6), {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        used, total = np.zeros(INPUTS, np.float32), 0
        for symbols, sizes in batches:
            x, y, begin, real = self.streams(symbols, sizes)
            target = self.group[y]
            for a in rng.permutation(np.arange(0, len(y) // BLOCK, BATCH)).tolist():
                b = min(len(y) // BLOCK, a + BATCH)
                own = real[a * BLOCK : b * BLOCK]
                rows, g, more = self.gradient(self._pieces(x, begin, a, b), target[a * BLOCK : b * BLOCK], own)
                seen[rows] += g * g
                self.table[rows] -= 0.1 * g / np.sqrt(seen[rows])
                for name, v in more.items():
                    rest[name] += v * v
                    self.p[name] = self.p[name] - 0.05 * v / np.sqrt(rest[name])
                used += np.bincount(x[a * BLOCK : b * BLOCK][own], minlength=INPUTS)
                total += int(own.sum())
        change = [(self.table - table) * used[:, None], used, *[(self.p[k] - dense[k]) * total for k in self.DENSE], np.array([total])]
        self.table, self.p = table, dense  # the caller decides what to take
        return np.concatenate([c.ravel() for c in change])

    def move(self, change: np.ndarray) -> None:
        """Take the mean of the changes whose sum this is."""
        at = self.table.size
        used, total = change[at : at + INPUTS], max(float(change[-1]), 1.0)
        self.table = (self.table + change[:at].reshape(self.table.shape) / np.maximum(used, 1)[:, None]).astype(np.float32)
        at += INPUTS
        for k in self.DENSE:
            v = self.p[k]
            self.p[k] = (v + change[at : at + v.size].reshape(v.shape) / total).astype(np.float32)
            at += v.size


def _frag(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of every run of equal values; nothing for nothing."""
    values, first = np.unique(sorted_, return_index=True)
    yield from zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_)][: len(first)], strict=True)


_COUNT = pa.schema([("frag", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("words", pa.int64()), ("texts", pa.int64())])
_COUNT_SQL = "frag int, hashes binary, counts binary, words long, texts long"
_READ = pa.schema([*_COUNT, pa.field("part", pa.int32()), pa.field("symbols", pa.binary()), pa.field("sizes", pa.binary())])
_READ_SQL = _COUNT_SQL + ", part int, symbols binary, sizes binary"


def learnt_windows(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, number of them for each window) of the windows that are learnt: all words of a text in windows of SPAN. The last
    window of a text ends with END; what is before the others is not known to them."""
    wanted, ends = [], []
    for t in texts:
        own = t.split()
        many = max(1, -(-len(own) // SPAN))
        for k in range(many):
            wanted.append(b" ".join(own[k * SPAN : (k + 1) * SPAN]))
            ends.append(k == many - 1)
    flat, per_word, per_text = symbols_of(wanted, path)
    sizes = np.add.reduceat(np.append(per_word, 0), np.minimum(np.cumsum(per_text) - per_text, len(per_word))) * (per_text > 0)
    last = np.array(ends, bool)
    return np.insert(flat, np.cumsum(sizes)[last], END), sizes + last


def _read(batches: Iterator[pa.RecordBatch], fragments: int, path: str) -> Iterator[pa.RecordBatch]:
    """Rows with frag: counts of words. Rows without: learnt windows, each run of texts in one of ROUNDS parts in turn."""
    held: list[np.ndarray] = []
    part = TaskContext.get().partitionId()
    waiting = texts = 0

    def out(texts: int) -> pa.RecordBatch:
        flat = np.concatenate([*held, np.zeros(0, np.uint64)])
        values, counts = np.unique(flat, return_counts=True)
        rows = [
            {"frag": k, "hashes": values[i:j].tobytes(), "counts": counts[i:j].tobytes(), "words": int(counts[i:j].sum()), "texts": 0}
            for k, i, j in _runs(_frag(values, fragments))
        ]
        rows.append({"frag": 0, "hashes": b"", "counts": b"", "words": 0, "texts": texts})
        return pa.RecordBatch.from_pylist(rows, schema=_READ)

    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        for a, b in slices(offsets):
            raw, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            held.append(words(raw, own)[0])
            for c, d in slices(own, PIECE):  # small rows, so what a task holds does not grow with the words learnt
                symbols, sizes = learnt_windows([raw[i:j].tobytes() for i, j in zip(own[c:d].tolist(), own[c + 1 : d + 1].tolist(), strict=True)], path)
                part = (part + 1) % ROUNDS
                yield pa.RecordBatch.from_pylist([{"part": part, "symbols": symbols.astype("<i4").tobytes(), "sizes": sizes.astype("<i4").tobytes()}], schema=_READ)
            waiting += len(held[-1])
            texts += b - a
            if waiting >= FLUSH:
                yield out(texts)
                held, waiting, texts = [], 0, 0
    if texts:
        yield out(texts)


def _add_up(table: pa.Table) -> pa.Table:
    col = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    values, inverse = np.unique(col("hashes", np.uint64), return_inverse=True)
    counts = np.bincount(inverse, col("counts", np.int64), len(values)).astype(np.int64)
    total = lambda c: sum(table.column(c).to_pylist())
    row = {"frag": table.column("frag")[0].as_py(), "hashes": values.tobytes(), "counts": counts.tobytes(), "words": total("words"), "texts": total("texts")}
    return pa.Table.from_pylist([row], schema=_COUNT)


def over_tasks(windows: DataFrame, task: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], np.ndarray], size: int) -> np.ndarray:
    """The sum of what task makes of (symbols, sizes) on every partition of the learnt windows, a vector of `size`. Vectors are
    cut into slices and added up FAN_IN tasks at a time first, so no task holds more than a slice of each group."""
    width = -(-size // SLICES)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for s, n in zip(batch.column(0), batch.column(1), strict=True):
                    yield tuple(np.frombuffer(v.as_buffer(), "<i4").astype(np.int64) for v in (s, n))

        made = task(pieces()).astype(np.float32)
        at, parts = TaskContext.get().partitionId() // FAN_IN, [made[k * width : (k + 1) * width].tobytes() for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([at] * SLICES, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "at", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) for v in table.column("data"))
        return table.slice(0, 1).set_column(2, "data", pa.array([total.astype(np.float32).tobytes()], pa.binary()))

    schema = "slice int, at int, data binary"
    sums = windows.select("symbols", "sizes").mapInArrow(own, schema).groupBy("slice", "at").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    out = {r["slice"]: np.frombuffer(r["data"], np.float32) for r in sums.toArrow().to_pylist()}
    return np.concatenate([out[k] for k in range(SLICES)]).astype(np.float64) if out else np.zeros(size)


def fitted(windows: DataFrame, size: int) -> AttentionLM:
    """The network after all rounds; without windows as it is initialised."""

    def count(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sum((np.bincount(s, minlength=size) for s, _ in pieces), np.zeros(size))

    net = AttentionLM(over_tasks(windows, count, size))
    middle, single = net.middle(), net.order[:SINGLE]

    def before(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        row, col = np.full(size, -1), np.full(size, SINGLE)
        row[middle], col[single] = np.arange(len(middle)), np.arange(len(single))
        out = np.zeros(len(middle) * (SINGLE + 1))
        for s, _ in pieces:
            use = row[s[1:]] >= 0
            out += np.bincount(row[s[1:]][use] * (SINGLE + 1) + col[s[:-1]][use], minlength=len(out))
        return out

    if len(middle) > GROUPS:
        net.cluster(over_tasks(windows, before, len(middle) * (SINGLE + 1)).reshape(len(middle), -1))
    length = net.table.size + INPUTS + sum(net.p[k].size for k in net.DENSE) + 1
    for k in range(ROUNDS):
        net.move(over_tasks(windows.where(F.col("part") == k), net.learn, length))
    return net


def _common(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[c >= least]), pa.array(c[c >= least])], names=["hash", "n"])


_PACKED = ("rows", "sizes", "hashes", "logs", "all_rows", "docs", "lost", "n_tokens", "known", "base", "score")
_SENT = pa.schema([("frag", pa.int32()), ("run", pa.int64()), *[(c, pa.binary()) for c in _PACKED]])
_SENT_SQL = "frag int, run long, " + ", ".join(f"{c} binary" for c in _PACKED)
_MET_PACKED = ("rows", "more_known", "more_base", "more_score", "all_rows", "docs", "lost", "n_tokens", "known", "base", "score")
_MET = pa.schema([("run", pa.int64()), *[(c, pa.binary()) for c in _MET_PACKED]])
_MET_SQL = "run long, " + ", ".join(f"{c} binary" for c in _MET_PACKED)
_DONE_SQL = "doc_id long, n_tokens long, known long, base double, score double"


class Scorer:
    """What every scoring task holds: the network, totals, and the common words with their counts."""

    def __init__(self, net: AttentionLM, path: str, n: int, distinct: int, texts: int, hashes: np.ndarray, counts: np.ndarray, fragments: int):
        order = np.argsort(hashes)
        self.net, self.path, self.n, self.distinct, self.texts, self.fragments = net, path, n, distinct, texts, fragments
        self.hashes, self.counts = hashes[order], counts[order]

    def terms(self, counts: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(base, score) of tokens with these training counts and network log10 probabilities."""
        base = np.log10((counts + 0.1) / (self.n + 0.1 * (self.distinct + 1)))
        return base, np.log10(np.maximum(MIX * 10.0 ** np.maximum(logs, -300) + (1 - MIX) * counts / max(self.n, 1), 1e-300))

    def log10(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the network's log10 probability of every word and each text's end in turn, which of them are words)."""
        flat, per_word, per_text = symbols_of(texts, self.path)
        ends = np.cumsum(per_text)
        sizes = np.insert(per_word, ends, 1)  # symbols of each word and end
        is_word = np.insert(np.ones(len(per_word), bool), ends, False)
        total = np.append(0, np.cumsum(sizes))
        of_text = np.diff(np.append(0, total[np.flatnonzero(~is_word) + 1]))
        log = self.net.log_probs(np.insert(flat, np.append(0, np.cumsum(per_word))[ends], END), of_text)
        run = np.append(0.0, np.cumsum(log.astype(np.float64) / np.log(10)))
        return run[total[1:]] - run[total[:-1]], is_word

    def send(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts scored as far as common words and ends go; other occurrences leave for their word's fragment."""
        row0, turn = TaskContext.get().partitionId() << 34, TaskContext.get().partitionId()
        for batch in batches:
            docs, lost = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets):
                raw, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, at = words(raw, own)
                per_text = np.diff(np.searchsorted(at, own))
                log, per_word = self.log10([raw[i:j].tobytes() for i, j in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)])
                logs, ends = log[per_word], log[~per_word]
                text_of = np.repeat(np.arange(b - a), per_text)
                slot = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
                common = self.hashes[slot] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
                base_end, score_end = self.terms(np.full(b - a, self.texts), ends)
                base, score = self.terms(self.counts[slot[common]], logs[common]) if common.any() else (np.zeros(0), np.zeros(0))
                add = lambda v: np.bincount(text_of[common], v, b - a)
                rows = row0 + np.arange(b - a)
                row0 += b - a
                done = {
                    "all_rows": rows, "docs": docs[a:b], "lost": lost[a:b], "n_tokens": per_text + 1, "known": (add(None) + (self.texts > 0)).astype(np.int64),
                    "base": add(base) + base_end, "score": add(score) + score_end,
                }
                rest = np.flatnonzero(~common)
                frag = _frag(hashes[rest], self.fragments)
                order = np.argsort(frag, kind="stable")
                rest, frag = rest[order], frag[order]
                turn = (turn + 1) % self.fragments  # the fragment that carries the sums of this run
                ranges = {k: (i, j) for k, i, j in _runs(frag)}  # only fragments that have words of this run
                out = []
                for k in {turn, *ranges}:
                    i, j = ranges.get(k, (0, 0))
                    own_text = text_of[rest[i:j]]
                    heads = np.flatnonzero(np.append(True, own_text[1:] != own_text[:-1])) if j > i else np.zeros(0, np.int64)
                    row = {
                        "frag": k, "run": int(rows[0]), "rows": rows[own_text[heads]].tobytes(), "sizes": np.diff(np.append(heads, j - i)).astype("<i4").tobytes(),
                        "hashes": hashes[rest[i:j]].tobytes(), "logs": logs[rest[i:j]].astype("<f4").tobytes(),
                    }
                    out.append(row | {c: (v.tobytes() if k == turn else b"") for c, v in done.items()})
                yield pa.RecordBatch.from_pylist(out, schema=_SENT)

    def meet(self, sent: pa.Table, counted: pa.Table) -> pa.Table:
        """What one fragment adds to the texts of each run: a packed row for a run's packed row, so rows grow with the runs and
        not with texts times fragments."""
        known, counts = (np.frombuffer(b"".join(counted.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("counts", np.int64)))
        out = []
        for r in sent.to_pylist():
            hashes, logs = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["logs"], "<f4").astype(np.float64)
            slot = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            found = np.where(known[slot] == hashes, counts[slot], 0) if len(known) else np.zeros(len(hashes), np.int64)
            base, score = self.terms(found, logs)
            sizes = np.frombuffer(r["sizes"], "<i4")
            owner = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda v, owner=owner, n=len(sizes): np.bincount(owner, v, n).astype(np.float64).tobytes()
            out.append({"run": r["run"], "rows": r["rows"], "more_known": add(found > 0), "more_base": add(base), "more_score": add(score)} | {c: r[c] for c in _MET_PACKED[4:]})
        return pa.Table.from_pylist(out, schema=_MET)


def _total(table: pa.Table) -> pa.Table:
    """The texts of one run (at most what a task scores at a time) with all that fragments add."""
    col = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    rows = col("all_rows", np.int64)  # in order: a run numbers its texts one after the other
    at = np.searchsorted(rows, col("rows", np.int64))
    add = lambda own, more, kind: col(own, kind) + np.bincount(at, col(more, np.float64), len(rows))
    return pa.table(
        {
            "doc_id": pa.array(col("docs", np.int64), mask=col("lost", bool)), "n_tokens": pa.array(col("n_tokens", np.int64)),
            "known": pa.array(np.rint(add("known", "more_known", np.int64)).astype(np.int64)),
            "base": pa.array(add("base", "more_base", np.float64)), "score": pa.array(add("score", "more_score", np.float64)),
        }
    )


def lm_scores(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the ASCII-lower-cased words and one end. Counts cover all training texts (crc32 of the id not divisible by
    FOLDS), the network learns from windows of each of them, and all whole texts are scored. Null and empty texts are one
    end. Without training texts every count is 0 and the network stays as initialised. Repeated rows are scored (and counted)
    each; null ids are held out, as empty text is; other columns are ignored; no rows give no rows.
    """
    fragments = partitions(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    training = own.where(crc_mod(F.col("doc_id"), FOLDS) != 0)
    read = keep(training.select("text").mapInArrow(lambda b: _read(b, fragments, tokenizer_path), _READ_SQL))
    counted = read.where("frag IS NOT NULL").select("frag", "hashes", "counts", "words", "texts")
    counts = keep(counted.groupBy("frag").applyInArrow(_add_up, _COUNT_SQL))
    n, texts, distinct = counts.agg(F.sum("words"), F.sum("texts"), F.sum(F.length("hashes")) / 8).first()
    texts = texts or 0
    n, distinct = (n or 0) + texts, int(distinct or 0) + (texts > 0)
    least = n / MOST_COMMON
    common = counts.select("hashes", "counts").mapInArrow(lambda b: _common(b, least), "hash long, n long").toArrow()
    net = fitted(read.where("frag IS NULL").select("part", "symbols", "sizes"), 2 * word_ids(tokenizer_path).size + 4)
    scorer = Scorer(net, tokenizer_path, n, distinct, texts, common.column("hash").to_numpy().view(np.uint64), common.column("n").to_numpy(), fragments)
    sent = own.select("doc_id", "text").mapInArrow(scorer.send, _SENT_SQL)
    met = sent.groupBy("frag").cogroup(counts.groupBy("frag")).applyInArrow(lambda a, b: scorer.meet(a, b), _MET_SQL)
    sums = met.groupBy("run").applyInArrow(_total, _DONE_SQL)
    return sums.select(
        "doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
