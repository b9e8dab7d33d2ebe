"""Subword ids of whole texts, fast: a worker remembers the ids of a million words it has met, and looks all words of a
megabyte of text up at once.

The vocabulary file drops white space, so the ids of a text are those of its words one after the other. A word of plain
letters with trailing ASCII symbols goes straight to the tokenizer's merge model; any other word goes through the whole
tokenizer. Both give the ids of encoding the text at once, which a test compares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .grams import slices, text_buffer, words_at

SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS  # of the table, of which half are filled at most: 30 MB, and some 20 MB of ids
MOST_WORDS = SLOTS // 2  # that a worker remembers; then it begins anew
MOST_BYTES = 256  # of a word that is remembered; a hash takes one such word for another with odds of 10**-13
MOST_RUNS = 50_000  # runs of letters or symbols, which words with and without a comma share
#: Letters whose lower case and canonical form need no context, then ASCII symbols but the apostrophe.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where Latin-1 prints it, else the next
    free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b) if shown else chr(free))
        free += not shown
    return out


class WordIds:
    """The ids of words, by a table of 64-bit hashes of lower-cased words (the vocabulary lower-cases too) and one array of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.model, self.letters = self.tokenizer.model, dict(enumerate(byte_letters()))
        self.runs: dict[str, list[int]] = {}
        self.keys, self.starts, self.counts = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint16)
        self._forget()

    def _forget(self) -> None:
        self.keys[:] = 0
        self.pool, self.end, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def _run(self, run: str) -> list[int]:
        if (ids := self.runs.get(run)) is None:
            shown = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
            ids = [t.id for t in self.model.tokenize(shown)]
            if len(run) <= MOST_BYTES:
                if len(self.runs) >= MOST_RUNS:
                    self.runs.clear()
                self.runs[run] = ids
        return ids

    def ids(self, word: bytes) -> list[int]:
        s = word.decode("utf-8", "replace")
        if m := _PLAIN.fullmatch(s):
            letters, symbols = m.groups()
            ids = self._run(letters.lower()) if letters else []
            return ids + self._run(symbols) if symbols else ids
        return self.tokenizer.encode(s, add_special_tokens=False).ids

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of every hash, or -1."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = np.full(len(hashes), -1)
        open_ = np.arange(len(hashes))
        while len(open_):
            at = slot[open_]
            key = self.keys[at]
            hit = key == hashes[open_]
            found[open_[hit]] = at[hit]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
        return found

    def _put(self, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """New entries, hashes distinct."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.starts[slot[first]], self.counts[slot[first]] = hashes[first], starts[first], counts[first]
            open_ = open_[self.keys[slot[open_]] != hashes[open_]]
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
        self.held += len(hashes)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(begin, number) of each word's ids, put at the end of the pool."""
        ids = [self.ids(w) for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        need = self.end + int(counts.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.end], np.zeros(max(need, self.end) - self.end + (1 << 16), np.uint32)])
        self.pool[self.end : need] = np.fromiter(chain.from_iterable(ids), np.uint32, need - self.end)
        starts = self.end + np.cumsum(counts) - counts
        self.end = need
        return starts, counts

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words of all texts, number of ids of each word, number of words of each text) of the texts that lie between
        offsets in data. Call it with runs of about a megabyte."""
        hashes, at, lengths = words_at(data, offsets)
        hashes[hashes == 0] = 1
        if self.held > MOST_WORDS:
            self._forget()
        slot = self._find(hashes)
        begin, number = self.starts[slot].astype(np.int64), self.counts[slot].astype(np.int64)
        new, kept_end = np.flatnonzero(slot < 0), self.end
        if len(new):
            short = lengths[new] <= MOST_BYTES
            for some, remember in ((new[short], True), (new[~short], False)):  # long words last, so that their ids can go again
                if len(some):
                    raw = data.tobytes() if len(some) > 1000 else data
                    values, first, inverse = np.unique(hashes[some], return_index=True, return_inverse=True) if remember else (None, np.arange(len(some)), np.arange(len(some)))
                    starts, counts = self._learn([bytes(raw[i : i + n]) for i, n in zip(at[some[first]].tolist(), lengths[some[first]].tolist(), strict=True)])
                    begin[some], number[some] = starts[inverse], counts[inverse]
                    if remember:
                        self._put(values, starts.astype(np.int32), counts.astype(np.uint16))
                        kept_end = self.end
        ends = np.cumsum(number)
        flat = self.pool[np.repeat(begin - (ends - number), number) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.end = kept_end
        return flat, number, np.diff(np.searchsorted(at, offsets))

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


def text_ids(path: str, texts: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text of an Arrow column in turn; nulls have none."""
    memory = word_ids(path)
    data, offsets = text_buffer(texts)
    for a, b in slices(offsets):
        flat, per_word, per_text = memory.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ends = np.append(0, np.cumsum(per_word))[np.cumsum(per_text)].tolist()
        for i, j in zip([0, *ends], ends, strict=False):
            yield flat[i:j]


_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's memory for a vocabulary file; it outlives a task."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]
