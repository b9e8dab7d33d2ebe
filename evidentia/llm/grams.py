"""Word n-gram hashes of Arrow text columns, computed over whole buffers instead of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
SLICE_BYTES = 1 << 20  # texts are hashed in runs of about this size, so temporaries stay small
BITS = 48  # of an n-gram's hash that are kept: two n-grams of one pair of texts differ in them but for odds of 10**-8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1342543DE82EF95)
_POWER = np.cumprod(np.full(1 << 16, _BASE, dtype=np.uint64), dtype=np.uint64)


def single_thread() -> None:
    """Matrix products on one thread: a task has one core, and threads that wait for others cost more than they give."""
    import contextlib
    import ctypes
    from pathlib import Path

    for lib in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(str(lib)).scipy_openblas_set_num_threads64_(1)


def release() -> None:
    """Give freed memory back to the system. Workers outlive a stage, and what they keep counts against the next one."""
    import contextlib
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text, a row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-cased word, its byte position), and words of one text lie between two searchsorted bounds."""
    return words_at(data, offsets)[:2]


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the words' bytes."""
    low = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(first[at])
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    np.minimum(place, len(_POWER) - 1, out=place)
    return mixed(np.add.reduceat(_BYTE[low[at]] * _POWER[place], starts)), at[starts], lengths


def gram_hashes(hashes: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hash of every n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * _STEP + hashes[k : k + len(total)]
    return mixed(total)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (BITS wide, as uint64) of its n-word shingles; a text of fewer words
    has its whole sequence as one shingle, an empty text none."""
    data, offsets = text_buffer(texts)
    cut = np.uint64(64 - BITS)
    for a, b in slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        hashes, at = words(data[offsets[a] : offsets[b]], own)
        bounds = np.searchsorted(at, own)
        grams = gram_hashes(hashes, n) >> cut
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i >= n:
                s = np.sort(grams[i : j - n + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif j > i:
                yield gram_hashes(hashes[i:j], j - i) >> cut
            else:
                yield np.zeros(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """64 bits that stand for a set of n-grams (signed)."""
    with np.errstate(over="ignore"):
        x = np.uint64(len(grams)) * _BASE + mixed(grams + _STEP).sum(dtype=np.uint64)
    return int(mixed(np.array([x], np.uint64)).view(np.int64)[0])


def pack48(grams: np.ndarray) -> bytes:
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // BITS, 8), np.uint8)
    out[:, : BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
    return out.view("<u8").ravel()
