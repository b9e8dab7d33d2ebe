"""Best-fit packing in rounds: every partition packs its own pieces best-fit, nearly full sequences are final, and
underfull ones travel up a tree of merges as items of further best-fit rounds.

Only underfull sequences that can still be of use move. After best fit a node has at most one sequence that is half full
or less, for two would be one. So a later merge meets at most FAN_IN such sequences, only they can go into others, and
they go into FAN_IN others at most; over all levels that are left FAN_IN sequences for each. A sequence with more room
takes whatever one with less room takes, so a node that hands on those with most room loses nothing, and no task holds more
than FAN_IN nodes' share of that, whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import release
from .store import keep
from .tokens import text_ids

LENGTH = 4096  # tokens of a sequence
END_ID = 1
NEARLY = 0.985  # a sequence this full is final
FAN_IN = 16  # nodes merged into one of the next round
MOST_LEVELS = 8  # of merges: FAN_IN ** 8 partitions are more than there can be

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BIN = pa.schema([("final", pa.bool_()), ("node", pa.int64()), ("bin", pa.int64()), ("fill", pa.int64()), ("pieces", pa.list_(_PIECE))])
_BIN_SQL = "final boolean, node long, bin long, fill long, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items in each bin: items by decreasing size, each into the open bin that leaves least room, or a
    new one. A bit per room value marks where bins are open, so a step costs no search over bins."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if open_ := mask >> size:
            room = size + (open_ & -open_).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def handed_on(levels: int) -> int:
    """Underfull sequences more than half full that later merges may have use for."""
    return FAN_IN * levels


def _packed(items: list[tuple[int, list]], node: int, level: int, capacity: int, levels: int) -> Iterator[pa.RecordBatch]:
    """items: (fill, pieces). Bins of one round as rows; levels: merges that follow."""
    bins = [(sum(items[i][0] for i in b), [p for i in b for p in items[i][1]]) for b in best_fit([x[0] for x in items], capacity)]
    bins.sort(key=lambda b: -b[0])
    half = sum(2 * b[0] <= capacity for b in bins)
    final = max(sum(b[0] >= NEARLY * capacity for b in bins), len(bins) - half - handed_on(levels)) if levels else len(bins)
    number = lambda k: ((level << 24 | node) << 32) | k
    rows = [{"final": k < final, "node": node, "bin": number(k), "fill": fill, "pieces": pieces} for k, (fill, pieces) in enumerate(bins)]
    for at in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_pylist(rows[at : at + 2000], schema=_BIN)


def _pieces(batches: Iterable[pa.RecordBatch], path: str, capacity: int) -> Iterator[tuple[int, list]]:
    end = END_ID.to_bytes(4, "little")
    for batch in batches:
        for doc_id, own in zip(batch.column(0).to_pylist(), text_ids(path, batch.column(1)), strict=True):
            ids = own.astype("<u4", copy=False).tobytes() + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield len(part) // 4, [{"doc_id": doc_id, "piece": piece, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}]


def _merge(bins: DataFrame, level: int, capacity: int, levels: int) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py() // FAN_IN
        items = list(zip(table.column("fill").to_pylist(), table.column("pieces").to_pylist(), strict=True))
        return pa.Table.from_batches(_packed(items, node, level, capacity, levels), schema=_BIN)

    return bins.groupBy((F.col("node") / FAN_IN).cast("long")).applyInArrow(merge, _BIN_SQL)


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then END_ID; null and empty texts are that one token. Only documents of more than
    `capacity` tokens are cut, into full pieces and a rest; every piece lies whole in one sequence, and offsets are
    gapless from 0. Rows that repeat a doc_id are packed as documents of their own; an empty table gives no rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        items = list(_pieces(batches, tokenizer_path, capacity))
        yield from _packed(items, TaskContext.get().partitionId(), 0, capacity, MOST_LEVELS)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bins = keep(source.mapInArrow(first, _BIN_SQL))
    done = [bins.where("final")]
    nodes, level, open_ = (bins.agg(F.max("node")).first()[0] or 0) + 1, 0, bins.where("NOT final")
    while nodes > 1 or level == 0:
        nodes, level = -(-nodes // FAN_IN), level + 1
        merged = keep(_merge(open_, level, capacity, 0 if nodes == 1 else MOST_LEVELS - level))
        done.append(merged.where("final"))
        open_ = merged.where("NOT final")
    final = done[0]
    for d in done[1:]:
        final = final.union(d)
    before = F.aggregate(F.slice("pieces", 1, F.col("k")), F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return final.select("bin", "pieces", F.posexplode("pieces").alias("k", "p")).select("p.*", F.col("bin").alias("sequence_id"), before.alias("offset"))
