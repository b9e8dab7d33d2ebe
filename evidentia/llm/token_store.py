"""Token ids in ORC files: integer run lengths, stripes, row indexes and Bloom filters on document ids.

Documents are sorted by id over the cluster and each task encodes its run and writes one file, so files, stripes and row
groups hold narrow ranges of ids. ORC keeps ids as integer run lengths in stripes that tasks read side by side, and statistics
and Bloom filters per row group, by which a reader of some documents passes over all others. A document's place
in the whole stream is its place in its file and the file's place; the latter is in a small table beside the files, one
row per file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .grams import release
from .store import scratch
from .tokens import text_ids

END_ID = 2
STRIPE_BYTES = 64 << 20
GROUP_ROWS = 1000  # documents of a row group, the least that a reader of one document reads
BATCH_TOKENS = 1 << 20  # of the batches that tasks hand to the writer; a longer document is a batch of its own
FALSE_HITS = 0.01  # of the Bloom filters


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) in order -> (part, doc_id, at, n_tokens, ids)."""
    release()
    tail, part, at = np.array([end], np.uint32), TaskContext.get().partitionId(), 0
    docs: list = []
    raw: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        nonlocal at
        lengths = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(lengths)
        flat = pa.array(np.concatenate(raw).astype(np.int32))
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat)
        starts = at + ends - lengths
        at += int(ends[-1])
        columns = [pa.array(np.full(len(docs), part, np.int32)), pa.array(docs, schema.field("doc_id").type), pa.array(starts), pa.array(lengths), ids]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    held = 0
    for batch in batches:
        for doc, own in zip(batch.column(0).to_pylist(), text_ids(path, batch.column(1)), strict=True):
            ids = np.append(own, tail)
            if docs and held + len(ids) > BATCH_TOKENS:
                yield flush()
                docs, raw, held = [], [], 0
            docs.append(doc)
            raw.append(ids)
            held += len(ids)
    if docs:
        yield flush()


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES, group_rows: int = GROUP_ROWS
) -> None:
    """Write each text's ids and end_id under path/ids in ascending order of doc_id, and path/parts, a row per file.

    Null and empty texts are the end alone. Null ids come first; rows that repeat an id stand in the order of their texts'
    hash, and as many of them as there may be spread over files, for equal rows are told apart by their place. Ids may be of
    any type with an order that ORC can hold. An empty table gives files without rows; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_field = source.select("doc_id").limit(0).toArrow().schema.field(0)
    schema = pa.schema([("part", pa.int32()), ("doc_id", id_field.type), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    id_type = source.schema["doc_id"].dataType.simpleString()
    keyed = source.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "text")
    rows = ordered.mapInArrow(lambda b: _encoded(b, tokenizer_path, end_id, schema), f"part int, doc_id {id_type}, at long, n_tokens long, ids array<int>")
    bloom = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_HITS), "orc.row.index.stride": str(group_rows), "orc.stripe.size": str(stripe_bytes)}
    rows.write.options(**bloom).orc(f"{path}/ids")
    per = read_rows(spark, f"{path}/ids").groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    # One row per file: what one task of a sort by part can hold however large the corpus is.
    start = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")
    per.withColumn("start", start).write.orc(f"{path}/parts")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def _checksums(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The last column, lists of ids, becomes the crc32 of their little-endian bytes."""
    for batch in batches:
        ids = batch.columns[-1]
        ends = ids.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], schema=schema)


def read_tokens(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents for which `where`, a condition on doc_id, holds. It reaches the files:
    statistics and Bloom filters pass over stripes and row groups without such documents."""
    rows = read_rows(spark, f"{path}/ids")
    rows = rows if where is None else rows.where(where)
    parts = read_rows(spark, f"{path}/parts").select(F.col("part").alias("p"), F.col("start").alias("s"))
    return rows.join(parts, F.col("part") == F.col("p")).select("doc_id", (F.col("s") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at path: doc_id, start, n_tokens, ids_crc32 (of the little-endian unsigned ids)."""
    rows = read_tokens(spark, path)
    id_field = rows.select("doc_id").limit(0).toArrow().schema.field(0)
    schema = pa.schema([("doc_id", id_field.type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _checksums(b, schema), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as token files to a new folder in the shared place and return token_digests of what was written."""
    path = scratch(docs.sparkSession)
    write_tokens(docs, path, tokenizer_path, doc_id, text)
    return token_digests(docs.sparkSession, path)
