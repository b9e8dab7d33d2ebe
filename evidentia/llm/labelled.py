"""A bounded sample of labelled texts to fit a classifier on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import crc_mod

FOLDS = 5  # rows whose crc32(id) is a multiple of this are held out
SAMPLE = 3000  # labelled rows per fit, half of them for each label where there are enough


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """(doc_id, text, y), at most `most` rows, in order of id. Of each label the rows with the least hash of their id are
    taken, so a sample neither follows the order of ids nor depends on partitions. Held-out, unlabelled and null rows never
    take part. The ids are at most `most`, so they may be broadcast; whole texts come back."""
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("i").isNotNull() & (crc_mod(F.col("i"), FOLDS) != 0)
    )
    picked = [known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("i"), "i").limit(most // 2) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("i"))
    out = rows.select("doc_id", "text", "y").toPandas()
    return out.sort_values(["doc_id", "y"], kind="stable").drop_duplicates("doc_id").reset_index(drop=True)


def prior(labels: DataFrame, label: str) -> float:
    """The share of label 1 over all rows that may be learnt from."""
    y = F.col(label).cast("int")
    n, ones = labels.where(y.isin(0, 1) & (crc_mod(F.col("doc_id"), FOLDS) != 0)).agg(F.count(F.lit(1)), F.sum(y)).first()
    return min(0.99, max(0.01, (ones or 0) / n)) if n else 0.5
