"""A training-data pipeline: quality, exact copies, near copies, mixture, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that stay, with their
columns, and the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.exact_dedup import exact_dedup
from evidentia.llm.jaccard_join import near_copies
from evidentia.llm.mixing import mixed_rows
from evidentia.llm.packing import pack
from evidentia.llm.quality_model import quality_rows
from evidentia.llm.queries import tokenizer_path
from evidentia.llm.store import fresh, keep, lower_ascii, table, written_alone

ORACLE_SQL = None  # the quality classifier is no SQL; tests hold the copies, mixing and packing stages against brute force


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null and empty texts are judged as one empty passage."""
    return quality_rows(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the greatest doc_id; of rows that repeat id and text, one. Rows without id stay if
    their text has no row with one."""
    verdict = keep(exact_dedup(docs))
    name, sha = fresh("exact_copies_key", docs.columns), F.sha2(lower_ascii(F.col("text")).cast("binary"), 256)
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    gone = verdict.where("NOT kept").select(F.concat_ws(" ", ids, "text_sha256").alias(name))
    twice = keep(verdict.where("kept").groupBy(F.concat_ws(" ", ids, "text_sha256").alias(name)).count().where("count > 1").select(name))
    keyed = docs.withColumn(name, F.concat_ws(" ", ids, sha))
    left = keyed.join(gone, name, "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, name, "left_anti").unionByName(left.join(twice, name, "left_semi").dropDuplicates([name]))
    return left.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts links connect, the one with the least doc_id; rows are told apart by id and text, so of a doc_id with
    several texts only those that are copies go. Texts without words stay."""
    own, text = fresh("near_copies_id", docs.columns), fresh("near_copies_text", docs.columns)
    gone = keep(near_copies(docs).select(F.col("doc_id").alias(own), F.col("content").alias(text)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in the order of the global shuffle."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences; each repetition of a document is packed by itself."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality), ("exact_dedup", exact_copies), ("ngram_jaccard_join", one_of_near_copies), ("source_mixing", mixture),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
