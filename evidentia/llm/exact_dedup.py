"""Exact dedup by content-defined chunk recipes (DataFrame operations only).

Each normalised text is cut where its own content says so (after a sentence or line end, once a least length is
reached), so equal texts get equal chunk lists whatever surrounds them. Chunks are deduplicated by content: every
distinct chunk moves once, and a chunk's 64-bit hash counts as its identifier only after the contents behind it were
compared. A document's recipe, the ordered identifier list, stands for the text from then on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep, lower_ascii

LEAST_CHARS, MOST_CHARS = 512, 4096


def chunks(text: Column, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> Column:
    """Array of consecutive pieces of text: the shortest of at least `least` characters that ends a sentence or a line,
    or `most` characters, or what is left. Empty text: no pieces. Concatenated they give the text."""
    pattern = rf"(?s).{{{least - 1},{most - 1}}}?[.!?\n]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_recipes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """(doc_id, recipe array<struct<id long, content string>>, text_sha256); content is null wherever the chunk's hash
    belongs to one content only, and the chunk itself where two contents share a hash, so recipes are equal exactly
    when texts are. Rows are those of docs; a null text is an empty text and has an empty recipe."""
    base = docs.select(F.col(doc_id).alias("doc_id"), lower_ascii(F.col(text)).alias("t"))
    cut = base.select("doc_id", "t", chunks(F.col("t")).alias("cs"))
    plain = keep(
        cut.select(
            "doc_id",
            F.transform("cs", lambda c: chunk_hash(c)).alias("ids"),
            F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"),
        )
    )
    # Distinct chunk contents, each moved once; a hash that still has two contents is no identifier.
    pieces = base.select(F.explode(chunks(F.col("t"))).alias("c")).select(chunk_hash(F.col("c")).alias("h"), "c")
    shared = keep(pieces.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    unique = F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit(None).cast("string").alias("content")))
    if shared.isEmpty():
        return plain.select("doc_id", unique.alias("recipe"), "text_sha256")
    # Some hash has several contents: in the documents that hold it, the content itself takes part in the comparison.
    long = cut.select("doc_id", "t", F.posexplode("cs").alias("p", "c")).select("doc_id", F.sha2("t", 256).alias("s"), "p", chunk_hash(F.col("c")).alias("h"), "c")
    marked = long.join(shared.withColumn("hit", F.lit(True)), "h", "left")
    lists = (
        marked.groupBy("doc_id", "s")
        .agg(F.array_sort(F.collect_set(F.struct("p", F.col("h").alias("id"), F.when(F.col("hit"), F.col("c")).alias("content")))).alias("x"))
        .select(F.col("doc_id").alias("d"), "s", F.transform("x", lambda e: F.struct(e["id"].alias("id"), e["content"].alias("content"))).alias("r"))
    )
    same = plain["doc_id"].eqNullSafe(F.col("d")) & (plain["text_sha256"] == F.col("s"))
    return plain.join(lists, same, "left").select("doc_id", F.coalesce("r", unique).alias("recipe"), "text_sha256")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is an empty text, and all empty texts are equal. The
    largest doc_id of a group stays. Repeated rows of one doc_id each count in group_size and share their verdict; a
    null doc_id stays only in a group that has no other. An empty table gives no rows; other columns are ignored.
    """
    recipes = keep(chunk_recipes(docs, doc_id, text, **kw))
    groups = keep(recipes.groupBy(F.col("recipe").alias("r")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return recipes.join(groups, F.col("recipe") == F.col("r")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
