"""Quality rules with cross-document line frequency (DataFrame operations only).

Per document, word, symbol, line and repetition counts; across documents, normalised lines are hashed and the distinct
documents per host that hold them are counted. Lines above the limit are removed, and a document that loses too much
is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import SPACE_CHARS, SPACE_CLASS, keep, lower_ascii

LINE_LIMIT = 100  # distinct documents of one host that may hold a line
MIN_WORDS = 50  # words a document needs, also after lines were removed
MIN_SHARE = 0.5  # share of a document's words that has to remain
_POS_BITS = 24  # of a packed key; the rest are hash bits


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside 3-word windows that occur twice or more. Needs the column w.

    A window's key packs 40 bits of its hash with its position, so one sort of a long array lines equal windows up. The
    few neighbours that agree are compared word by word; where the 40 bits lie (or positions do not fit), the
    full 64-bit hash decides instead.
    """
    mask = (1 << _POS_BITS) - 1
    starts = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get("w", i)
    hashed = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))
    df = df.withColumn("s", F.sort_array(F.transform(starts, lambda i: hashed(i).bitwiseAND(~mask).bitwiseOR(i.cast("long")))))
    near = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), _POS_BITS) == 0
    df = df.withColumn(
        "f", F.filter("s", lambda x, i: F.coalesce(near(x, F.get("s", i - 1)), F.lit(False)) | F.coalesce(near(x, F.get("s", i + 1)), F.lit(False)))
    )
    at = lambda x: x.bitwiseAND(mask).cast("int")

    def differ(x: Column, i: Column) -> Column:
        y = F.get("f", i - 1)
        unlike = F.lit(False)
        for k in range(3):
            unlike = unlike | (word(at(x) + k) != word(at(y) + k))
        return F.coalesce(near(x, y) & unlike, F.lit(False))

    df = df.withColumn("lied", (F.size("w") > mask) | F.exists(F.transform("f", differ), lambda b: b))
    # The exact way for the documents whose short keys lied: sort (hash, position) pairs.
    pairs = F.sort_array(F.transform(starts, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))
    df = df.withColumn("q", F.when(F.col("lied"), pairs))
    hit = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    slow = F.transform(F.filter("q", lambda x, i: hit(x, F.get("q", i - 1)) | hit(x, F.get("q", i + 1))), lambda x: x["i"])
    df = df.withColumn("p", F.sort_array(F.when(F.col("lied"), slow).otherwise(F.transform("f", at))))
    covered = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get("p", i - 1), F.lit(3))).cast("long"))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)).drop("s", "f", "lied", "q", "p")


def _line_hash(line: Column) -> Column:
    """96 bits: n lines of one host have two with one hash with odds of n * n / 2**97, 10**-9 for 10**10 of them."""
    return F.struct(F.xxhash64(line, F.lit(9)).alias("x"), (F.crc32(line.cast("binary")) - F.lit(1 << 31)).cast("int").alias("c"))


def line_features(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """Per document: its counts and its lines as array<struct<h, words, times>>, h a hash of the normalised line."""
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")
    )
    has_word = lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0
    flat = F.regexp_replace(lower_ascii(F.col("t")), r"[\x20\x09\x0B-\x0D]+", " ")
    df = base.select(
        "doc_id", "host", "t", words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), has_word).alias("raw"),
        F.filter(F.transform(F.split(flat, "\n"), lambda x: F.btrim(x)), lambda x: x != "").alias("ls"),
    )
    df = _repeat_words(df)
    space_free = lambda x: F.length(F.translate(x, " ", ""))
    return df.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("ls", lambda x: F.struct(_line_hash(x).alias("h"), (F.length(x) - space_free(x) + 1).alias("words"))).alias("lines"),
    )


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    line_limit: int = LINE_LIMIT, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_words.

    A line counts once per distinct document of its host: rows that repeat a doc_id are one document, a row without id is one
    of its own, and copies of a text are as many documents. Lines held by more than line_limit documents are removed; a
    document is rejected when fewer than min_words words or less than min_share of its words remain. Null and empty texts
    have zero counts and fail; a null host is a host of its own, as is the empty one with it; repeated rows are judged
    alike; other columns are ignored; no rows give no rows.
    """
    feats = keep(line_features(docs, doc_id, text, host).withColumn("row", F.monotonically_increasing_id()))  # written, so it stays
    repeated = keep(feats.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d"))
    holds = lambda df: df.select("doc_id", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    # Only rows that repeat an id need to be told apart by it, so all others are counted where they are read.
    once = holds(feats.join(repeated, F.col("doc_id") == F.col("d"), "left_anti")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    more = holds(feats.join(repeated, F.col("doc_id") == F.col("d"), "left_semi")).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    over = keep(once.union(more).groupBy("host", "h").agg(F.sum("n").alias("n")).where(F.col("n") > line_limit).select("host", "h"))
    removed = keep(
        feats.select("host", F.col("row").alias("r"), F.explode("lines").alias("x"))
        .select("host", "r", F.col("x.h").alias("h"), F.col("x.words").alias("words"))
        .join(over, ["host", "h"])
        .groupBy("r")
        .agg(F.sum("words").cast("long").alias("gone"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        feats.drop("lines")
        .join(removed, F.col("row") == F.col("r"), "left")
        .withColumn("n_removed_words", F.coalesce("gone", F.lit(0).cast("long")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
            (~failed & (left >= min_words) & (left >= min_share * F.col("n_words"))).alias("kept"), "n_removed_words",
        )
    )
