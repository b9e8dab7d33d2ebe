"""Audit of how five text filters interact, in every order they can be applied in.

Every text is read once and becomes five failure bits, its mask. Per part and label, 32 signed parity sums over the masks are
aggregated (a Walsh-Hadamard transform, summed as rows arrive); its exact inverse gives how many documents have each mask,
and from these 32 cells follows every order, without further look at the documents: a filter at some step removes the
cells that hold its bit and none of the bits before it. The Shapley value needs no orders: a document that fails k filters
is removed by each of them in 120 / k of the 120 orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import SPACE_CLASS, UPPER, keep

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = factorial(len(FILTERS))
MIN_WORDS, MIN_DISTINCT, MOST_UPPER, SYMBOLS = 50, 65, 5, r"[#$%&*|]"


def text_facts(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(doc_id, part, digest of the text, bits of A to D), one row per row of docs."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = F.filter(F.split("t", f"[{SPACE_CLASS}]+"), lambda w: w != "")
    upper = F.length("t") - F.length(F.translate("t", UPPER, ""))
    size = lambda c: F.size(c).cast("long")
    fails = (
        size("w") < MIN_WORDS,
        100 * size(F.array_distinct("w")) < MIN_DISTINCT * size("w"),
        100 * upper.cast("long") > MOST_UPPER * F.length("t"),
        F.col("t").rlike(SYMBOLS),
    )
    bits = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return base.withColumn("w", words).select("doc_id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), bits.alias("bits"))


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, good, toxic, mask) per row of docs. Texts stay where they are read: digests and bits travel.

    A text's first document is met by digest and id together, so a group of copies of whatever size is no hot key.
    """
    facts = keep(text_facts(docs, doc_id, text, part))
    ids = facts.where("doc_id IS NOT NULL")
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("least"))
    seen = facts.join(first.withColumnRenamed("digest", "d"), (F.col("doc_id") == F.col("least")) & (F.col("digest") == F.col("d")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("least").isNull()
    seen = seen.select("doc_id", "part", (F.col("bits") + copy.cast("int") * (1 << FILTERS.index("E"))).alias("mask"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.select(F.col("doc_id").alias("i"), "quality", "toxic").where("i IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("i").agg(one("quality"), one("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(0))
    return seen.join(known, F.col("doc_id") == F.col("i"), "left").select("part", flag("quality").alias("good"), flag("toxic").alias("toxic"), "mask")


def parity(mask: Column | int, s: Column | int) -> Column:
    """1 where mask and s share an even number of bits, else -1."""
    if isinstance(s, int):
        s = F.lit(s)
    return F.lit(1) - 2 * (F.bit_count(mask.bitwiseAND(s)) % 2)


def mask_cells(masked: DataFrame) -> DataFrame:
    """(part, n, good, toxic): each an array of 32 counts, by mask, of all documents of the part, of those of good quality
    and of toxic ones. The sums are whole numbers, so the inverse is exact."""
    sums = masked.groupBy("part", "good", "toxic").agg(*[F.sum(parity(F.col("mask"), s)).alias(f"w{s}") for s in range(CELLS)])
    w = F.array(*[f"w{s}" for s in range(CELLS)])
    at = F.sequence(F.lit(0), F.lit(CELLS - 1))
    total = lambda m: F.aggregate(F.zip_with("w", at, lambda x, s: x * parity(m, s)), F.lit(0).cast("long"), lambda a, b: a + b)
    inverse = F.transform(at, lambda m: F.shiftright(total(m), len(FILTERS)))
    cells = sums.select("part", "good", "toxic", w.alias("w")).withColumn("c", inverse)
    cell = lambda m, when: F.sum(F.when(when, F.get("c", F.lit(m))).otherwise(0))
    per = {"n": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    return cells.groupBy("part").agg(*[F.array(*[cell(m, when) for m in range(CELLS)]).alias(name) for name, when in per.items()])


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    Words are runs of characters other than ASCII white space. A fails texts under 50 words; B those whose distinct words are
    under 65 % of their words; C those with more than 5 % of A-Z; D those with one of #$%&*|; E those whose text a smaller
    doc_id has, in whatever part. Null and empty texts have no words and fail A; two of them are copies. Rows that repeat an
    id and text are no copies of each other, as neither id is smaller, and each counts. A row without id has no smaller one,
    is smaller than none and has no labels. Null and empty parts are one. Of labels that contradict each other for one id, 1
    counts; other values than 1 are no label. An empty table gives no rows; other columns are ignored.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = (
        mask_cells(masks(docs, labels, doc_id, text, part))
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    )
    bits = F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])
    bit = lambda k: F.get(bits, F.instr(F.lit(FILTERS), F.substr("filter_order", k, F.lit(1))) - 1)
    before = F.aggregate(F.when(F.col("step") > 1, F.sequence(F.lit(1), F.col("step") - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda a, k: a.bitwiseOR(bit(k)))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("before", before)
    own, earlier = F.col("own"), F.col("before")
    has = lambda m, bits: m.bitwiseAND(bits) != 0

    def total(cells: str, holds) -> Column:
        counted = F.transform(cells, lambda c, m: F.when(holds(m), c).otherwise(0))
        return F.aggregate(counted, F.lit(0).cast("long"), lambda a, b: a + b)

    here = lambda m: has(m, own) & ~has(m, earlier)
    share = F.transform("n", lambda c, m: F.when(has(m, own), c * (F.lit(ORDERS) / F.bit_count(m)).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~has(m, own) & ~has(m, earlier)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: has(m, own) & has(m, earlier)).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )
