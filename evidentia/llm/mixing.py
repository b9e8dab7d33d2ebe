"""Mixing sources to target weights by Poisson replication.

A source's target weight over its natural share gives the mean number of times a document of it is repeated. Each
document's own hash, read as a uniform number, is put through the inverse Poisson distribution of that mean; the
document appears that often, and a hash of document and copy orders all copies globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

TEMPERATURE = 0.5  # targets are proportional to a source's words to this power, where none are given
SEED = 17
MOST_RATE = 500.0  # exp(-rate) must not vanish; a greater mean is a sum of equal parts, each inverted by itself


def _uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def poisson(rate: Column, u: Column) -> Column:
    """The inverse Poisson distribution: the least k whose cumulative probability exceeds u. The walk is longer than any
    u below 1 - 2**-48 needs, and stops adding once the sum is past u."""
    start = F.exp(-rate)
    most = (F.lit(32.0) + rate + 12 * F.sqrt(rate)).cast("int")

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * rate / k
        return F.struct(k.alias("k"), term.alias("term"), (a["total"] + term).alias("total"))

    first = F.struct(F.lit(0).alias("k"), start.alias("term"), start.alias("total"))
    return F.aggregate(F.sequence(F.lit(1), most), first, lambda a, k: F.when(a["total"] > u, a).otherwise(step(a, k)))["k"]


def source_sizes(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(source, chars, documents) over all documents; a null source is a source of its own."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("chars"), F.count(F.lit(1)).alias("documents"))


def drawn(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None,
    epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED,
) -> DataFrame:
    """(row: struct of docs' columns, copy, rate, shuffle_key) in the order of `mix`, whose rules hold here. A row travels as one
    struct, so none of its columns can clash with those of the operator."""
    sizes = keep(source_sizes(docs, text, source))
    weight = (
        F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])[F.coalesce("source", F.lit(""))]
        if targets
        else F.pow(F.col("chars").cast("double"), F.lit(temperature))
    )
    weighed = sizes.withColumn("w", F.coalesce(weight, F.lit(0.0)))
    every, all_w = weighed.agg(F.sum("chars").cast("double"), F.sum("w")).first()
    mean = F.when(F.col("chars") == 0, F.lit(1.0)).otherwise(F.lit(epochs) * F.lit(every or 0.0) * F.col("w") / F.lit(all_w or 1.0) / F.col("chars"))
    rates = keep(weighed.select(F.col("source").alias("of"), mean.cast("double").alias("rate")))
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("own"), ident.alias("ident"), F.xxhash64(F.col(text)).alias("tie"))
    inner = packed.join(rates, F.col("own").eqNullSafe(F.col("of")))
    parts = F.ceil(F.col("rate") / MOST_RATE).cast("int")
    each = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson(F.col("rate") / parts, _uniform(F.concat(F.lit(f"{seed}:"), F.col("ident"), F.lit(":"), j.cast("string")))))
    times = F.when(F.col("rate") > 0, F.aggregate(each, F.lit(0), lambda a, k: a + k)).otherwise(F.lit(0))
    copies = inner.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    key = F.md5(F.concat(F.lit(f"{seed}/"), F.col("ident"), F.lit("/"), F.col("copy").cast("string")).cast("binary"))
    return copies.select("row", "copy", "rate", key.alias("shuffle_key"), "tie").orderBy("shuffle_key", "tie").drop("tie")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The columns of docs with copy (int from 0), rate (double) and shuffle_key (string), which take the place of columns of docs
    with these names; each row repeated by its Poisson count and all rows in order of shuffle_key over all partitions.

    The result has about `epochs` times the characters of docs, dealt to sources by `targets` (relative weights by
    source) or, without them, by size to the power `temperature`. A source without a target gets none, so none of its
    rows; sources whose texts are all empty keep their rows once on average. A null source is a source of its own; null
    ids hash as empty text; rows that repeat a doc_id are repeated alike and stay distinct copies of their own row. Equal
    keys (repeated or null ids) follow the hash of their text, so only equal rows have no order. No rows give no rows.
    """
    extra = ("copy", "rate", "shuffle_key")
    return drawn(docs, doc_id, text, source, **how).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in extra], *extra)


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """mix with exactly the columns of docs, whatever their names."""
    return drawn(docs, doc_id, text, source, **how).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
