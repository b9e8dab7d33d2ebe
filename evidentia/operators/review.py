"""Audit, status and review tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_fields(required: dict[str, Column]) -> Column:
    """Names of required fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", n) for n, c in required.items()]))


def with_status(df: DataFrame, required: dict[str, Column]) -> DataFrame:
    gone = missing_fields(required)
    return df.withColumn("review_reason", F.concat_ws("; ", gone)).withColumn("review_needed", F.size(gone) > 0).withColumn("status", F.when(F.size(gone) > 0, "TO_REVIEW").otherwise("OK"))


def audit(df: DataFrame, record: str, fields: Sequence[str]) -> DataFrame:
    """(S15) (record_id, field, raw_value, validation_status): a row per record and field."""
    long = df.select(F.col(record).alias("record_id"), *[F.col(c).cast("string").alias(c) for c in fields]).unpivot("record_id", list(fields), "field", "raw_value")
    return long.withColumn("validation_status", F.when(F.coalesce(F.trim("raw_value"), F.lit("")) == "", "MISSING").otherwise("READ"))


def review_queue(df: DataFrame, needed: str, columns: Sequence[str], blanks: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(K11) Rows to look at, with empty columns for the decision."""
    return df.where(F.col(needed)).select(*columns, *[F.lit("").alias(b) for b in blanks]).orderBy(*order)


def manifest(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(K10, A12) (field, value) of conditional counts."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    return one.unpivot([], one.columns, "field", "value")


def available(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """The preferred columns that exist."""
    return df.select(*[c for c in preferred if c in df.columns])


def uncovered(df: DataFrame, code: str, value: str) -> DataFrame:
    """Codes none of whose rows has a value."""
    return df.groupBy(code).agg(F.count(value).alias("n")).where("n = 0").select(code)


def classify(label: Column, rules: Sequence[tuple[str, str]], default: str = "OTHER") -> Column:
    """The class of the first pattern found."""
    out = None
    for name, pattern in rules:
        out = F.when(label.rlike(pattern), name) if out is None else out.when(label.rlike(pattern), name)
    return out.otherwise(default) if out is not None else F.lit(default)
