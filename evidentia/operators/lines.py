"""From recognised words to lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_label, is_structured_short, is_textual, plausibility
from .match import nearest


def usable_words(df: DataFrame, text: str = "text", conf: str = "conf", top: str = "top", height: str = "height", low: int = 7, high: int = 45) -> DataFrame:
    """Words with a letter or digit, a confidence and a plausible height; adds center_y."""
    c = F.coalesce(F.col(conf).try_cast("double"), F.lit(-1.0))
    return df.where(is_textual(F.col(text)) & (c >= 0) & F.col(height).between(low, high)).withColumn("center_y", F.col(top) + F.col(height) / 2.0)


def in_panel(df: DataFrame, left: str, low: float, high: float) -> DataFrame:
    """(F2)"""
    return df.where((F.col(left) >= low) & (F.col(left) <= high))


def needs_recovery(text: Column, conf: Column, median: Column, weak_prefix: Column) -> Column:
    """Readings to repeat: malformed ones, and weak ones unless they are long words or structured identifiers."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", "")
    long = (F.length(s) >= 7) & text.rlike("[A-Za-z]{3,}") & (conf >= 40)
    structured = (F.length(s) >= 4) & s.rlike("[A-Za-z]") & s.rlike("[0-9]") & (conf >= 40)
    malformed = (
        (F.length(s) < 2) | ((F.length(s) <= 3) & (conf < 55) & ~is_structured_short(text)) | s.rlike("^[A-Za-z][SZOIL]$") | s.rlike("^[0-9]{1,4}$")
        | text.contains("?") | text.contains("�")
    )
    return (weak_prefix & ~long & ~structured) | malformed | ((conf < median - 20) & ~long & ~structured)


def clipped(top: Column, bottom: Column, low: Column, high: Column, margin: int = 2) -> Column:
    """A row cut by the picture's edge."""
    return (top <= low + margin) | (bottom >= high - margin)


def some_whole(df: DataFrame, key: str, partial: str) -> DataFrame:
    """Groups with a row that is not partial."""
    return df.groupBy(key).agg(F.bool_and(partial).alias("all_partial"), F.count(F.lit(1)).alias("n")).where("NOT all_partial").drop("all_partial")


def strip_weak_head(df: DataFrame, line: str, pos: str, weak: Column, word: Column) -> DataFrame:
    """Leading weak tokens go while a real word follows."""
    w = Window.partitionBy(line).orderBy(pos)
    strong_so_far = F.max((~weak).cast("int")).over(w)
    word_later = F.coalesce(F.max(word.cast("int")).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return df.withColumn("go", (strong_so_far == 0) & (word_later == 1)).where("NOT go").drop("go")


def unique_tokens(df: DataFrame, image: str, pos: str, text: str, box: tuple[str, str, str, str]) -> DataFrame:
    """(C12) Of the tokens of a picture that read the same (letters and digits, in upper case) in the same box, the first by pos and
    then by all columns."""
    compact = F.regexp_replace(F.upper(F.coalesce(F.col(text), F.lit(""))), "[^A-Z0-9]", "")
    row = F.struct(pos, *[c for c in df.columns if c != pos])
    return df.groupBy(F.col(image).alias("_i"), compact.alias("_t"), *[F.col(c).alias(f"_b{k}") for k, c in enumerate(box)]).agg(F.min(row).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def batch_options(df: DataFrame, text: str, conf: str, left: str, lane: str, lanes: Sequence[float], step: float, short: Column, method: str) -> DataFrame:
    """(X37) Readings of stacked crops as candidates: the text cleaned (rows without one go), lane and level nearest to the crop's, and a
    score of confidence, plausibility and how near the text begins to its lane (12 less 1.5 a pixel, -24 at least). Where the
    source looked like a short code, such a text gains 14, one without letters loses 45 and others lose 8."""
    own = df.select(*[clean_label(F.col(c)).alias(c) if c == text else F.col(c) for c in df.columns], F.col(lane).alias("_x")).where(F.col(text) != "")
    placed = nearest(own.drop(lane), "_x", lanes).withColumnRenamed("lane_index", "level").withColumnRenamed("lane", "crop_lane").drop("_x")
    fit = F.greatest(F.lit(-24.0), 12.0 - 1.5 * F.abs(F.col(left) - F.col("crop_lane")))
    letters = F.regexp_replace(text, "[^A-Za-z0-9]", "").rlike("[A-Za-z]")
    extra = F.when(~short, 0.0).when(is_structured_short(F.col(text)), 14.0).when(~letters, -45.0).otherwise(-8.0)
    score = F.coalesce(F.col(conf), F.lit(0.0)) + plausibility(F.col(text)) + fit + extra
    return placed.withColumn("geometry_alignment", fit).withColumn("branch_x", F.bround(F.col("crop_lane") - step).cast("int")).withColumn("score", score).withColumn(
        "method", F.concat(F.lit("line_batch_"), F.coalesce(F.col(method), F.lit("raw")))
    )


def trim_edge_noise(x: Column) -> Column:
    """(F8) Unbalanced brackets and bars off both ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\])}|\s]+", ""), r"[\[({|\s]+$", ""))


def lines(df: DataFrame, key: list[str], text: str = "text", conf: str = "conf", left: str = "left", top: str = "top", width: str = "width", height: str = "height") -> DataFrame:
    """(A14, A11, A15) Words of a line in order of (left, top), their mean confidence and the box around them."""
    words = F.array_sort(F.collect_list(F.struct(F.col(left).alias("l"), F.col(top).alias("t"), F.col(text).alias("x"))))
    right, bottom = F.max(F.col(left) + F.col(width)), F.max(F.col(top) + F.col(height))
    return df.groupBy(*key).agg(
        F.concat_ws(" ", F.transform(words, lambda w: w["x"])).alias("line"), F.round(F.avg(conf), 6).alias("mean_conf"), F.min(left).alias("box_left"),
        F.min(top).alias("box_top"), right.alias("box_right"), bottom.alias("box_bottom"), F.count(F.lit(1)).alias("n_words"),
    )


def strong_words(df: DataFrame, key: str, conf: str, floor: float = 22.0, drop: float = 25.0) -> DataFrame:
    """(A15) Words not far below the best of their row."""
    return df.where(F.col(conf) >= F.greatest(F.lit(floor), F.max(conf).over(Window.partitionBy(key)) - drop))
