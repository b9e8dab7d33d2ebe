"""Votes and other choices among observations. Ties go to the first observation, as the position column orders them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import plain_number

DIGITS = 9  # sums of weights are compared to so many decimals, so their order does not depend on partitions


def ranked(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of a key, with `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)


def keep_best(df: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """(A10) The row with the greatest score of a key, the first among equal ones: a partial aggregate, no window."""
    best = F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(F.col(score), -F.col(pos)))
    return df.groupBy(key).agg(best.alias("best")).select(key, "best.*")


def vote_weights(obs: DataFrame, key: str, value: str, conf: str, pos: str, floor: float | None, bonus: float) -> DataFrame:
    """(A1) (key, value, weight, first, best): sums of confidences, at least `floor` each; a fractional value gets a share of
    the weight of its whole part. best is the greatest (conf, -pos) of the value."""
    c = F.col(conf) if floor is None else F.greatest(F.lit(floor), F.col(conf))
    base = obs.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.sum(c).alias("w"), F.min(pos).alias("first"), F.max(F.struct(F.col(conf).alias("conf"), (-F.col(pos)).alias("p"))).alias("best"), F.count(F.lit(1)).alias("n")
    )
    whole = base.select(F.col(key).alias("whole_key"), F.col(value).alias("whole_value"), F.col("w").alias("more")).where("whole_value % 1 = 0")
    fraction = (F.col(value) % 1) != 0
    joined = base.join(whole, (F.col(key) == F.col("whole_key")) & fraction & (F.col(value).cast("bigint").cast("double") == F.col("whole_value")), "left")
    return joined.select(key, value, F.round(F.col("w") + F.coalesce(F.col("more") * bonus, F.lit(0.0)), DIGITS).alias("weight"), "first", "best", "n")


def consensus(
    obs: DataFrame, key: str, value: str, conf: str, pos: str, *, floor: float | None = 0.2, bonus: float = 0.35, conflicts: bool = False,
    ratio: float = 0.65, least: float = 0.75, cap: float = 0.60,
) -> DataFrame:
    """(A1; with conflicts A2) One row per key: key, winner, top_weight, n_obs, confidence, best_pos; with conflicts also
    second, second_weight, status. A runner-up that weighs nearly as much marks a conflict and caps the confidence."""
    votes = vote_weights(obs, key, value, conf, pos, None if conflicts else floor, bonus)
    item = F.struct(F.col("weight"), (-F.col("first")).alias("f"), F.col(value).alias("v"), F.col("best"))
    top = votes.groupBy(key).agg(F.max(item).alias("t"), F.sum("n").alias("n_obs"))
    out = top.select(key, F.col("t.v").alias("winner"), F.col("t.weight").alias("top_weight"), "n_obs", F.col("t.best.conf").alias("confidence"), (-F.col("t.best.p")).alias("best_pos"))
    if not conflicts:
        return out
    others = votes.join(out.select(F.col(key).alias("_k"), F.col("winner").alias("_x")), (F.col(key) == F.col("_k")) & (F.col(value) != F.col("_x")))
    second = others.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(F.col("weight"), (-F.col("first")).alias("f"), F.col(value).alias("v"))).alias("_s"))
    both = out.join(second, F.col(key) == F.col("_k"), "left").drop("_k")
    clash = F.coalesce((F.abs(F.col("winner") - F.col("_s.v")) > 1e-4) & (F.col("_s.weight") / F.greatest("top_weight", F.lit(1e-6)) > ratio) & (F.col("_s.weight") >= least), F.lit(False))
    return both.select(
        key, "winner", "top_weight", F.col("_s.v").alias("second"), F.col("_s.weight").alias("second_weight"), "n_obs", "best_pos",
        F.when(clash, F.least(F.lit(cap), "confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(clash, "CONFLICT").otherwise("OK").alias("status"),
    )


def flags_union(obs: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """(A16) Flags that any observation has, and their letters in order."""
    agg = obs.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()])
    return agg.withColumn("letters", F.concat_ws(" | ", *[F.when(F.col(n), n) for n in flags]))


def mode_smallest(df: DataFrame, key: str, value: str) -> DataFrame:
    """(A6) The commonest value, the least of equal ones, and its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("m")).select(key, (-F.col("m.v")).alias("winner"), F.col("m.n").alias("votes"))


def strict_majority(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """(A7) The value with at least `least` votes and more than any other."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(key).agg(F.max("n").alias("votes"))
    tied = counts.join(top.select(F.col(key).alias("_k"), "votes"), (F.col(key) == F.col("_k")) & (F.col("n") == F.col("votes")))
    return tied.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.min(value).alias("winner"), F.min("n").alias("votes")).where((F.col("c") == 1) & (F.col("votes") >= least)).drop("c")


def histogram_vote(df: DataFrame, key: str, x: str, item: str, weight: str, bin_: float, least_items: int = 2, least_weight: float = 0.8) -> DataFrame:
    """(A8) The bin (half-even) with most distinct items, then most weight; its weighted mean, if it has enough of both."""
    bins = df.groupBy(key, (F.bround(F.col(x) / bin_) * bin_).alias("bin")).agg(
        F.countDistinct(item).alias("items"), F.round(F.sum(weight), 6).alias("w"), F.sum(F.col(x) * F.col(weight)).alias("xw"), F.sum(weight).alias("sw")
    )
    best = bins.groupBy(key).agg(F.max(F.struct("items", "w", (-F.col("bin")).alias("b"), "xw", "sw")).alias("m"))
    return best.where((F.col("m.items") >= least_items) & (F.col("m.w") >= least_weight)).select(
        key, (-F.col("m.b")).alias("bin"), F.col("m.items").alias("items"), F.round(F.col("m.xw") / F.col("m.sw"), 8).alias("mean")
    )


def confirmed_best(df: DataFrame, key: list[str], score: str, cut: float = 0.72, extra: float = 0.06) -> DataFrame:
    """(A9) Best score of a key, a little more if at least two readings pass the cut, at most 1."""
    agg = df.groupBy(*key).agg(F.max(score).alias("s"), F.count_if(F.col(score) >= cut).alias("confirmations"))
    return agg.withColumn("best", F.when(F.col("confirmations") >= 2, F.least(F.lit(1.0), F.col("s") + extra)).otherwise(F.col("s"))).drop("s")


def accept_by_margin(df: DataFrame, key: str, item: str, score: str, sure: float, fair: float, margin: float) -> DataFrame:
    """(T4, T5) The best item, accepted if its score is sure, or fair with a margin over the second best."""
    top = ranked(df, [key], [F.col(score).desc(), F.col(item).asc()], 2).groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col(item))).alias("best"), F.max(F.when(F.col("rank") == 1, F.col(score))).alias("score"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col(score))), F.lit(0.0)).alias("second"),
    )
    ok = (F.col("score") >= sure) | ((F.col("score") >= fair) & (F.round(F.col("score") - F.col("second"), 9) >= margin))
    return top.select(key, F.when(ok, F.col("best")).otherwise("").alias("accepted"), "score", F.round(F.col("score") - F.col("second"), 9).alias("margin"))


def numeric_vote(readings: DataFrame, key: str, text: str, weight: str, decimal_bonus: float = 0.34, most: float = 999.0) -> DataFrame:
    """(A5) Numbers in readings (up to four digits and three decimals that stand alone, above 0 and up to `most`), weighed by their
    variant, decimals a little more: the heaviest, the least of equal. The heaviest decimal wins over all others if it weighs
    0.90, or at most 0.55 less than its own whole part, which may be a truncated reading of it."""
    plain = F.translate(plain_number(F.col(text)), "IL", "11")
    found = readings.select(key, weight, F.explode(F.regexp_extract_all(plain, F.lit(r"(?<![0-9])([0-9]{1,4}(?:\.[0-9]{1,3})?)(?![0-9])"), F.lit(1))).alias("t"))
    cast = found.select(key, F.col("t").cast("double").alias("v"), (F.col(weight) + F.when(F.col("t").contains("."), decimal_bonus).otherwise(0.0)).alias("w"))
    sums = cast.where((F.col("v") > 0) & (F.col("v") <= most)).groupBy(key, "v").agg(F.round(F.sum("w"), 6).alias("w"))
    item, whole = F.struct("w", (-F.col("v")).alias("v")), F.col("v") % 1 == 0
    best = sums.groupBy(key).agg(
        F.max(item).alias("m"), F.max(F.when(~whole, item)).alias("d"), F.map_from_entries(F.collect_list(F.when(whole, F.struct("v", "w")))).alias("wholes")
    )
    cut = F.coalesce(F.element_at("wholes", F.floor(-F.col("d.v")).cast("double")), F.lit(0.0))
    decimal = F.coalesce((F.col("d.w") >= 0.90) | (F.round(F.col("d.w") + 0.55, 6) >= cut), F.lit(False))
    return best.select(key, F.when(decimal, F.col("d")).otherwise(F.col("m")).alias("x")).select(key, (-F.col("x.v")).alias("value"), F.col("x.w").alias("weight"))


def text_choice(evidence: DataFrame, key: str, norm: str, text: str, score: str, image: str, pos: str) -> DataFrame:
    """(A3, A13) Readings grouped by normal form: best score and 6 more for each further image, 18 at most; the best form's best
    text, a margin-free runner-up, and how many images agree."""
    forms = evidence.groupBy(key, norm).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(pos)).alias("p"), F.col(text).alias("t"))).alias("b"), F.countDistinct(image).alias("images"))
    rank = F.round(F.col("b.s") + F.least(F.lit(18.0), 6.0 * (F.col("images") - 1)), 6)
    return forms.groupBy(key).agg(F.max(F.struct(rank.alias("r"), F.col("b.p").alias("p"), F.col("b.t").alias("t"), "images", F.col("b.s").alias("s"))).alias("m"), F.count(F.lit(1)).alias("forms")).select(
        key, F.col("m.t").alias("text"), F.col("m.r").alias("rank_score"), "m.images", F.least(F.lit(99.0), F.col("m.s") + 5.0 * (F.col("m.images") - 1)).alias("confidence"), "forms"
    )
