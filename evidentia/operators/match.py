"""Joins with explicit status, matching against known codes and labels, fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_key, similarity
from ..sources.folders import written

MOST_KNOWN = 10_000  # rows of a dictionary that is compared with every reading; more are an error

#: The cost of reading one character for another, at digit places and at the letter's place.
DIGIT_COST = (
    ("O", "0", 0.12), ("Q", "0", 0.18), ("D", "0", 0.30), ("I", "1", 0.12), ("L", "1", 0.18), ("|", "1", 0.18), ("T", "1", 0.35), ("P", "2", 0.35),
    ("Z", "2", 0.22), ("S", "5", 0.20), ("G", "6", 0.35), ("G", "9", 0.40), ("B", "8", 0.15), ("A", "4", 0.40),
)
LETTER_COST = (("4", "A", 0.12), ("8", "B", 0.12), ("6", "G", 0.25), ("0", "O", 0.30), ("1", "I", 0.35))
LETTER_PLACE, OTHER_DIGIT, OTHER, LOST_ZERO, WORST = 2, 0.95, 1.30, 0.42, 2.6


def small(df: DataFrame, most: int = MOST_KNOWN) -> DataFrame:
    """df marked for broadcast, after its size was checked."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return F.broadcast(df)


def left_with_placeholder(left: DataFrame, right: DataFrame, key: str, order: str, defaults: dict[str, object]) -> DataFrame:
    """(J1) Left join 1:N on a column of both; unmatched rows get one row of defaults; frame_index counts matches from 1."""
    out = left.join(right, key, "left").withColumn("frame_index", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return out.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns])


def reconcile(left: DataFrame, right: DataFrame, key: str, status: Sequence[str] = ("LEFT_ONLY", "MATCHED", "RIGHT_ONLY", "RIGHT_NO_KEY")) -> DataFrame:
    """(J5) All rows of both sides with a status; empty and missing keys never match. The left branch and the unmatched right
    rows are separate, so a hot key of the left is an ordinary skewed left join."""
    has = lambda: F.coalesce(F.col(key), F.lit("")) != ""
    matched = left.join(right.where(has()).withColumn("_r", F.lit(1)), key, "left").withColumn("status", F.when(F.col("_r") == 1, status[1]).otherwise(status[0])).drop("_r")
    alone = right.where(has()).join(left.select(key).distinct(), key, "left_anti").withColumn("status", F.lit(status[2]))
    keyless = right.where(~has()).withColumn("status", F.lit(status[3]))
    return matched.unionByName(alone, allowMissingColumns=True).unionByName(keyless, allowMissingColumns=True)


def interval_join(points: DataFrame, bands: DataFrame, x: str, low: str, high: str, order: str, width: float, carry: Sequence[str] = ()) -> DataFrame:
    """(J6) Points with the first band (by `order`) of those [low, high) that hold them; others go, repeated points stay. Both sides are
    cut into cells of `width`, so it is an equi-join whatever their sizes; a cell's bands travel as one array."""
    band = F.struct(order, low, high, *carry)
    cells = bands.withColumn("_c", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))).groupBy("_c").agg(F.collect_list(band).alias("_bs"))
    near = points.withColumn("_c", F.floor(F.col(x) / width)).join(cells, "_c")
    first = F.array_min(F.filter("_bs", lambda b: (F.col(x) >= b[low]) & (F.col(x) < b[high])))
    return near.withColumn("_b", first).where("_b IS NOT NULL").select(*points.columns, "_b.*")


def nearest(df: DataFrame, x: str, lanes: Sequence[float]) -> DataFrame:
    """(J7) Add lane_index and lane: the nearest of a bounded list, the first of equally near ones."""
    if len(lanes) > MOST_KNOWN:
        raise ValueError("too many lanes")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(x) - v).alias("d"), F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(lanes)]))
    return df.withColumn("lane_index", best["i"]).withColumn("lane", best["v"])


def _grams(key: Column) -> Column:
    """The bigrams of a text, each with how often it came before, so that they are a set."""
    at = F.when(F.length(key) >= 2, F.sequence(F.lit(1), F.length(key) - 1)).otherwise(F.array().cast("array<int>"))
    plain = F.transform(at, lambda i: F.substring(key, i, F.lit(2)))
    return F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, 1, i), lambda h: h == g)).cast("string")))


def shared_grams(length: int, cut: float) -> int:
    """How many bigrams a text of this length shares at least with any that is alike by `cut`.

    A ratio r says that M = r T / 2 of the T characters of both match, in blocks that lie apart; between two blocks at least one of
    the T - 2 M characters without a match stands, so there are T - 2 M + 1 blocks at most, and a block of n characters is n - 1
    shared bigrams. That leaves 3 M - T - 1 shared ones; the other text's length is within r / (2 - r) of this one's."""
    low, high = ceil(length * cut / (2 - cut) - 1e-9), floor(length * (2 - cut) / cut + 1e-9)
    need = [3 * ceil(cut * (length + n) / 2 - 1e-9) - (length + n) - 1 for n in range(low, high + 1)]
    return max(1, min(need)) if need else length


MOST_LENGTH = 400  # of keys whose least shared bigrams are in the table; longer ones count as this long


def similar_keys(left: DataFrame, right: DataFrame, within: str, key: str, cut: float = 0.86) -> DataFrame:
    """Distinct (within, key, key_b, ratio) of all pairs of keys with a ratio of `cut` or more, none lost.

    A key stands under as many of its rarest bigrams as it can do without (length - 1 - shared_grams + 1), so alike keys meet under
    one of them at least; only keys that meet are compared. The bound holds for cuts of 0.75 and more, by which texts of four
    characters that are alike still share a bigram; keys of fewer characters are compared as equal ones only."""
    if cut < 0.75:
        raise ValueError("a cut under 0.75 has no bound on shared bigrams")
    need = F.array(*[F.lit(shared_grams(n, cut)) for n in range(MOST_LENGTH + 1)])
    sides = [df.select(within, key).where(F.col(key).isNotNull()).distinct() for df in (left, right)]
    grams = [df.select(within, key, F.explode(_grams(F.col(key))).alias("g")) for df in sides]
    often = written(grams[0].union(grams[1]).groupBy("g").agg(F.count(F.lit(1)).alias("n")).select(F.col("g").alias("_g"), "n"))  # a table has a true size

    def heads(df: DataFrame) -> DataFrame:
        rarest = df.join(often, F.col("g") == F.col("_g")).groupBy(within, key).agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("gs"))
        length = F.length(key)
        kept = F.when(length > MOST_LENGTH, F.size("gs")).otherwise(length - F.get(need, F.least(length, F.lit(MOST_LENGTH))))
        return rarest.select(within, key, F.explode(F.slice("gs", F.lit(1), F.greatest(F.lit(1), kept))).alias("x")).select(within, key, F.col("x.g").alias("g"))

    a, b = heads(grams[0]), heads(grams[1]).select(F.col(within).alias("_w"), F.col(key).alias("_k"), F.col("g").alias("_g"))
    total = F.length(key) + F.length("_k")
    # The characters without a match are the insertions and deletions that make one key of the other, which are no fewer than its
    # edits; so this loses no pair, and the ratio is left for few. It is worked out once a pair, in however many places it meets.
    near = (2 * F.least(F.length(key), F.length("_k")) >= F.lit(cut - 1e-9) * total) & (F.levenshtein(key, "_k") <= F.lit(1 - cut + 1e-9) * total)
    met = a.join(b.hint("merge"), (F.col(within) == F.col("_w")) & (F.col("g") == F.col("_g")) & near).select(within, key, F.col("_k").alias(f"{key}_b")).distinct()
    met = written(met)
    ratios = met.select(F.col(key).alias("_x"), F.col(f"{key}_b").alias("_y")).distinct().withColumn("ratio", similarity(F.col("_x"), F.col("_y")))
    alike = met.join(ratios.hint("merge"), (F.col(key) == F.col("_x")) & (F.col(f"{key}_b") == F.col("_y"))).where(F.col("ratio") >= cut).select(within, key, f"{key}_b", "ratio")
    short = sides[0].where(F.length(key) < 2).join(sides[1].where(F.length(key) < 2).select(F.col(within).alias("_w"), F.col(key).alias("_k")).hint("merge"), (F.col(within) == F.col("_w")) & (F.col(key) == F.col("_k")))
    return alike.union(short.select(within, key, F.col("_k"), F.lit(1.0)))


def similar_pairs(left: DataFrame, right: DataFrame, level: str, key: str, cut: float = 0.86, least: int = 4) -> DataFrame:
    """(J8) Rows of one level whose keys are alike: all pairs with a ratio of `cut` or more of keys of `least` characters or more. Each
    pair of different keys is compared once, however many rows hold them."""
    fit = lambda df: df.where(F.length(key) >= least)
    pairs = similar_keys(fit(left), fit(right), level, key, cut).select(F.col(level).alias("_l"), F.col(key).alias("_a"), F.col(f"{key}_b").alias("_b"), "ratio")
    b = fit(right).select(*[F.col(c).alias(f"{c}_b") for c in right.columns])
    # Rows may be many more than their tables' sizes tell, so neither side goes to the driver.
    one = fit(left).join(pairs.hint("merge"), (F.col(level) == F.col("_l")) & (F.col(key) == F.col("_a")))
    return one.join(b.hint("merge"), (F.col("_l") == F.col(f"{level}_b")) & (F.col("_b") == F.col(f"{key}_b"))).select(*left.columns, *b.columns, "ratio")


def anchor_votes(df: DataFrame, key: str, frame: str, level: str, label: str, conf: str, top: str, cut: float = 0.86, sure: float = 48.0, shift: int = 10) -> DataFrame:
    """(J8) (key, frame, shift, weight, label) of pairs of alike labels in a picture and the next one of its key: what moved up by
    more than `shift`, weighted by likeness and the lesser confidence. Labels under four characters or under `sure` take no part."""
    rows = df.select(F.concat_ws("\x1f", F.col(key).cast("string"), F.col(frame).cast("string"), F.col(level).cast("string")).alias("_place"), key, frame, label, conf, top).where(F.col(conf) >= sure)
    before = F.concat_ws("\x1f", F.col(key).cast("string"), (F.col(frame) - 1).cast("string"), F.col(level).cast("string"))
    later = df.where(F.col(conf) >= sure).select(before.alias("_place"), label, conf, top)
    pairs = similar_pairs(rows, later, "_place", label, cut)
    moved = F.bround(F.col(top) - F.col(f"{top}_b")).cast("int")
    return pairs.select(key, frame, moved.alias("shift"), (F.col("ratio") * F.least(conf, f"{conf}_b") / 100.0).alias("weight"), F.col(label).alias("label")).where(F.col("shift") > shift)


def anchor_shifts(df: DataFrame, key: str, frame: str, level: str, label: str, conf: str, top: str, bin_: float = 5.0, **kw) -> DataFrame:
    """(J8, A8) (key, frame, shift, weight, second) per picture with votes: the bin with most different labels, then most weight, and
    what all other bins weigh; shift is the bin's weighted mean if two labels and a weight of 0.8 agree, else null."""
    votes = anchor_votes(df, key, frame, level, label, conf, top, **kw)
    bins = votes.groupBy(key, frame, (F.bround(F.col("shift") / bin_) * bin_).cast("int").alias("bin")).agg(
        F.countDistinct("label").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("shift") * F.col("weight")).alias("xw")
    )
    best = bins.groupBy(key, frame).agg(F.max(F.struct("n", F.round("w", 9).alias("r"), (-F.col("bin")).alias("b"), "w", "xw")).alias("m"), F.sum("w").alias("all"))
    enough = (F.col("m.n") >= 2) & (F.col("m.w") >= 0.8)
    return best.select(key, frame, F.when(enough, F.bround(F.col("m.xw") / F.col("m.w")).cast("int")).alias("shift"), F.round("m.w", 6).alias("weight"), F.round(F.col("all") - F.col("m.w"), 6).alias("second"))


def update_from(rows: DataFrame, looked: DataFrame, key: str, pos: str, gate: Callable[[], Column], columns: dict[str, str]) -> DataFrame:
    """(J9, F14) Rows with columns overwritten from the last looked-up row of their key that passes the gate, where it has a value."""
    last = looked.where(gate()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*columns.values()), F.col(pos)).alias("_n"))
    joined = rows.join(last, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(F.col(f"_n.{columns[c]}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], F.col("_k").isNotNull().alias("updated"))


def known_only(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(J10)"""
    return df.join(known, key, "left_semi")


def missing(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(J11, U2)"""
    return known.join(found, key, "left_anti")


def _costs(letter: bool) -> Column:
    return F.create_map(*[F.lit(x) for a, b, c in (LETTER_COST if letter else DIGIT_COST) for x in (a + b, c)])


def char_cost(observed: Column, expected: Column, letter: Column) -> Column:
    """What one place of a code costs."""
    both = F.concat(observed, expected)
    digit = F.when(observed.between("0", "9") & expected.between("0", "9"), OTHER_DIGIT).otherwise(F.coalesce(F.try_element_at(_costs(False), both), F.lit(OTHER)))
    return F.when(observed == expected, 0.0).when(letter, F.coalesce(F.try_element_at(_costs(True), both), F.lit(OTHER))).otherwise(digit)


def window_cost(window: Column, code: Column, first: Column | int, lost: Column | float) -> Column:
    """What a window costs that stands for the places of a code from `first` on (counted from 1), and `lost` for the others. The cost of
    a place is one expression, walked over the places."""
    start = F.lit(first) if isinstance(first, int) else first
    at = F.sequence(F.lit(1), F.length(window))
    each = F.transform(at, lambda i: char_cost(F.substring(window, i, F.lit(1)), F.substring(code, i + start - 1, F.lit(1)), i + start - 2 == LETTER_PLACE))
    return F.aggregate(each, F.lit(0.0), lambda s, c: s + c) + lost


def _close_places(length: int) -> list[tuple[int, ...]]:
    """Choices of a code's places (from 1), of which a window of this length must be close in one to cost less than WORST: closer
    than OTHER_DIGIT, that is equal or a look-alike. A window of four stands for the last four places."""
    first, lost = (1, 0.0) if length == 5 else (2, LOST_ZERO)
    far = ceil((WORST - lost) / OTHER_DIGIT - 1e-9) - 1
    return list(combinations(range(first, 6), length - far))


def _close_codes(windows: DataFrame, known: DataFrame, window: str, code: str) -> DataFrame:
    """(window, code) of all pairs that may cost less than WORST, some more than once: by the characters of the places in which they
    are close, so it is an equi-join whatever the sizes. A code meets windows of four only if it begins with a zero."""
    looks = {letter: {} for letter in (False, True)}
    for letter, table in ((False, DIGIT_COST), (True, LETTER_COST)):
        for observed, expected, _ in table:
            looks[letter].setdefault(observed, []).append(expected)
    meant = {letter: F.create_map(*[x for o, e in of.items() for x in (F.lit(o), F.array(*[F.lit(c) for c in e]))]) for letter, of in looks.items()}
    name = lambda places: "".join(map(str, places)) + ":"

    def stands(place: int, first: int) -> Column:
        c = F.substring(window, place - first + 1, 1)
        return F.concat(F.array(c), F.coalesce(F.try_element_at(meant[place - 1 == LETTER_PLACE], c), F.array().cast("array<string>")))

    def longer(heads: Column, more: Column) -> Column:
        return F.flatten(F.transform(heads, lambda head: F.transform(more, lambda c: F.concat(head, c))))

    def of_window(places: tuple[int, ...], first: int) -> Column:
        return reduce(longer, [stands(p, first) for p in places], F.array(F.lit(name(places))))

    of_code = lambda places: F.concat(F.lit(name(places)), *[F.substring(code, p, 1) for p in places])
    asked = {n: F.flatten(F.array(*[of_window(p, 6 - n) for p in _close_places(n)])) for n in (4, 5)}
    w = windows.select(window, F.explode(F.when(F.length(window) == 5, asked[5]).otherwise(asked[4])).alias("_k"))
    held = {n: F.array(*[of_code(p) for p in _close_places(n)]) for n in (4, 5)}
    c = known.select(code, F.explode(F.when(F.startswith(F.col(code), F.lit("0")), F.concat(held[5], held[4])).otherwise(held[5])).alias("_c"))
    return w.join(c.hint("merge"), F.col("_k") == F.col("_c")).select(window, code)


def code_scores(readings: DataFrame, known: DataFrame, key: str, text: str, code: str = "code") -> DataFrame:
    """(J12, A9) (key, code, score): windows of five and (a zero lost) four characters of each reading against every known code; the
    least cost gives a reading's score, and two good readings a little more. Each text is compared once, however many readings
    have it, and only with the codes it can score with, so dictionaries may be of any size. Keys with the same readings are
    scored once: readings times the codes they resemble are the result."""
    compact = F.regexp_replace(F.upper(F.coalesce(F.col(text), F.lit(""))), "[^A-Z0-9|]", "")
    cut = lambda n: F.when(F.length("_s") >= n, F.transform(F.sequence(F.lit(1), F.length("_s") - (n - 1)), lambda i: F.substring("_s", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    each = readings.groupBy(key, compact.alias("_s")).agg(F.count(F.lit(1)).alias("times"))
    own = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_s", "times"))).alias("_r"))
    sets = own.select("_r").distinct().select("_r", F.explode("_r").alias("_x")).select("_r", F.col("_x._s").alias("_s"), F.col("_x.times").alias("times"))
    parts = sets.select("_s").distinct().select("_s", F.explode(F.array_distinct(F.concat(cut(5), cut(4)))).alias("w"))
    pairs = _close_codes(parts.select("w").distinct(), known.select(code).distinct(), "w", code)
    short = F.length("w") == 4
    cost = window_cost(F.col("w"), F.col(code), F.when(short, 2).otherwise(1), F.when(short, LOST_ZERO).otherwise(0.0))
    # What costs as much as a code that shares nothing scores nothing, with whatever window.
    scored = pairs.distinct().select(F.col("w").alias("_w"), code, cost.alias("cost")).where(F.col("cost") < WORST)
    one = parts.join(scored.hint("merge"), F.col("w") == F.col("_w")).groupBy(F.col("_s").alias("_t"), code).agg(F.min("cost").alias("cost")).withColumn("score", F.greatest(F.lit(0.0), 1.0 - F.col("cost") / WORST))
    many = sets.join(one.hint("merge"), F.col("_s") == F.col("_t"))
    total = many.groupBy("_r", code).agg(F.max("score").alias("_b"), F.sum(F.when(F.col("score") >= 0.72, F.col("times")).otherwise(0)).alias("_n"))
    total = total.select(F.col("_r").alias("_q"), code, F.round(F.when(F.col("_n") >= 2, F.least(F.lit(1.0), F.col("_b") + 0.06)).otherwise(F.col("_b")), 9).alias("score")).where("score > 0")
    return own.join(total.hint("merge"), F.col("_r") == F.col("_q")).select(key, code, "score")


def lookup_enum(df: DataFrame, x: Column, exact: dict[str, str], fragments: Sequence[tuple[str, str]], out: str = "symbol") -> DataFrame:
    """(J13) Display name of a type: its exact key, else the first fragment it contains, else empty."""
    k = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")
    name = F.when(k == "", "")
    for a, b in exact.items():
        name = name.when(k == "".join(c for c in a.lower() if c.isalnum()), b)
    for a, b in fragments:
        name = name.when(k.contains(a), b)
    return df.withColumn(out, name.otherwise(""))


def canonical_label(df: DataFrame, text: str, labels: Sequence[str], cut: float = 0.82) -> DataFrame:
    """(J14) Add canonical: the label most like the text (by folded key), with the text's instance number, if it is alike from `cut` on
    and of similar length; else the text. The first of equally like labels wins."""
    spark = df.sparkSession
    if len(labels) > MOST_KNOWN:
        raise ValueError("too many labels")
    dim = F.broadcast(spark.createDataFrame(list(enumerate(labels)), "li int, label string")).withColumn("lk", label_key(F.col("label")))
    keys = df.select(text).distinct().withColumn("tk", label_key(F.col(text)))
    # A ratio of `cut` needs 2 min / (a + b) of the lengths to reach it, so other labels can be left out before the choice.
    alike = 2 * F.least(F.length("tk"), F.length("lk")) >= cut * (F.length("tk") + F.length("lk"))
    near = keys.join(dim, (F.length("tk") >= 4) & alike)
    scored = near.withColumn("ratio", similarity(F.col("tk"), F.col("lk"))).where(F.col("ratio") >= cut)
    best = scored.groupBy(F.col(text).alias("_t"), "tk").agg(F.max(F.struct("ratio", (-F.col("li")).alias("o"), "label", "lk")).alias("_b"))
    best = best.where(F.abs(F.length("tk") - F.length("_b.lk")) <= F.greatest(F.lit(3), F.floor(F.length("tk") / 4))).drop("tk")
    suffix = F.replace(F.regexp_extract(F.trim(text), r"(\s*\.?\s*[0-9]+)$", 1), F.lit(" "), F.lit(""))
    return df.join(best, F.col(text) == F.col("_t"), "left").withColumn("canonical", F.coalesce(F.concat(F.col("_b.label"), suffix), F.trim(text))).withColumn("ratio", F.col("_b.ratio")).drop("_t", "_b")


def find_target(df: DataFrame, text: str, pos: str, label: str, cut: float = 0.86) -> DataFrame:
    """(J15) The rows of the best tier: same key, else alike within 0.001 of the best, else containing it. One row is a find,
    more are an ambiguity, which `unique` shows."""
    want = label_key(F.lit(label))
    keyed = df.withColumn("_k", label_key(F.col(text))).withColumn("ratio", similarity(F.col("_k"), want))
    tier = F.when(F.col("_k") == want, 1).when(F.col("ratio") >= cut, 2).when(F.col("_k").contains(want), 3)
    hits = keyed.withColumn("tier", tier).where("tier IS NOT NULL")
    best = hits.groupBy("tier").agg(F.max("ratio").alias("top")).agg(F.min(F.struct("tier", "top")).alias("_b")).select("_b.*")
    chosen = hits.join(F.broadcast(best.select(F.col("tier").alias("bt"), "top")), (F.col("tier") == F.col("bt")) & ((F.col("tier") != 2) | (F.col("ratio") >= F.col("top") - 0.001)))
    return chosen.withColumn("unique", F.count(F.lit(1)).over(Window.partitionBy("tier")) == 1).select(pos, text, "tier", "ratio", "unique")


def sibling_by_suffix(df: DataFrame, known: DataFrame, suffix: str, prefix: str, code: str = "code") -> DataFrame:
    """(J19) The known code that ends with a suffix and begins with a prefix, accepted only when it is the only one. Repeated rows are
    resolved each."""
    asked = df.select(F.col(suffix).alias("_s"), F.col(prefix).alias("_p")).distinct()
    hit = asked.join(small(known.select(code).distinct()), F.endswith(F.col(code), F.col("_s")) & F.startswith(F.col(code), F.col("_p")))
    only = hit.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_n"), F.min(code).alias("resolved")).where("_n = 1").drop("_n")
    return df.join(only, (F.col(suffix) == F.col("_s")) & (F.col(prefix) == F.col("_p"))).drop("_s", "_p")


def union_if_empty(first: DataFrame, second: DataFrame) -> DataFrame:
    """(U3) The second source where the first has no rows."""
    return second if first.isEmpty() else first


def rescue(known: DataFrame, key: str, passes: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(U4) Passes in turn, each over the keys that none before has found; rows get `pass` from 1."""
    found = None
    for i, run in enumerate(passes, 1):
        open_ = known if found is None else missing(known, found.select(key), key)
        rows = run(open_).withColumn("pass", F.lit(i))
        found = rows if found is None else found.unionByName(rows)
    return found


def loosest_match(df: DataFrame, selection: str, text: str, code: str) -> DataFrame:
    """(S23) Per selection the rows of the strictest tier with any: equal, prefix, infix."""
    tier = F.when(F.col(text) == F.col(code), 1).when(F.startswith(F.col(text), F.col(code)), 2).when(F.col(text).contains(F.col(code)), 3)
    hit = df.withColumn("tier", tier).where("tier IS NOT NULL")
    best = hit.groupBy(F.col(selection).alias("_s")).agg(F.min("tier").alias("_t"))
    return hit.join(best, (F.col(selection) == F.col("_s")) & (F.col("tier") == F.col("_t"))).drop("_s", "_t")
