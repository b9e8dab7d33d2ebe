"""Decisions from many readings: recovery of codes, votes on tolerances, conflicts of structure, completion, registration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import text as X
from ..functions.text import KEYWORDS, fold_key, or_empty, plain_number, plain_upper, plausibility
from ..sources.folders import written
from .match import LOST_ZERO, WORST, small, window_cost

FRAGMENT_WORST, FIRST_LOST, LAST_LOST = 2.2, 0.12, 0.14  # fixed values of T6
DECIMAL = r"(?<![0-9])([0-9]{1,2}\.[0-9]{1,2})(?![0-9])"


def code_evidence(df: DataFrame, key: Sequence[str], text: str, others: str) -> DataFrame:
    """(A23) A row per row of df and code: key, pos (order of appearance), code, score. Null texts have none."""
    options = C.readings(F.col(text), F.col(others))
    return df.select(*key, F.posexplode(C.code_evidence(options)).alias("pos", "e")).select(*key, "pos", F.col("e.code").alias("code"), F.round("e.score", 6).alias("score"))


def recover_codes(df: DataFrame, text: str, others: str, parent: str) -> DataFrame:
    """(X23) Add recovered (the text, its code put right) and marker (why; empty where unchanged).

    A code as printed stays, at most without what stands around it. Elsewhere the repeat in parentheses decides, then, where the
    reading ends in five digits, the best other code, else the reading's own code if no evidence is better. Only compact
    displays under parents that hold codes change. Codes of equal score go by order of appearance."""
    own = or_empty(F.col(text))
    s = df.withColumn("_e", C.code_evidence(C.readings(F.col(text), F.col(others)))).withColumn("_own", F.get(C.codes_like(own), F.lit(0))).withColumn("_again", F.get(C.codes_like(C.inside(own)), F.lit(0)))
    compact = F.regexp_replace(plain_upper(C.head(own)), "[^A-Z0-9]", "")
    s = s.withColumn("_digits", F.regexp_extract(compact, "[0-9]{5}$", 0)).withColumn("_strict", C.strict_head(own))
    s = s.withColumn("_shape", F.when(F.col("_digits") != "", F.col("_digits")).otherwise(compact)).withColumn("_most", F.array_max(F.transform("_e", lambda e: e["score"])))
    best = lambda keep: F.filter("_e", lambda e: keep(e))

    def first_best(pool: Column) -> Column:
        return C.let(pool, lambda p: C.let(F.array_max(F.transform(p, lambda e: e["score"])), lambda m: F.get(F.filter(p, lambda e: e["score"] == m), F.lit(0))["code"]))

    repeated = F.col("_own").isNotNull() & F.col("_again").isNotNull() & ~F.col("_strict")
    other = F.coalesce(first_best(best(lambda e: ~e["code"].eqNullSafe(F.col("_own")))), first_best(F.col("_e")))
    held = F.exists("_e", lambda e: (e["code"] == F.col("_own")) & (e["score"] == F.col("_most")))
    choice = F.when(repeated, F.col("_again")).when(F.col("_digits") != "", other).when(held, F.col("_own")).otherwise(first_best(F.col("_e")))
    malformed = F.col("_shape").rlike("^[A-Z0-9]{2,6}$") & ((F.col("_shape").rlike("[A-Z]") & F.col("_shape").rlike("[0-9]")) | F.col("_shape").rlike("^[0-9]{5}$"))
    s = s.withColumn("_choice", choice).withColumn("_again", repeated)
    within, shown = C.has_code_parent(F.col(parent)), C.is_code_display(own)
    open_ = ~F.col("_strict") & within & (malformed | shown)
    enough = F.col("_own").isNotNull() | (F.size("_e") == 1) | (F.col("_most") >= 3)
    same = F.col("_own").eqNullSafe(F.col("_choice"))
    code = F.when(F.size("_e") == 0, None).when(F.col("_strict") & within & shown, F.col("_own")).when(open_ & (same | enough), F.col("_choice"))
    s = s.withColumn("recovered", F.coalesce(C.with_code(own, code), own))
    why = F.when(F.col("_strict") | same, "identifier_normalised").when(F.col("_again"), "identifier_from_repeated_display").otherwise("identifier_from_alternatives")
    out = s.withColumn("marker", F.when(F.col("recovered") != own, why).otherwise(""))
    return out.drop("_e", "_own", "_again", "_digits", "_strict", "_shape", "_most", "_choice")


def code_score(text: Column, code: Column) -> Column:
    """How well the best window of a text reads as a code, 0 to 1, as in match.code_scores."""
    compact = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9|]", "")

    def windows(s: Column, n: int) -> Column:
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def cost(w: Column, lost: int) -> Column:
        return window_cost(w, code, 1 + lost, LOST_ZERO * lost)

    def least(s: Column) -> Column:
        short = F.when(F.startswith(code, F.lit("0")), F.transform(windows(s, 4), lambda w: cost(w, 1))).otherwise(F.array().cast("array<double>"))
        return F.array_min(F.concat(F.transform(windows(s, 5), lambda w: cost(w, 0)), short))

    return F.round(F.coalesce(F.greatest(F.lit(0.0), 1.0 - C.let(compact, least) / WORST), F.lit(0.0)), 9)


def _without_code(line: Column, code: Column, cut: float = 0.70) -> Column:
    """A line with blanks for its tokens of four to eight characters that read as the code."""
    parts = F.split(F.regexp_replace(line, "(?i)([A-Z0-9|]{4,8})", "\x01$1\x01"), "\x01")
    blank = lambda p, i: F.when((i % 2 == 1) & (code_score(p, code) >= cut), F.repeat(F.lit(" "), F.length(p))).otherwise(p)
    return F.when(F.coalesce(code, F.lit("")) == "", line).otherwise(F.array_join(F.transform(parts, blank), ""))


def _numbers(found: Column, worth: Column) -> Column:
    return F.transform(found, lambda t: F.struct(F.round(t.try_cast("double"), 3).alias("v"), worth.alias("w")))


def standard_tolerance(df: DataFrame, key: str, pos: str, text: str, code: str, most: float = 999.0) -> DataFrame:
    """(A21) (key, value, confidence) by vote over a key's readings in order of pos and then text, the first weighing 1 and others 0.85: numbers
    in a cell before the cell of A (1.45), decimals anywhere (1.12), and of a line with an A cell the last small whole
    number before it, codes blanked (0.82). A decimal gains 0.45 of its own whole part. Of equal sums the earliest wins."""
    # A reading's number in its key stands for its place and text from here on, so votes and sums are numbers only, which
    # partial sums and a hash table hold; what is read off a text is worked out after its rows are sorted, and not moved.
    ranked = df.select(key, F.col(code).alias("_c"), F.col(text).alias("_t"), F.row_number().over(Window.partitionBy(key).orderBy(pos, text)).alias("_n"))
    plain = ranked.select(key, "_c", "_n", plain_number(F.col("_t")).alias("_s"), F.when(F.col("_n") == 1, 1.0).otherwise(0.85).alias("_w"))
    cells = F.transform(F.regexp_extract_all("_s", F.lit(r"(?i)[|/\\)\]\[}>-]\s*([0-9IL]{1,2}(?:\.[0-9]{1,2})?)\s*[|/\\)\]\[}>-]+\s*A"), F.lit(1)), lambda t: F.translate(t, "IL", "11"))
    decimals = F.regexp_extract_all("_s", F.lit(DECIMAL), F.lit(1))

    def last_whole(line: Column) -> Column:
        before = F.regexp_extract(line, r"(?is)^(.*?)[|/\\)\]\[]\s*A", 1)
        fit = F.filter(F.regexp_extract_all(before, F.lit(r"(?<![0-9])([0-9]{1,2})(?![0-9])"), F.lit(1)), lambda n: n.cast("int").between(1, int(most)))
        return F.when(~line.rlike(r"[0-9]+[ \t]*X|X[ \t]*[0-9]+") & (F.size(fit) > 0), F.element_at(fit, -1))

    lines = F.split(F.translate(_without_code(F.col("_s"), F.col("_c")), "IL", "11"), "\n")
    wholes = F.array_compact(F.transform(lines, last_whole))
    votes = F.concat(_numbers(cells, F.col("_w") * 1.45), _numbers(decimals, F.col("_w") * 1.12), _numbers(wholes, F.col("_w") * 0.82))
    each = plain.select(key, "_n", F.posexplode(votes).alias("_i", "_v")).select(key, F.shiftleft(F.col("_n").cast("long"), 32).bitwiseOR(F.col("_i").cast("long")).alias("o"), "_v.*")
    sums = each.where((F.col("v") > 0) & (F.col("v") <= most)).groupBy(key, "v").agg(F.sum("w").alias("w"), F.min("o").alias("o"))
    by = Window.partitionBy(key, F.floor("v"))
    whole = F.max(F.when(F.col("v") % 1 == 0, F.col("w"))).over(by)
    total = F.round(F.col("w") + F.when(F.col("v") % 1 != 0, F.coalesce(whole, F.lit(0.0)) * 0.45).otherwise(0.0), 9)
    best = sums.withColumn("t", total).groupBy(key).agg(F.min(F.struct((-F.col("t")).alias("t"), "o", "v")).alias("m"))
    return best.select(key, F.col("m.v").alias("value"), F.round(F.least(F.lit(0.99), 0.60 - F.col("m.t") / 4.0), 6).alias("confidence"))


def conditional_tolerance(df: DataFrame, key: str, pos: str, text: str, most: float = 999.0) -> DataFrame:
    """(A22) (key, value, confidence): of what stands before a comparison or a condition's keyword, decimals and the last whole number
    that stands alone vote; any decimal outdoes whole numbers, then the commonest wins, then the earliest in order of pos and text."""
    plain = plain_number(F.col(text))
    cuts = [F.nullif(F.locate(k, plain), F.lit(0)) for k in ("<", ">", *KEYWORDS)]
    own = df.select(key, pos, F.col(text).alias("_x"), F.substring(plain, F.lit(1), F.coalesce(F.least(*cuts) - 1, F.length(plain))).alias("_s"))
    fits = lambda n: (n.cast("double") > 0) & (n.cast("double") <= most)
    wholes = F.filter(F.regexp_extract_all("_s", F.lit("(?i)(?<![A-Z0-9])([0-9]{1,2})(?![A-Z0-9])"), F.lit(1)), fits)
    votes = F.concat(F.filter(F.regexp_extract_all("_s", F.lit(DECIMAL), F.lit(1)), fits), F.when(F.size(wholes) > 0, F.slice(wholes, -1, 1)).otherwise(F.array().cast("array<string>")))
    each = own.select(key, pos, "_x", F.posexplode(votes).alias("_i", "_t")).select(key, F.struct(pos, "_x", "_i").alias("o"), F.round(F.col("_t").cast("double"), 3).alias("v"))
    sums = each.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    best = sums.groupBy(key).agg(F.min(F.struct((F.col("v") % 1 == 0).alias("whole"), (-F.col("n")).alias("n"), "o", "v")).alias("m"))
    return best.select(key, F.col("m.v").alias("value"), F.when(F.col("m.whole"), 0.90).otherwise(0.96).alias("confidence"))


def lane_conflicts(df: DataFrame, key: str, pos: str, lane: str, text: str, conf: str, method: str, partial: str, near: float = 7.0) -> DataFrame:
    """(C2) Per key with a whole observation: the lane of its best one (confidence, plausibility, 3 for lines; the earliest of equal
    ones) and whether whole observations of another lane come within `near` of it with a text that is not the end of the
    best one's, nor the other way round."""
    score = F.round(F.col(conf) + plausibility(F.col(text)) + F.when(F.startswith(F.col(method), F.lit("line_")), 3.0).otherwise(0.0), 6)
    own = df.select(key, pos, F.col(lane).alias("_l"), F.coalesce(F.col(partial), F.lit(False)).alias("_p"), score.alias("_s"), fold_key(F.col(text)).alias("_n"))
    best = own.groupBy(key).agg(F.min(F.struct((-F.col("_s")).alias("s"), pos, F.col("_l").alias("lane"), F.col("_n").alias("norm"))).alias("_b"))
    end = (F.col("_n") != "") & (F.col("_b.norm") != "") & (F.endswith(F.col("_n"), F.col("_b.norm")) | F.endswith(F.col("_b.norm"), F.col("_n")))
    against = (F.col("_l") != F.col("_b.lane")) & ~end & (F.col("_s") >= -F.col("_b.s") - near)
    return own.where("NOT _p").join(best, key).groupBy(key).agg(F.first("_b.lane").alias("lane"), F.countDistinct("_l").alias("lanes"), (F.bool_or(against) & (F.countDistinct("_l") > 1)).alias("conflict"))


def complete_fragments(df: DataFrame, known: DataFrame, key: str, text: str, code: str = "code") -> DataFrame:
    """(T6) (key, code, score): a code that lost its first or last character, completed where exactly one known code fits a fragment
    of four (0.82, and 0.18 before the next). The best fragment decides, the first of equal ones; keys without one have no row.
    Known codes of other lengths than five take no part."""
    compact = F.regexp_replace(F.upper(F.coalesce(F.col(text), F.lit(""))), "[^A-Z0-9]", "")
    cut = F.when(F.length(compact) >= 4, F.transform(F.sequence(F.lit(1), F.length(compact) - 3), lambda i: F.substring(compact, i, F.lit(4))))
    spots = df.select(key, F.posexplode(cut).alias("_i", "_f")).groupBy(key, "_i").agg(F.array_sort(F.collect_set("_f")).alias("_fs"))
    # What stands at a place is compared with the codes once, however many keys have it.
    pairs = spots.select("_fs").distinct().select("_fs", F.explode("_fs").alias("_f")).join(small(known.where(F.length(code) == 5).select(code).distinct()))

    def fit(lost_first: bool) -> Column:
        cost = window_cost(F.col("_f"), F.col(code), 2 if lost_first else 1, FIRST_LOST if lost_first else LAST_LOST)
        return F.round(F.greatest(F.lit(0.0), 1.0 - cost / FRAGMENT_WORST), 9)

    fair = pairs.withColumn("_s", F.greatest(fit(True), fit(False))).where("_s >= 0.78").groupBy("_fs", code).agg(F.max("_s").alias("_s"))
    top = fair.groupBy("_fs").agg(F.max(F.struct("_s", code)).alias("_b"), F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("_s"), asc=False).alias("_all"))
    clear = (F.col("_b._s") >= 0.82) & ((F.col("_n") == 1) | (F.round(F.col("_b._s") - F.get("_all", F.lit(1)), 9) >= 0.18))
    found = spots.join(top.where(clear).select(F.col("_fs").alias("_g"), "_b"), F.col("_fs") == F.col("_g"))
    best = found.groupBy(key).agg(F.min(F.struct((-F.col("_b._s")).alias("s"), "_i", F.col(f"_b.{code}").alias("c"))).alias("m"))
    return best.select(key, F.col("m.c").alias(code), (-F.col("m.s")).alias("score"))


def repair_labels(df: DataFrame, text: str, parent: str, reasons: str) -> DataFrame:
    """(X24) Capture and reference labels put right in place, each change with its marker among the row's reasons (an array)."""
    capture = C.capture_label(F.col(text), F.col(parent))
    one = df.withColumn("_t", capture).withColumn("_r", X.with_reason(F.col(reasons), "capture_label_from_structure", capture != or_empty(F.col(text))))
    reference = C.reference_label(F.col("_t"), F.col(parent))
    both = one.withColumn("_u", reference).withColumn("_r", X.with_reason(F.col("_r"), "reference_label_normalised", reference != F.col("_t")))
    return both.select(*[F.col({text: "_u", reasons: "_r"}.get(c, c)).alias(c) for c in df.columns])


def locate_code(df: DataFrame, key: str, line: str, code: str, text: str, box: tuple[str, str, str, str], words: int = 4) -> DataFrame:
    """(J18) (key, score, left, top, right, bottom): the run of one to four neighbouring words of a line that reads most like the key's
    code (0.99 at least where it holds it), and the box around it. Of equal runs the first line's, the shortest, the leftmost."""
    left, top, width, height = box
    w = Window.partitionBy(key, line).orderBy(left, top, text)
    item = F.struct(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(left).alias("x"), F.col(top).alias("y"), (F.col(left) + F.col(width)).alias("r"), (F.col(top) + F.col(height)).alias("b"))
    names = [f"_w{k}" for k in range(words)]
    # All of a key go to one task, which sorts them once for its lines and for the choice.
    rows = df.repartition(key).select(key, line, code, F.row_number().over(w).alias("_i"), item.alias(names[0]), *[F.lead(item, k).over(w).alias(names[k]) for k in range(1, words)])

    def run(n: int) -> Column:
        """The first n words from here on, if the line has as many: what they read and the box around them."""
        own = [F.col(c) for c in names[:n]]
        edge = lambda of, c: of(*[v[c] for v in own]) if n > 1 else own[0][c]
        box = F.struct(edge(F.least, "x").alias("left"), edge(F.least, "y").alias("top"), edge(F.greatest, "r").alias("right"), edge(F.greatest, "b").alias("bottom"))
        return F.when(own[-1].isNotNull(), F.struct(F.lit(n).alias("n"), F.concat(*[v["t"] for v in own]).alias("j"), box.alias("b")))

    each = rows.select(key, line, code, "_i", F.explode(F.array_compact(F.array(*[run(n) for n in range(1, words + 1)]))).alias("_r"))
    each = each.select(key, line, code, "_i", F.col("_r.n").alias("_n"), F.col("_r.j").alias("_j"), F.col("_r.b").alias("_b"))
    holds = F.regexp_replace(F.upper("_j"), "[^A-Z0-9|]", "").contains(F.col(code))
    # What runs read is compared with a code once, however many read it. As a table the answers have a true size, by which Spark
    # joins them without moving the runs where they are few.
    read = each.select("_j", code).where(F.col(code).isNotNull()).distinct().withColumn("_s", F.greatest(code_score(F.col("_j"), F.col(code)), F.when(holds, 0.99).otherwise(0.0)))
    read = written(read.select(F.col("_j").alias("_k"), F.col(code).alias("_c"), "_s"))
    each = each.join(read.where("_s > 0"), (F.col("_j") == F.col("_k")) & (F.col(code) == F.col("_c")))
    best = each.groupBy(key).agg(F.min(F.struct((-F.col("_s")).alias("s"), line, "_n", "_i", F.col("_b").alias("b"))).alias("m"))
    return best.select(key, (-F.col("m.s")).alias("score"), "m.b.*")


def register(df: DataFrame, before: str, after: str, least: int, overlap: int, apart: int = 10, cut: float = 0.22, margin: float = 0.015) -> DataFrame:
    """(W10, T8) Add shift, score and second: the shift (of at least `least` either way, `overlap` values left) at which two profiles
    of a row correlate best, and the best further than `apart` from it (-1 without one). The shift is null unless the score is
    `cut` and `margin` above the second. Of equal scores the greatest shift is taken."""
    far = F.least(F.size(before), F.size(after)) - overlap
    either = F.when(far >= least, F.flatten(F.transform(F.sequence(F.lit(least), far), lambda k: F.array(k, -k)))).otherwise(F.array().cast("array<int>"))
    s = df.withColumn("_c", F.transform(either, lambda k: F.struct(F.round(C.overlap_correlation(F.col(before), F.col(after), k), 9).alias("s"), k.alias("k")))).withColumn("_b", F.array_max("_c"))
    s = s.withColumn("score", F.coalesce(F.col("_b.s"), F.lit(-1.0)))
    s = s.withColumn("second", F.coalesce(F.array_max(F.transform(F.filter("_c", lambda c: F.abs(c["k"] - F.col("_b.k")) > apart), lambda c: c["s"])), F.lit(-1.0)))
    clear = (F.col("score") >= cut) & (F.round(F.col("score") - F.col("second"), 9) >= margin)
    return s.withColumn("shift", F.when(clear, F.col("_b.k"))).drop("_c", "_b")


def prefix_words(words: DataFrame, key: str, left: str, width: str, text: str, first: Column, lane: Column, step: Column) -> DataFrame:
    """(W14) (key, prefix, prefix_left): of the words before a label's first, the last that has a digit, at most ten letters and digits,
    stands one lane to the left and touches the label. Of words at one place the greatest text is taken."""
    compact = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z0-9]", "")
    lane_before = F.abs(F.col(left) - (lane - step)) <= F.greatest(F.lit(9.0), step * 0.36)
    touches = F.col(left) + F.col(width) >= first - F.greatest(F.lit(8.0), F.bround(step * 0.40))
    fit = words.where((F.col(left) < first) & lane_before & touches & compact.rlike("[0-9]") & (F.length(compact) <= 10))
    return fit.groupBy(key).agg(F.max(F.struct(left, text)).alias("_m")).select(key, F.col(f"_m.{text}").alias("prefix"), F.col(f"_m.{left}").alias("prefix_left"))


def median_or(df: DataFrame, key: str, x: str, default: float) -> DataFrame:
    """(A4) The median of a key's values, or the default where it has none."""
    return df.groupBy(key).agg(F.coalesce(F.median(x), F.lit(default)).alias("median"))


def or_flags(left: DataFrame, right: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """(U6) Rows of the left with every flag that either side has; nothing is taken away. Rows of the right that share a key count
    together."""
    seen = right.groupBy(F.col(key).alias("_k")).agg(*[F.bool_or(c).alias(f"_{c}") for c in flags])
    both = left.join(seen, F.col(key) == F.col("_k"), "left")
    return both.select(*[(F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"_{c}"), F.lit(False))).alias(c) if c in flags else F.col(c) for c in left.columns])
