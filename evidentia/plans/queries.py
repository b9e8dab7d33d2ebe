"""Operators bound to tables. `table(name)` gives a table of the scale factor's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import numbers as N
from ..functions import text as X
from ..operators import evidence, greedy, lines, match, review, tree, votes
from ..sources import readers

REGISTERED: dict = {}
LEVELS = 5


def query(fn):
    REGISTERED[fn.__name__] = lambda spark, sf_dir: fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
    return fn


def _obs(t) -> DataFrame:
    return t("events").select("user_id", (F.floor("value") / 2).alias("v"), (F.col("event_id") % 100 / 100).alias("conf"), F.col("event_id").alias("pos"), "event_type", "value")


def _talk(t) -> DataFrame:
    return t("conversations").select("conv_id", "turn", "role", ((F.col("conv_id") * 7 + F.col("turn") * 3) % LEVELS).cast("int").alias("level"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query
def vote_consensus(t, spark):
    return _round(votes.consensus(_obs(t), "user_id", "v", "conf", "pos"))


@query
def vote_consensus_conflict(t, spark):
    return _round(votes.consensus(_obs(t), "user_id", "v", "conf", "pos", conflicts=True))


@query
def vote_flags_union(t, spark):
    return votes.flags_union(t("events"), "user_id", {c: (F.col("event_type") == n) & (F.col("value") > 100) for c, n in (("A", "click"), ("B", "view"), ("C", "error"))})


@query
def vote_mode_tie_smallest(t, spark):
    return votes.mode_smallest(t("lineitem"), "l_suppkey", "l_quantity")


@query
def vote_strict_majority(t, spark):
    return votes.strict_majority(t("lineitem"), "l_suppkey", "l_quantity")


@query
def vote_histogram_shift(t, spark):
    o = t("orders").select("o_custkey", "o_totalprice", "o_orderkey", ((F.col("o_orderkey") % 10 + 1) / 10).alias("w"))
    return votes.histogram_vote(o, "o_custkey", "o_totalprice", "o_orderkey", "w", 50000.0)


@query
def keep_best_first_on_tie(t, spark):
    return votes.keep_best(t("events").select("user_id", F.floor("value").cast("double").alias("value"), "event_id", "event_type"), "user_id", "value", "event_id")


@query
def rank_margin_accept(t, spark):
    c = t("part").groupBy("p_size", "p_brand").agg((F.count(F.lit(1)) / 10).alias("score"))
    return votes.accept_by_margin(c, "p_size", "p_brand", "score", 0.9, 0.3, 0.1)


@query
def confirmed_best_score(t, spark):
    e = t("events").select("user_id", "event_type", (F.floor("value") / 500).alias("s"))
    return _round(votes.confirmed_best(e, ["user_id", "event_type"], "s", 0.3))


@query
def numeric_reading_vote(t, spark):
    r = t("lineitem").select("l_suppkey", F.format_string("%dX %s", F.col("l_linenumber"), F.replace(F.col("l_tax").cast("string"), F.lit("."), F.lit(","))).alias("txt"), (F.col("l_linenumber") / 10).alias("w"))
    return votes.numeric_vote(r, "l_suppkey", "txt", "w")


@query
def evidence_text_choice(t, spark):
    e = t("events").select("user_id", F.upper("event_type").alias("norm"), F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("txt"), F.floor(F.col("value") / 10).cast("double").alias("s"), (F.col("event_id") % 7).alias("image"), "event_id")
    return votes.text_choice(e, "user_id", "norm", "txt", "s", "image", "event_id")


@query
def island_clusters(t, spark):
    return tree.clusters(t("orders").select("o_orderpriority", F.col("o_totalprice").cast("int").alias("x")), "o_orderpriority", "x", 200)


@query
def segment_offsets(t, spark):
    e = t("events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.floor("value").cast("double")).alias("shift"))
    return tree.segment_offsets(e, "user_id", "event_id", "shift")


@query
def nearest_lane(t, spark):
    return match.nearest(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_quantity", [2, 7, 12, 18, 22, 28, 33, 39, 44, 50])


@query
def interval_assign(t, spark):
    bands = spark.createDataFrame([(i, 40000.0 * i + 1000, 40000.0 * i + 45000, f"band{i}") for i in range(12)], "ord int, low double, high double, name string")
    return match.interval_join(t("orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", "ord", 50000.0, ["name"])


@query
def tree_parents(t, spark):
    return tree.parents(_talk(t), "conv_id", "turn", "level", LEVELS).select("conv_id", "turn", "level", "parent_pos", "hierarchy_status")


@query
def tree_paths(t, spark):
    return tree.paths(_talk(t).withColumn("name", F.concat_ws(":", "role", "turn")), "conv_id", "turn", "level", LEVELS, "name").select("conv_id", "turn", "full_path")


@query
def tree_descendants(t, spark):
    e = tree.parents(_talk(t), "conv_id", "turn", "level", LEVELS).select((F.col("conv_id") * 100 + F.col("turn")).alias("child"), (F.col("conv_id") * 100 + F.col("parent_pos")).alias("parent"))
    roots = e.where("parent IS NULL").select(F.col("child").alias("node"))
    return tree.descendants(e, "child", "parent", roots)


@query
def region_paths(t, spark):
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    c = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("name"))
    return tree.recursive_paths(r.union(n).union(c), "node", "parent", "name")


@query
def nearest_ancestor(t, spark):
    return tree.nearest_ancestor(_talk(t), "conv_id", "turn", "level", LEVELS, "role", lambda r: r == "user").select("conv_id", "turn", "nearest_pos")


@query
def sibling_order(t, spark):
    return tree.sibling_order(t("nation").select("n_nationkey", "n_regionkey"), "n_regionkey", "n_nationkey")


@query
def promote_siblings(t, spark):
    e = tree.parents(_talk(t), "conv_id", "turn", "level", LEVELS).select((F.col("conv_id") * 100 + F.col("turn")).alias("node"), (F.col("conv_id") * 100 + F.col("parent_pos")).alias("parent"), "level")
    return tree.promote(e, "node", "parent", "level")


@query
def level_clamp(t, spark):
    return tree.clamp_levels(_talk(t), "conv_id", "turn", "level").select("conv_id", "turn", "clamped")


@query
def outlier_flatten(t, spark):
    return tree.flatten_outliers(_talk(t).withColumn("level", F.col("level") % 2), "conv_id", "turn", "level").select("conv_id", "turn", "flat")


@query
def section_fill(t, spark):
    return tree.fill_section(_talk(t), "conv_id", "turn", F.col("level") == 0, "role").select("conv_id", "turn", "section")


@query
def first_boundary(t, spark):
    return tree.first_boundary(_talk(t), "conv_id", "turn", "level", 0)


@query
def orphan_duplicate_drop(t, spark):
    e = tree.parents(_talk(t), "conv_id", "turn", "level", LEVELS).select((F.col("conv_id") * 100 + F.col("turn")).alias("node"), (F.col("conv_id") * 100 + F.col("parent_pos")).alias("parent"), "conv_id", "role", "level")
    return tree.drop_orphan_duplicates(e, "node", "parent", ["conv_id", "role"]).select("node", "has_child")


@query
def median_gap(t, spark):
    return tree.median_gap(t("orders").select("o_custkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x")), "o_custkey", "x", 16, 42, 28.0)


@query
def stable_stop(t, spark):
    from pyspark.sql import Window

    e = t("events").withColumn("ratio", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))))
    return tree.stable_stop(e, "user_id", "event_id", F.col("ratio"), 15.0)


@query
def reconcile_status(t, spark):
    c = t("customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string")).alias("k"), F.col("c_custkey").alias("left_id")).where("k IS NOT NULL")
    o = t("orders").select(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey").cast("string")).otherwise("").alias("k"), F.col("o_orderkey").alias("right_id"))
    return match.reconcile(c, o, "k")


@query
def left_placeholder_frame_index(t, spark):
    p = t("part").select(F.col("p_partkey").alias("k"), "p_brand")
    r = t("lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("k"), "l_suppkey").agg(F.max("l_quantity").alias("q"))
    return match.left_with_placeholder(p, r, "k", "l_suppkey", {"l_suppkey": -1, "q": 0.0})


@query
def lookup_update_gate(t, spark):
    d = t("documents").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return match.update_from(d, t("labels").withColumn("p", F.col("doc_id")), "doc_id", "p", lambda: F.col("quality") == 1, {"quality": "quality", "toxic": "toxic"})


@query
def known_and_missing(t, spark):
    known, found = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    return match.known_only(known, found, "k").withColumn("found", F.lit(True)).union(match.missing(known, found, "k").withColumn("found", F.lit(False)))


@query
def union_if_empty(t, spark):
    return match.union_if_empty(t("labels").where("quality > 5").select("doc_id"), t("labels").where("toxic = 1").select("doc_id"))


@query
def rescue_cascade(t, spark):
    lab = t("labels")
    by = lambda cond: lambda open_: open_.join(lab.where(cond).select("doc_id"), "doc_id", "left_semi")
    return match.rescue(t("documents").select("doc_id"), "doc_id", [by("quality = 0"), by("toxic = 1"), by("quality = 1")])


@query
def loosest_match(t, spark):
    p = t("part").select("p_size", "p_partkey", "p_name", F.element_at(F.array(F.lit("red"), F.lit("ring"), F.lit("blue bolt"), F.lit("dget")), (F.col("p_size") % 4 + 1).cast("int")).alias("code"))
    return match.loosest_match(p, "p_size", "p_name", "code")


def _noisy(t) -> DataFrame:
    code = F.concat(F.lpad((F.col("p_partkey") % 97).cast("string"), 2, "0"), F.element_at(F.array(*[F.lit(c) for c in "ABGOI"]), (F.col("p_partkey") % 5 + 1).cast("int")), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return t("part").select("p_partkey", code.alias("code"), F.when(F.col("p_partkey") % 3 == 0, F.translate(code, "015", "OIS")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x "), code, F.lit(" y"))).otherwise(code).alias("txt"))


def _dictionary(t) -> DataFrame:
    """A code per nation."""
    n = F.col("n_nationkey")
    return t("nation").select(F.concat(F.lpad(((n * 7) % 97).cast("string"), 2, "0"), F.element_at(F.array(*[F.lit(c) for c in "ABGOI"]), (n % 5 + 1).cast("int")), F.lpad((n * 2 + 1).cast("string"), 2, "0")).alias("code"))


@query
def code_extract(t, spark):
    return _noisy(t).select("p_partkey", X.first_code(F.col("txt")).alias("found"))


@query
def code_confusion_fix(t, spark):
    return _noisy(t).select("p_partkey", X.unconfused_code(F.col("txt")).alias("fixed"))


@query
def code_score_match(t, spark):
    """Every part's reading against the codes of all parts."""
    n = _noisy(t)
    return match.code_scores(n.select("p_partkey", "txt"), n.select("code"), "p_partkey", "txt")


@query
def label_normalise(t, spark):
    return t("documents").select("doc_id", X.fold_key(F.col("text")).alias("key"), F.array_join(X.anchors(F.col("text")), " ").alias("anchors"))


@query
def fuzzy_label(t, spark):
    p = t("part").select("p_name").distinct()
    return match.canonical_label(p, "p_name", ["smal ring", "red widgett", "bluebolt", "large nut", "green gear"]).select("p_name", "canonical", "ratio")


@query
def number_parse(t, spark):
    s = F.replace(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.number(s).alias("n"), X.number(F.concat(F.lit("~"), s)).alias("bad"), N.whole((F.col("l_quantity") - 10)).alias("whole"))


@query
def multiplicity_parse(t, spark):
    s = F.format_string("pos %d x, %s A", F.col("l_linenumber"), F.col("l_returnflag"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.multiplicity(s).alias("m"))


@query
def datum_flags(t, spark):
    s = F.concat_ws(" ", F.lit("05A01"), "l_returnflag", F.when(F.col("l_linenumber") > 3, "B-C"))
    m = X.datum_flags(s)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[m[c].alias(c) for c in "ABCDE"])


@query
def tolerance_parse(t, spark):
    s = F.concat_ws(" ", F.concat("l_linenumber", F.lit("X")), F.lit("05A01"), F.lit("A"), F.replace(F.col("l_tax").cast("string"), F.lit("."), F.lit(",")))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.tolerance(s, F.lit("05A01")).alias("tol"))


@query
def natural_sort_key(t, spark):
    return t("part").select("p_partkey", X.natural_key(F.concat_ws(" ", "p_brand", "p_name")).alias("key"))


@query
def text_plausibility(t, spark):
    return _noisy(t).select("p_partkey", F.round(X.plausibility(F.col("txt")), 6).alias("points"), X.is_structured_short(F.col("txt")).alias("short"))


@query
def clean_labels(t, spark):
    return t("documents").select("doc_id", X.clean_label(F.col("text")).alias("label"))


@query
def word_filter_rows(t, spark):
    w = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("text"), (F.col("l_quantity") - 5).alias("conf"), F.col("l_linenumber").alias("top"), F.col("l_quantity").cast("int").alias("height"))
    return lines.usable_words(w).select("l_orderkey", "l_linenumber", "l_partkey", "center_y", lines.needs_recovery(F.col("text"), F.col("conf"), F.lit(30.0), F.col("conf") < 10).alias("again"))


@query
def line_assembly(t, spark):
    w = t("lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").cast("string").alias("text"), F.col("l_quantity").alias("conf"), F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("top"), F.col("l_linenumber").alias("width"), F.col("l_linenumber").alias("height"))
    return lines.lines(w, ["l_orderkey"])


@query
def audit_unpivot(t, spark):
    return review.audit(t("customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))), "c_custkey", ["c_name", "c_mktsegment"])


@query
def review_queue(t, spark):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("seg"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"))
    return review.review_queue(review.with_status(c, {"seg": F.col("seg"), "name": F.col("name")}), "review_needed", ["c_custkey", "review_reason", "status"], ["decision"], ["c_custkey"])


@query
def manifest_counts(t, spark):
    return review.manifest(t("customer"), {"negative": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING"})


@query
def coverage_report(t, spark):
    o = t("orders").select("o_custkey", F.when(F.col("o_totalprice") > 400000, F.col("o_totalprice")).alias("v"))
    return review.uncovered(o, "o_custkey", "v")


@query
def classify_nodes(t, spark):
    return t("part").select("p_partkey", review.classify(F.col("p_name"), [("RING", "ring$"), ("RED", "^red "), ("LONG", "^.{11,}$")]).alias("class"))


@query
def enum_lookup(t, spark):
    return match.lookup_enum(t("orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderpriority"), {"1-URGENT": "first", "5 low": "last"}, [("high", "high"), ("spec", "none")])


@query
def array_overlap_corr(t, spark):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = F.size("e")
    pairs = e.select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("lag"), "e", n.alias("n")).select("vec_id", "lag", F.explode(F.arrays_zip(F.expr("slice(e, 1, n - lag)").alias("x"), F.expr("slice(e, lag + 1, n - lag)").alias("y"))).alias("p"))
    return pairs.groupBy("vec_id", "lag").agg(F.round(F.corr("p.x", "p.y"), 6).alias("corr"))


@query
def json_explode(t, spark):
    return t("events").select("event_id", F.explode(F.from_json("props", "map<string, int>")).alias("field", "value"))


@query
def row_signature(t, spark):
    return spark.range(1).select(F.lit(readers.signature(t("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])).alias("signature"))


@query
def angles_and_boxes(t, spark):
    o = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 13).alias("a"), (F.col("l_linenumber") * 29.0).alias("b"))
    box = lambda x, y: (x, y, F.lit(40.0), F.lit(30.0))
    return o.select("l_orderkey", "l_linenumber", "l_partkey", N.angle_difference(F.col("a"), F.col("b")).alias("difference"), N.normal_angle(F.col("a")).alias("normal"), F.round(N.iou(box(F.col("a") % 50, F.lit(0.0)), box(F.col("b") % 50, F.lit(10.0))), 6).alias("iou"))


def _boxes(t) -> DataFrame:
    return t("lineitem").select(
        "l_orderkey", (F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("box_id"), (F.col("l_partkey") % 200).cast("double").alias("x"), (F.col("l_suppkey") % 90).cast("double").alias("y"),
        (20 + F.col("l_linenumber") * 3).cast("double").alias("w"), (10 + F.col("l_quantity")).alias("h"), F.col("l_discount").alias("score"), F.lit(28.0).alias("step"),
    )


@query
def merge_evidence(t, spark):
    return greedy.merge_evidence(_boxes(t), "l_orderkey", "y", "x", "h", "step")


@query
def row_grouping(t, spark):
    return greedy.group_rows(_boxes(t), "l_orderkey", "y", "x")


@query
def iou_nms(t, spark):
    return greedy.suppress_boxes(_boxes(t), "l_orderkey", ("x", "y", "w", "h"), [F.col("score").desc(), F.col("box_id")], 0.25)


@query
def box_components(t, spark):
    return greedy.touching_components(_boxes(t), "l_orderkey", "box_id", ("x", "y", "w", "h"), 2.0)


@query
def sequence_inference(t, spark):
    p = t("part").select((F.col("p_partkey") / 5).cast("long").alias("g"), "p_partkey", F.when(F.col("p_partkey") % 5 == 3, "XZ").otherwise(F.concat(F.lit("X"), F.col("p_partkey") % 5 - 1)).alias("txt"))
    return greedy.infer_sequence(p, ["g"], "p_partkey", "txt")


@query
def sequence_dedupe(t, spark):
    p = t("part").select((F.col("p_partkey") / 8).cast("long").alias("g"), "p_partkey", F.concat(F.lit("X"), F.col("p_size") % 4).alias("cur"), F.array(F.struct((F.col("p_size") * 1.0).alias("score"), F.concat(F.lit("X"), F.col("p_size") % 9).alias("code"))).alias("opts"))
    return greedy.recover_sequence(p, ["g"], "p_partkey", "cur", "opts").select("g", "p_partkey", "cur", "chosen", "replaced")


@query
def greedy_assignment(t, spark):
    e = t("events").groupBy("event_type", "user_id", F.get_json_object("props", "$.k").alias("code")).agg(F.max("value").alias("score"))
    return greedy.assign_greedily(e, "event_type", "user_id", "code", "score")


@query
def step_control(t, spark):
    return greedy.control_step(t("events").select("user_id", "event_id", (F.col("value") / 100).alias("ratio")), "user_id", "event_id", "ratio")


@query
def spaced_peaks(t, spark):
    return greedy.spaced_peaks(t("lineitem").select("l_suppkey", "l_quantity", "l_discount"), "l_suppkey", "l_quantity", "l_discount")


def _displays(t) -> DataFrame:
    n = _noisy(t)
    wrong = F.translate("code", "0152", "OISZ")
    shown = F.element_at(F.array(wrong, F.concat(wrong, F.lit(" ("), F.col("code"), F.lit("...)")), F.concat(F.lit("GE "), F.translate("code", "ABGOI", "44444")), F.col("code")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return n.select("p_partkey", "code", shown.alias("text"), F.concat_ws(" | ", "txt", shown, F.when(F.col("p_partkey") % 6 == 0, F.concat("code", F.lit(" ("), F.col("code"), F.lit(")")))).alias("others"), F.when(F.col("p_partkey") % 5 > 0, "Notes").otherwise("views").alias("parent"))


@query
def code_evidence(t, spark):
    return evidence.code_evidence(_displays(t), ["p_partkey"], "text", "others").drop("pos")


@query
def code_recovery(t, spark):
    return evidence.recover_codes(_displays(t), "text", "others", "parent").select("p_partkey", "recovered", "marker")


@query
def display_guards(t, spark):
    d = _displays(t)
    x = F.col("text")
    return d.select("p_partkey", C.strict_head(x).alias("strict_head"), C.has_strict_code(x).alias("strict"), C.is_code_display(x).alias("display"), C.is_short_display(x).alias("short"), C.has_code_parent(F.col("parent")).alias("context"))


def _frames(t) -> DataFrame:
    value = F.replace((F.col("l_tax") * 100 + F.col("l_linenumber") / 10).cast("decimal(6,1)").cast("string"), F.lit("."), F.lit(","))
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("03A01 | "), value, F.lit(" | A"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.col("l_linenumber").cast("string"), F.lit("X 03A01 "), value)).otherwise(
        F.concat(F.lit("03A01 "), F.col("l_linenumber").cast("string"), F.lit(" | A")))
    return t("lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), text.alias("text"), F.lit("03A01").alias("code"))


@query
def standard_tolerance(t, spark):
    return evidence.standard_tolerance(_frames(t), "l_orderkey", "pos", "text", "code")


@query
def conditional_tolerance(t, spark):
    f = t("lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.concat(F.lit("03A01 "), F.when(F.col("l_linenumber") % 3 == 0, F.concat((F.col("l_tax") * 100).cast("int").cast("string"), F.lit(",5"))).otherwise((F.col("l_tax") * 100).cast("int").cast("string")), F.lit(" HEIGHT < 7.25")).alias("text"))
    return evidence.conditional_tolerance(f, "l_orderkey", "pos", "text")


@query
def conditional_suffix(t, spark):
    line = F.concat(F.lit("3 "), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("")), (F.col("l_linenumber") % 3 + 1).cast("int")), F.lit("O"), F.element_at(F.array(F.lit("I"), F.lit("Z"), F.lit("7"), F.lit("0")), (F.col("l_partkey") % 4 + 1).cast("int")), F.lit(" WIDTH > 3"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.conditional_suffix(F.array(F.lit("no condition"), line)).alias("suffix"))


@query
def lane_conflict(t, spark):
    e = t("events").select("user_id", "event_id", (F.col("event_id") % 2).cast("int").alias("lane"), F.col("event_type").alias("text"), F.floor("value").cast("double").alias("conf"), F.when(F.col("event_id") % 3 == 0, "line_a").otherwise("full").alias("method"), (F.col("event_id") % 5 == 0).alias("partial"))
    return evidence.lane_conflicts(e, "user_id", "event_id", "lane", "text", "conf", "method", "partial")


@query
def fragment_completion(t, spark):
    n, known = _noisy(t), _dictionary(t)
    return evidence.complete_fragments(n.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.substring("code", 2, 4)).otherwise(F.substring("code", 1, 4)).alias("txt")), known, "p_partkey", "txt")


@query
def code_location(t, spark):
    word = F.element_at(F.array(F.lit("03"), F.lit("A01"), F.lit("O3A"), F.lit("01")), (F.col("l_partkey") % 4 + 1).cast("int"))
    w = t("lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("line"), F.lit("03A01").alias("code"), word.alias("text"), (F.col("l_linenumber") * 100).alias("left"), F.col("l_partkey").alias("top"), F.lit(40).alias("width"), F.lit(10).alias("height"))
    return evidence.locate_code(w, "l_orderkey", "line", "code", "text", ("left", "top", "width", "height"))


@query
def frame_registration(t, spark):
    e = t("embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 24).alias("a"))
    e = e.withColumn("b", F.concat(F.slice("a", 4, 21), F.slice("a", 1, 3)))
    return evidence.register(e, "a", "b", 1, 12, apart=2).select("vec_id", "shift", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"))


@query
def support_axis(t, spark):
    a = t("orders").groupBy("o_custkey").agg(F.collect_set(F.floor(F.col("o_totalprice") / 5000).cast("double")).alias("axes"))
    return a.select("o_custkey", C.base_axis(F.col("axes"), F.lit(28.0), 47.0).alias("axis"))


@query
def prefix_repair(t, spark):
    w = t("lineitem").select("l_orderkey", F.col("l_quantity").alias("left"), F.lit(9.0).alias("width"), F.concat("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise("")).alias("text"))
    return evidence.prefix_words(w, "l_orderkey", "left", "width", "text", F.lit(40.0), F.lit(50.0), F.lit(28.0))


@query
def median_default(t, spark):
    return evidence.median_or(t("events").select("user_id", F.when(F.col("event_type") == "error", F.floor("value").cast("double")).alias("v")), "user_id", "v", 60.0)


@query
def flags_of_two_sources(t, spark):
    d = t("documents").select("doc_id", (F.length("text") % 2 == 0).alias("quality"), F.lit(False).alias("toxic"))
    return evidence.or_flags(d, t("labels").select("doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic")), "doc_id", ["quality", "toxic"])


@query
def value_cascade(t, spark):
    o = t("orders")
    limit = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    measured = F.when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey").cast("double"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.regexp_extract("o_orderpriority", "([0-9])", 1).try_cast("double"))
    return o.select("o_orderkey", C.cascade(*[(n, x.isNotNull(), x) for n, x in (("limit", limit), ("dimension", measured), ("text", text))]).alias("c")).select("o_orderkey", "c.value", "c.source")


@query
def quantity_cascade(t, spark):
    m = F.when(F.col("l_linenumber") % 4 == 0, F.create_map(F.lit("SemanticGDT.NxDisplay.Count"), F.col("l_quantity").cast("string"))).when(
        F.col("l_linenumber") % 4 == 1, F.create_map(F.lit("Quantity"), F.concat(F.col("l_linenumber").cast("string"), F.lit(" x")))).when(
        F.col("l_linenumber") % 4 == 2, F.create_map(F.lit("SemanticGDT.NxDisplay.IsASeparate"), F.lit("True"))).otherwise(F.create_map(F.lit("Quantity"), F.lit("")))
    combined = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("pos "), F.col("l_linenumber").cast("string"), F.lit("× A"))).otherwise("none")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.quantity(m, combined, F.col("l_returnflag") == "N").alias("q")).select("l_orderkey", "l_linenumber", "l_partkey", "q.display", "q.count")


@query
def ordered_distinct(t, spark):
    return t("part").select("p_partkey", F.array_join(C.unique_texts(F.array("p_brand", F.upper("p_brand"), F.lit(" "), "p_name", F.initcap("p_name"), F.lit("end"))), "|").alias("texts"))


@query
def structural_labels(t, spark):
    n = F.col("c_custkey")
    label = F.when(n % 4 == 0, "Springback").when(n % 4 == 1, F.concat(F.lit("a | b-c "), F.lit("d-e"))).when(n % 4 == 2, "Elément de référence.S (E)").otherwise(F.col("c_name"))
    parent = F.element_at(F.array(F.lit("CPC"), F.lit("ctf"), F.lit("Références")), (n % 3 + 1).cast("int"))
    return t("customer").select("c_custkey", C.capture_label(label, parent).alias("capture"), C.reference_label(label, parent).alias("reference"))


from . import queries_scans  # noqa: E402, F401  (registers its queries)
