"""Queries of scans, workbooks, alike labels, crowded pictures and what was read of them, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import evidence, greedy, lines, match, pictures, scan, tree
from ..sources import readers, workbook, writers
from ..sources.folders import scratch
from .queries import LEVELS, _boxes, _noisy, _round, _talk, query


def _linked(t) -> tuple[DataFrame, DataFrame]:
    """Turns as objects: each holds its children, some also the turn after next, and some the conversation's first turn again."""
    turns = tree.parents(_talk(t), "conv_id", "turn", "level", LEVELS).select("conv_id", "turn", "parent_pos", F.concat_ws(":", "role", "turn").alias("name"))
    node = lambda c: F.col("conv_id") * 1000 + F.col(c)
    held = turns.where("parent_pos IS NOT NULL").select("conv_id", node("parent_pos").alias("parent"), F.lit(1).alias("ord"), F.col("turn").alias("item"), node("turn").alias("child"), "name")
    after = turns.where("turn % 3 = 2").select("conv_id", (node("turn") - 2).alias("parent"), F.lit(2).alias("ord"), F.col("turn").alias("item"), node("turn").alias("child"), "name")
    first = turns.where("turn = 0").select(F.col("conv_id").alias("c"), F.col("name").alias("n"))
    again = turns.where("turn % 2 = 1").join(first, F.col("conv_id") == F.col("c")).select("conv_id", node("turn").alias("parent"), F.lit(3).alias("ord"), F.lit(0).cast("long").alias("item"), (F.col("conv_id") * 1000).alias("child"), F.col("n").alias("name"))
    links = held.union(after).union(again).withColumnRenamed("conv_id", "doc")
    roots = turns.where("parent_pos IS NULL").select(F.col("conv_id").alias("doc"), F.lit(0).alias("ord"), F.col("turn").alias("item"), node("turn").alias("node"), "name")
    return links, roots


@query
def object_scan(t, spark):
    links, roots = _linked(t)
    return scan.scan_objects(links, roots, depth=1000)


@query
def object_tree(t, spark):
    links, roots = _linked(t)
    return scan.scan_objects(links.where("ord = 1"), roots).select("doc", "position", "node", "parent", "level", "path", "children")


def _records(t) -> DataFrame:
    n, p = F.col("event_id"), F.col("props")
    other = F.concat(F.lit('{"k": "n/a", "extra": [1, 2], "value": "'), F.col("value").cast("decimal(12,2)").cast("string"), F.lit('"}'))
    raw = F.when(n % 13 == 0, None).when(n % 7 == 0, F.substring(p, F.lit(1), F.length(p) - 1)).when(n % 11 == 0, other).when(n % 5 == 0, F.replace(p, F.lit('"k"'), F.lit('"key"'))).otherwise(p)
    return t("events").select("event_id", raw.alias("raw"))


FIELDS = (scan.Field("k", ("$.k", "$.key"), "int"), scan.Field("value", ("$.value",), "double"))


@query
def record_scan(t, spark):
    return scan.scan_records(_records(t), ["event_id"], "raw", FIELDS)


@query
def record_audit(t, spark):
    return scan.audit_records(_records(t), ["event_id"], "raw", FIELDS)


ROWS_A_FILE = 200_000


@query
def workbook_tree(t, spark):
    """The conversations written as workbooks of at most some ROWS_A_FILE rows, four at least, and read back as trees."""
    talk = _talk(t).withColumn("text", F.concat_ws(" ", "role", "turn"))
    files, folder = 4 + talk.count() // ROWS_A_FILE, scratch(spark)
    for k in range(files):
        own = talk.where(F.col("conv_id") % files == k).orderBy("conv_id", "turn").select("text", "level", F.concat_ws("-", "conv_id", "turn").alias("node_id"))
        workbook.write_workbook({"NOTES": own.limit(0), "TREE": own}, f"{folder}/book{k}.xlsx")
    nodes, _ = readers.workbook_trees(spark, folder, "TREE")
    return nodes.select(F.regexp_extract("file", r"book([0-9]+)\.xlsx$", 1).cast("int").alias("book"), "line", "node_id", "parent_id", "level", "text")


@query
def recognised_rows(t, spark):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    text = F.concat_ws(" ", F.concat(n, F.lit("X")), F.when((p % 3 > 0) & (p % 2 == 0), "05A01"), "l_returnflag", F.replace((F.col("l_tax") + 1).cast("decimal(4,2)").cast("string"), F.lit("."), F.lit(",")))
    rows = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(n % 2 == 0, text).alias("annotation"), F.when(n % 2 == 1, text).alias("ocr_text"), F.when(p % 3 == 0, "07B02").alias("series_code"),
        F.when(n == 1, F.replace(F.col("l_discount").cast("string"), F.lit("."), F.lit(","))).alias("tolerance_value"), F.when(n == 2, "4,0").when(n == 4, "none").alias("multiplicity"), F.when(p % 4 == 0, " b-c ").alias("references"),
    )
    return readers.recognised(rows, ["l_orderkey", "l_linenumber", "l_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "series_code", "multiplicity", "tolerance_value", *[f"datum_{c}" for c in "abcde"], "kind")


def _shown(t) -> DataFrame:
    """Words of turns as labels of pictures that follow each other."""
    w = t("conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("at", "label")).where("length(label) > 3")
    return w.select("conv_id", "turn", (F.length("label") % 3).alias("level"), "label", (40 + F.length("label") * 3.0).alias("conf"), (F.col("turn") * 40 + F.col("at") * 12).alias("top"))


@query
def anchor_shifts(t, spark):
    return match.anchor_shifts(_shown(t), "conv_id", "turn", "level", "label", "conf", "top")


@query
def similar_labels(t, spark):
    p = t("part").select(F.col("p_brand").alias("brand"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("label")).distinct()
    return match.similar_pairs(p, p, "brand", "label").select("brand", "label", "label_b", F.round("ratio", 6).alias("ratio"))


def _crowded(t) -> DataFrame:
    return _boxes(t).drop("l_orderkey").withColumn("picture", F.col("box_id") % 25)


@query
def crowded_centres(t, spark):
    c = _crowded(t)
    rule = greedy.near_centres(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, 28.0)
    return greedy.suppressed(c, "picture", [-F.col("w") * F.col("h"), F.col("box_id")], rule, 18).select("picture", "box_id", "x", "y", "w", "h")


@query
def crowded_equals(t, spark):
    rule = greedy.near_equal(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("w"), F.col("h"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = t("orders").select((k % 40).alias("picture"), k.alias("box_id"), *[v.cast("double").alias(n) for n, v in (("x", c % 100), ("y", k % 30), ("w", k % 5 * 3 + 20), ("h", c % 9 + 10))])
    return greedy.suppressed(o, "picture", [-F.col("w") * F.col("h"), F.col("box_id")], rule).select("picture", "box_id", "x", "y", "w", "h")


@query
def tolerance_cascade(t, spark):
    n, d = F.col("l_linenumber"), lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    limit = F.when(n % 4 == 0, F.create_map(F.lit("nominal"), d("l_tax"), F.lit("lower"), F.lit(""))).when(n % 4 == 1, F.create_map(F.lit("nominal"), F.lit("none"))).otherwise(F.create_map(F.lit("upper"), d("l_discount")))
    size = F.when(n % 3 == 0, F.create_map(F.lit("dimension_value"), d("l_quantity"), F.lit("tolerance_lower"), F.lit("-1,5")))
    text = F.concat(F.lit("2X 05A01 A "), d("l_quantity"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.tolerance_of(limit, size, text, F.lit("05A01")).alias("t")).select("l_orderkey", "l_linenumber", "l_partkey", "t.*")


@query
def record_field_cascade(t, spark):
    n = F.col("o_orderkey")
    m = F.map_filter(
        F.create_map(F.lit("Name"), F.col("o_orderpriority"), F.lit("Tolerance"), F.when(n % 2 == 0, F.col("o_custkey").cast("string")), F.lit("Value"), n.cast("string"), F.lit("Unit"), F.when(n % 3 == 0, "mm").otherwise("")), lambda k, v: v.isNotNull())
    return t("orders").select("o_orderkey", C.record_fields(m).alias("f")).select("o_orderkey", "f.display", "f.unit", "f.kind", "f.combined")


@query
def visible_labels(t, spark):
    return t("part").select("p_partkey", C.label_visible(F.upper("p_name"), "redring", ("bl",), ("bol", "wid")).alias("visible"))


@query
def tree_report(t, spark):
    c = _talk(t).select("conv_id", F.col("turn").alias("line"), "level", F.concat_ws(":", "role", "turn").alias("text"), F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("Name"), F.col("role"))).alias("raw_properties"), F.when(F.col("turn") % 3 == 0, F.array(F.lit("hidden"))).alias("errors"))
    return tree.tree_rows(c, "conv_id", "line", LEVELS).select("conv_id", "line", "level", "text", "full_path", "object_name", "read_status")


@query
def crop_options(t, spark):
    n = _noisy(t).select("p_partkey", "txt", (F.col("p_partkey") % 100).cast("double").alias("conf"), (F.col("p_partkey") % 60).cast("double").alias("left"), (F.col("p_partkey") % 50).cast("double").alias("x"), F.lit("raw").alias("method"))
    o = lines.batch_options(n, "txt", "conf", "left", "x", [5.0, 19.0, 33.0, 47.0], 14.0, F.col("p_partkey") % 2 == 0, "method")
    return o.select("p_partkey", "crop_lane", "level", "branch_x", F.round("geometry_alignment", 6).alias("geometry_alignment"), F.round("score", 6).alias("score"), "method")


@query
def unique_tokens(t, spark):
    w = t("lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.concat("l_returnflag", F.lit("-"))).alias("text"), (F.col("l_linenumber") * 10).alias("left"), F.col("l_quantity").cast("int").alias("top"), F.lit(8).alias("width"), F.lit(9).alias("height"))
    return lines.unique_tokens(w, "l_suppkey", "pos", "text", ("left", "top", "width", "height"))


@query
def label_repairs(t, spark):
    n = F.col("c_custkey")
    label = F.when(n % 4 == 0, "Springback").when(n % 4 == 1, F.concat(F.lit("a | b-c "), F.lit("d-e"))).when(n % 4 == 2, "Elément de référence.S (E)").otherwise(F.col("c_name"))
    c = t("customer").select("c_custkey", label.alias("text"), F.element_at(F.array(F.lit("CPC"), F.lit("ctf"), F.lit("Références")), (n % 3 + 1).cast("int")).alias("parent"), F.when(n % 5 == 0, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return evidence.repair_labels(c, "text", "parent", "reasons").select("c_custkey", "text", F.array_join("reasons", "|").alias("reasons"))


@query
def code_manifest(t, spark):
    n = F.col("s_suppkey")
    s = t("supplier").select(n.alias("order"), F.when(n % 3 > 0, F.concat(F.lpad((n % 97).cast("string"), 2, "0"), F.lit("A01"))).otherwise("").alias("series_code"), F.col("s_name").alias("ref_parent"), F.col("s_nationkey").alias("functional_group"), F.lit("a > b").alias("tree_path"))
    folder = scratch(spark)
    writers.document_file(writers.code_manifest(s, "part"), folder)
    return readers.manifest_items(spark, folder, "series", "series_code", "order").select("order", "series_code", "ref_parent", "functional_group", "tree_path")


@query
def collinear_groups(t, spark):
    c = _crowded(t).withColumn("angle", (F.col("box_id") % 4 * 45).cast("double")).withColumn("area", F.col("w") * F.col("h"))
    return pictures.collinear_groups(c.select("picture", "box_id", "x", "y", "w", "h", "angle", "area"), "picture", ("x", "y", "w", "h", "angle"), "area")


@query
def wall_sets(t, spark):
    w = _boxes(t).select(F.col("box_id").alias("b"), "x", "y", (F.col("h") % 24 + 8).alias("length")).select((F.col("b") % 2000).alias("picture"), (F.col("x") * 3).alias("x"), "y", "length", (F.col("y") - F.col("length") / 2).alias("low"), (F.col("y") + F.col("length") / 2).alias("high"))
    return _round(pictures.wall_sets(w, "picture", ("x", "y", "length", "low", "high")))


@query
def value_cells(t, spark):
    w = t("lineitem").select("l_orderkey", (F.col("l_quantity") * 7).alias("x"), (F.col("l_orderkey") % 90).cast("double").alias("end"), (F.col("l_orderkey") % 40).cast("double").alias("height"))
    cells = pictures.value_cells(w, "l_orderkey", "x", "end", "height")
    return cells.select("l_orderkey", "rank", *[F.col("window")[k].alias(f"x{k}") for k in range(3)])


OVERLAPPING, STEP = 40, 30  # vectors of a picture, and how many later the next one begins


@query
def picture_registration(t, spark):
    """Every forty vectors a picture, ten of them in the next one too."""
    e = t("embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda v: F.round(v, 3)).alias("e"))
    width = len(e.first()["e"])
    first = F.floor(F.col("vec_id") / STEP).cast("long")
    parts = e.select("vec_id", "e", F.explode(F.array(first, first - 1)).alias("k")).where(F.col("vec_id") < F.col("k") * STEP + OVERLAPPING)
    p = parts.where("k >= 0").groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "e"))), lambda s: s["e"])).alias("p"))
    pairs = p.select("k", F.col("p").alias("before")).join(p.select((F.col("k") - 1).alias("k"), F.col("p").alias("after")), "k")
    return _round(pictures.register_pictures(pairs, "before", "after", width, near=2, least=1, rows=8))
