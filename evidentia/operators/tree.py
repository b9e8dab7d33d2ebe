"""Hierarchies from ordered levels, and walks over parent links.

A segment's rows are ordered by a position; everything about the open branch at a row is a window over what came before, so
one sort per segment gives parents, ancestors and paths together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written


def _before(segment: str, pos: str) -> Window:
    return Window.partitionBy(segment).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)


def with_ancestors(df: DataFrame, segment: str, pos: str, level: str, levels: int, payload: list[str] | None = None) -> DataFrame:
    """Add `ancestors`: array<struct<pos, level, payload...>> of the open branch from the top, the row itself not. A row of a
    level is open while no later row has its level or a lesser one. A level of `levels` or more is an error."""
    w = _before(segment, pos)
    df = df.withColumn(level, F.when(F.col(level) >= levels, F.raise_error(F.lit(f"a level is {levels} or more"))).otherwise(F.col(level)))
    cols = [F.col(pos).alias("pos"), F.col(level).alias("level"), *[F.col(c) for c in payload or []]]
    lasts = df.withColumn("lasts", F.array(*[F.last(F.when(F.col(level) == k, F.struct(*cols)), ignorenulls=True).over(w) for k in range(levels)]))
    above = F.filter("lasts", lambda a: a.isNotNull() & (a["level"] < F.col(level)))
    return lasts.withColumn("above", above).withColumn("ancestors", F.filter("above", lambda a: ~F.exists("above", lambda b: (b["level"] < a["level"]) & (b["pos"] > a["pos"])))).drop("lasts", "above")


def parents(df: DataFrame, segment: str, pos: str, level: str, levels: int, name: str | None = None) -> DataFrame:
    """(J2) Add parent_pos, with `name` also parent_name, and hierarchy_status: the nearest earlier row of a lesser level."""
    roots = F.count_if(F.col(level) == 0).over(_before(segment, pos))
    up = F.element_at("ancestors", -1)
    out = with_ancestors(df, segment, pos, level, levels, [name] if name else None).withColumn("roots_seen", F.coalesce(roots, F.lit(0)))
    last = F.when(F.size("ancestors") > 0, up)
    status = (
        F.when((F.col(level) == 0) & (F.col("roots_seen") == 0), "root").when(F.col(level) == 0, "root_level_unconfirmed").when(last.isNull(), "parent_unknown")
        .when(last["level"] == F.col(level) - 1, "direct").otherwise("parent_inferred_gap")
    )
    out = out.withColumn("parent_name", last[name]) if name else out
    return out.withColumn("parent_pos", last["pos"]).withColumn("hierarchy_status", status).drop("roots_seen", "ancestors")


def paths(df: DataFrame, segment: str, pos: str, level: str, levels: int, name: str) -> DataFrame:
    """(J3) Add full_path: names of the open branch and of the row."""
    out = with_ancestors(df, segment, pos, level, levels, [name])
    return out.withColumn("full_path", F.concat_ws(" > ", F.transform("ancestors", lambda a: a[name]), F.col(name))).drop("ancestors")


def tree_rows(nodes: DataFrame, document: str, line: str, levels: int) -> DataFrame:
    """(F16) The rows of a tree report, of nodes in order of `line` (text, level, raw_properties, errors): full_path, object_name and
    read_status, OK without errors and else PARTIAL. Whatever else the nodes have stays."""
    named = nodes.withColumn("object_name", F.coalesce(F.try_element_at("raw_properties", F.lit("Name")), F.lit("")))
    status = F.when(F.coalesce(F.size("errors"), F.lit(0)) > 0, "PARTIAL").otherwise("OK")
    return paths(named.withColumn("read_status", status), document, line, "level", levels, "text").drop("raw_properties", "errors")


def nearest_ancestor(df: DataFrame, segment: str, pos: str, level: str, levels: int, name: str, matches, own: Column | None = None) -> DataFrame:
    """(J4) Add nearest_pos: the closest ancestor that matches(name); with `own`, the row itself where that holds."""
    out = with_ancestors(df, segment, pos, level, levels, [name])
    hits = F.filter("ancestors", lambda a: matches(a[name]))
    near = F.when(F.size(hits) > 0, F.element_at(hits, -1)["pos"])
    return out.withColumn("nearest_pos", near if own is None else F.when(own, F.col(pos)).otherwise(near)).drop("ancestors")


def descendants(edges: DataFrame, child: str, parent: str, root: DataFrame, depth: int = 100) -> DataFrame:
    """(J16) (node, depth) reached from the nodes of root(node), breadth first; cycles end where a node is met again.
    Nodes beyond `depth` are an error. Each round is written, so rounds are not worked out again."""
    seen = root.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 2):
        front = edges.join(front.select(F.col("node").alias("_p")), F.col(parent) == F.col("_p")).select(F.col(child).alias("node")).distinct()
        front = written(front.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            return seen
        if d > depth:
            raise ValueError(f"nodes deeper than {depth}")
        seen = seen.union(front)
    return seen


def recursive_paths(edges: DataFrame, child: str, parent: str, name: str) -> DataFrame:
    """(J3, general graphs) (node, path, depth) from roots (parent null) down, by a recursive query."""
    return edges.sparkSession.sql(
        f"WITH RECURSIVE walk(node, path, depth) AS (SELECT {child}, CAST({name} AS STRING), 0 FROM {{e}} WHERE {parent} IS NULL UNION ALL "
        f"SELECT e.{child}, concat(w.path, ' > ', e.{name}), w.depth + 1 FROM {{e}} e JOIN walk w ON e.{parent} = w.node) SELECT * FROM walk",
        e=edges,
    )


def sibling_order(df: DataFrame, parent: str, pos: str) -> DataFrame:
    """(J21) Add sibling_no from 1."""
    return df.withColumn("sibling_no", F.row_number().over(Window.partitionBy(parent).orderBy(pos)))


def promote(df: DataFrame, node: str, parent: str, level: str, at: int = 1) -> DataFrame:
    """(J17) Children of a node at level `at` move up to its parent; decided on the state before, so nothing cascades."""
    up = df.select(F.col(node).alias("_u"), F.col(parent).alias("_up"), F.col(level).alias("_ul"))
    moved = df.join(up, F.col(parent) == F.col("_u"), "left")
    hit = F.coalesce(F.col("_ul") == at, F.lit(False)) & F.col("_up").isNotNull()
    return moved.withColumn(parent, F.when(hit, F.col("_up")).otherwise(F.col(parent))).withColumn(level, F.when(hit, F.col(level) - 1).otherwise(F.col(level))).drop("_u", "_up", "_ul")


def clusters(df: DataFrame, key: str, x: str, gap: float) -> DataFrame:
    """(W1) Gaps and islands on distinct values: key, cluster, low, high, n."""
    w = Window.partitionBy(key).orderBy(x)
    distinct = df.where(F.col(x).isNotNull()).select(key, x).distinct()
    fresh = distinct.withColumn("new", F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("int"), F.lit(0)))
    return fresh.withColumn("cluster", F.sum("new").over(w)).groupBy(key, "cluster").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(F.lit(1)).alias("n"))


def segment_offsets(df: DataFrame, key: str, pos: str, shift: str) -> DataFrame:
    """(W2) Add segment (one more at each missing shift but the first row's) and the running offset within it."""
    w = Window.partitionBy(key).orderBy(pos)
    out = df.withColumn("segment", F.count_if(F.col(shift).isNull()).over(w) - F.first(F.col(shift).isNull().cast("int")).over(w))
    return out.withColumn("offset", F.sum(F.coalesce(shift, F.lit(0.0))).over(Window.partitionBy(key, "segment").orderBy(pos)))


def clamp_levels(df: DataFrame, key: str, pos: str, level: str) -> DataFrame:
    """(W3) x(i) = min(max(1, a(i)), x(i-1) + 1), x(0) = 0, in closed form: i plus the least a(j) - j so far."""
    w = Window.partitionBy(key).orderBy(pos)
    i = F.row_number().over(w) - 1
    out = df.withColumn("i", i).withColumn("a", F.when(F.col("i") == 0, 0).otherwise(F.greatest(F.lit(1), level)))
    return out.withColumn("clamped", F.col("i") + F.min(F.col("a") - F.col("i")).over(w)).drop("i", "a")


def flatten_outliers(df: DataFrame, key: str, pos: str, level: str) -> DataFrame:
    """(W4) A level above two equal neighbours comes down to theirs."""
    w = Window.partitionBy(key).orderBy(pos)
    before, after = F.lag(level).over(w), F.lead(level).over(w)
    return df.withColumn("flat", F.when((before == after) & (F.col(level) > before), before).otherwise(F.col(level)))


def fill_section(df: DataFrame, key: str, pos: str, header: Column, name: str) -> DataFrame:
    """(W5) Add section: the last header so far."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section", F.last(F.when(header, F.col(name)), ignorenulls=True).over(w))


def first_boundary(df: DataFrame, key: str, pos: str, level: str, start: int) -> DataFrame:
    """(W6) Per key with a row at `start`: the first later row back at its level or above, once a deeper one was seen."""
    root = df.where(F.col(pos) == start).select(F.col(key).alias("_k"), F.col(level).alias("root"))
    later = df.join(root, F.col(key) == F.col("_k")).where(F.col(pos) > start).drop("_k")
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    seen = later.withColumn("deep", F.coalesce(F.max(level).over(w), F.lit(-1)) > F.col("root"))
    return seen.where(F.col("deep") & (F.col(level) <= F.col("root"))).groupBy(key).agg(F.min(pos).alias("boundary"))


def drop_orphan_duplicates(df: DataFrame, node: str, parent: str, key: list[str]) -> DataFrame:
    """(C11) Among rows alike in key, those without children go where others have some."""
    with_child = df.where(F.col(parent).isNotNull()).select(F.col(parent).alias("_p")).distinct()
    marked = df.join(with_child, F.col(node) == F.col("_p"), "left").withColumn("has_child", F.col("_p").isNotNull()).drop("_p")
    some = F.bool_or("has_child").over(Window.partitionBy(*key))
    return marked.withColumn("some", some).where("has_child OR NOT some").drop("some")


def first_of(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """(C13, S19) The first row of each key."""
    rest = F.struct(*df.columns)
    return df.groupBy(key.alias("_k")).agg(F.min_by(rest, F.col(pos)).alias("r")).select("r.*")


def median_gap(df: DataFrame, key: str, x: str, low: float, high: float, default: float) -> DataFrame:
    """(A18) Median of the gaps between distinct values that lie within bounds."""
    w = Window.partitionBy(key).orderBy(x)
    gaps = df.select(key, x).distinct().withColumn("gap", F.col(x) - F.lag(x).over(w))
    return gaps.groupBy(key).agg(F.coalesce(F.median(F.when(F.col("gap").between(low, high), F.col("gap"))), F.lit(default)).alias("step"))


def stable_stop(df: DataFrame, key: str, pos: str, ratio: Column, cut: float, streak: int = 2) -> DataFrame:
    """(W11, Z1) Per key the position of the row that ends the first run of `streak` changes under the cut."""
    w = Window.partitionBy(key).orderBy(pos)
    calm = df.withColumn("calm", F.coalesce(ratio < cut, F.lit(False)))
    run = calm.withColumn("all", F.min(F.col("calm").cast("int")).over(w.rowsBetween(1 - streak, 0))).withColumn("n", F.count(F.lit(1)).over(w.rowsBetween(1 - streak, 0)))
    return run.where((F.col("all") == 1) & (F.col("n") == streak)).groupBy(key).agg(F.min(pos).alias("stop_pos"))
