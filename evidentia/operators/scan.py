"""Scans of object graphs and of semi-structured records, with limits that raise and errors that stay with their record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_space, or_empty
from ..sources.folders import written

MOST_DEPTH, MOST_NODES, MOST_ITEMS = 18, 50_000, 20_000  # levels below a root, nodes of a document, items of a collection


def _limit(rows: DataFrame, message: str) -> None:
    """Raise if there is a row: (doc, node, n)."""
    if bad := rows.first():
        raise ValueError(f"document {bad['doc']}: {message.format(node=bad['node'], n=bad['n'])}")


def _resolved_trees(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Paths where no object is held twice: by pointer doubling, so in as many rounds as the depth has binary digits."""
    step = F.struct("ord", "item", F.col("child").alias("node"), F.col("name").alias("name"))
    up = links.select("doc", F.col("child").alias("node"), F.col("parent").alias("top"), F.array(step).alias("path"))
    first = F.struct("ord", "item", "node", "name")
    done = roots.select("doc", "node", F.lit(None).cast(dict(roots.dtypes)["node"]).alias("top"), F.array(first).alias("path"))
    reach = 1
    while True:
        # Who ends at a root is done, and the others' upper ends move up as far again as they have come.
        above = done.union(up).select(F.col("doc").alias("d"), F.col("node").alias("n"), F.col("top").alias("t"), F.col("path").alias("p"))
        joined = written(up.join(above, (F.col("doc") == F.col("d")) & (F.col("top") == F.col("n"))).select("doc", "node", F.col("t").alias("top"), F.concat("p", "path").alias("path")))
        done = written(done.union(joined.where("top IS NULL")))
        up, reach = joined.where("top IS NOT NULL"), 2 * reach
        if reach > depth or up.isEmpty():
            return done


def _resolved_graph(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Paths where objects may be held by several others or by their own content. An object's path is the one that a walk in order,
    which enters every object once, takes: the least of all that do not pass through the object itself. Rounds go on until
    no path gets less."""
    first = F.struct("ord", "item", "node", "name")
    begin = roots.select("doc", "node", F.array(first).alias("path"))
    best = begin
    for _ in range(4 * depth + 4):
        from_ = best.select(F.col("doc").alias("d"), F.col("node").alias("n"), F.col("path").alias("p"))
        on = links.join(from_, (F.col("doc") == F.col("d")) & (F.col("parent") == F.col("n")) & (F.size("p") <= depth))
        on = on.where(~F.exists("p", lambda s: s["node"] == F.col("child")))
        step = F.struct("ord", "item", F.col("child").alias("node"), F.col("name").alias("name"))
        found = begin.union(on.select("doc", F.col("child").alias("node"), F.concat("p", F.array(step)).alias("path")))
        order = F.transform("path", lambda s: F.struct(s["ord"], s["item"]))
        new = written(found.groupBy("doc", "node").agg(F.min_by("path", order).alias("path")))
        old = best.select(F.col("doc").alias("d"), F.col("node").alias("n"), F.col("path").alias("p"))
        same = new.join(old, (F.col("doc") == F.col("d")) & (F.col("node") == F.col("n")) & (F.col("path") == F.col("p")), "left_anti")
        best = new
        if same.isEmpty():
            return best
    raise ValueError("objects hold each other too deeply for the limit of levels")


def scan_objects(
    links: DataFrame, roots: DataFrame, depth: int = MOST_DEPTH, nodes: int = MOST_NODES, items: int = MOST_ITEMS, between: str = " > "
) -> DataFrame:
    """(S11, S12, T9) (doc, position, node, parent, level, path, children) of what can be reached from a document's roots.

    links: (doc, parent, ord, item, child, name): collections of a parent go by ord, their items by item. roots: (doc, ord, item,
    node, name). An object is entered once, where a walk in order first meets it, so objects that hold each other end; position
    numbers the walk from 1, and children counts those entered below a node. More than `items` items of a collection, `nodes`
    nodes of a document, or a link below level `depth` raise: nothing is left out. What no root reaches has no row; null
    ends of links are no objects.
    """
    own = links.where("parent IS NOT NULL AND child IS NOT NULL").select("doc", "parent", "ord", "item", "child", "name").dropDuplicates(["doc", "parent", "ord", "item", "child"])
    _limit(own.groupBy("doc", F.col("parent").alias("node"), "ord").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > items), "a collection of {node} has {n} items")
    tops = roots.where("node IS NOT NULL").select("doc", "ord", "item", "node", "name").groupBy("doc", "node").agg(F.min(F.struct("ord", "item", "name")).alias("r")).select("doc", "r.ord", "r.item", "node", "r.name")
    entries = own.select("doc", F.col("child").alias("node")).union(tops.select("doc", "node"))
    shared = not entries.groupBy("doc", "node").count().where("count > 1").isEmpty()
    found = (_resolved_graph if shared else _resolved_trees)(own, tops, depth)
    found = found.select("doc", "node", "path", (F.size("path") - 1).alias("level"))
    last = found.where(F.col("level") >= depth).select(F.col("doc").alias("d"), F.col("node").alias("p"))
    _limit(own.join(last, (F.col("doc") == F.col("d")) & (F.col("parent") == F.col("p"))).select("doc", F.col("child").alias("node"), F.lit(depth).alias("n")), "{node} lies deeper than level {n}")
    _limit(found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).select("doc", F.lit("").alias("node"), "n").where(F.col("n") > nodes), "{n} nodes")
    order = F.transform("path", lambda s: F.struct(s["ord"], s["item"]))
    # A document's nodes are at most `nodes`, so a window over them is bounded.
    placed = found.withColumn("position", F.row_number().over(Window.partitionBy("doc").orderBy(order)))
    placed = placed.withColumn("parent", F.get(F.col("path"), F.col("level") - 1)["node"]).withColumn("full", F.array_join(F.transform("path", lambda s: or_empty(s["name"].cast("string"))), between))
    children = placed.where("parent IS NOT NULL").groupBy(F.col("doc").alias("d"), F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("children"))
    out = placed.join(children, (F.col("doc") == F.col("d")) & (F.col("node") == F.col("p")), "left")
    return out.select("doc", "position", "node", "parent", "level", F.col("full").alias("path"), F.coalesce("children", F.lit(0)).alias("children"))


@dataclass(frozen=True)
class Field:
    """A column of a record: where its value may stand (the first place that has one counts), and its type."""

    name: str
    places: Sequence[str]
    kind: str = "string"


OK, EMPTY, PARTIAL, ERROR = "OK", "EMPTY", "PARTIAL", "ERROR"


def _read(v: Column, f: Field) -> tuple[Column, Column, Column]:
    """(place of the field's value, the value as it stands, the value as the field's type). A JSON null is no value."""
    raw = [F.variant_get(v, p, "string") for p in f.places]
    at = F.coalesce(*[F.when(r.isNotNull(), F.lit(p)) for p, r in zip(f.places, raw, strict=True)])
    value = F.coalesce(*raw)
    typed = {"string": F.when(value.isNotNull(), clean_space(value)), "double": F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")}
    return at, value, typed.get(f.kind, value.try_cast(f.kind))


def scan_records(df: DataFrame, key: Sequence[str], raw: str, fields: Sequence[Field]) -> DataFrame:
    """(S13) A row per row of df: its key, the fields, read_status and diagnostic. raw is JSON text.

    A record that is no JSON is an ERROR, null or blank text EMPTY; a value that is not of its field's type is null and its record
    PARTIAL; the diagnostic says why. No record is lost and none stops another.
    """
    v = F.col("_v")
    parsed = df.select(*key, F.col(raw).alias("_raw"), F.try_parse_json(raw).alias("_v"))
    blank = or_empty(F.col("_raw")) == ""
    columns, wrong = [], []
    for f in fields:
        at, value, typed = _read(v, f)
        columns.append(typed.alias(f.name))
        wrong.append(F.when(value.isNotNull() & typed.isNull(), F.concat(F.lit(f"{f.name}: not a {f.kind}: "), value)))
    reasons = F.array_compact(F.array(*wrong))
    status = F.when(blank, EMPTY).when(v.isNull(), ERROR).when(F.size(reasons) > 0, PARTIAL).otherwise(OK)
    why = F.when(blank, "no record").when(v.isNull(), F.concat(F.lit("no JSON: "), F.left("_raw", F.lit(40)))).otherwise(F.array_join(reasons, "; "))
    return parsed.select(*key, *columns, status.alias("read_status"), why.alias("diagnostic"))


def audit_records(df: DataFrame, key: Sequence[str], raw: str, fields: Sequence[Field]) -> DataFrame:
    """(S14) A row per record and member of it, known or not, as it stands and as its field reads it: key, member, raw_value,
    field (empty for members that no field takes), normalised_value, validation_status (ok, invalid, unused, or
    not_available for records that cannot be read, which have one row), error."""
    parsed = df.select(*key, F.col(raw).alias("_raw"), F.try_parse_json(raw).alias("_v"))
    readable = F.col("_v").isNotNull() & (F.schema_of_variant("_v").startswith("OBJECT"))
    blank = or_empty(F.col("_raw")) == ""
    spark = df.sparkSession
    members = parsed.where(readable).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*key, F.col("key").alias("member"), F.col("value").cast("string").alias("raw_value"), "_v")
    field, value, taken = F.lit(""), F.lit(None).cast("string"), F.lit(False)
    for f in reversed(fields):
        at, _, typed = _read(F.col("_v"), f)
        here = at == F.concat(F.lit("$."), F.col("member"))
        field, value = F.when(here, f.name).otherwise(field), F.when(here, typed.cast("string")).otherwise(value)
    members = members.withColumn("field", F.coalesce(field, F.lit(""))).withColumn("normalised_value", value)
    taken = F.col("field") != ""
    bad = taken & F.col("normalised_value").isNull()
    members = members.select(
        *key, "member", "raw_value", "field", "normalised_value", F.when(bad, "invalid").when(taken, "ok").otherwise("unused").alias("validation_status"),
        F.when(bad, F.concat(F.lit("not readable: "), "raw_value")).otherwise("").alias("error"),
    )
    none = F.lit(None).cast("string")
    lost = parsed.where(~F.coalesce(readable, F.lit(False))).select(
        *key, F.lit("").alias("member"), F.col("_raw").alias("raw_value"), F.lit("").alias("field"), none.alias("normalised_value"), F.lit("not_available").alias("validation_status"),
        F.when(blank, "no record").when(F.col("_v").isNull(), "no JSON").otherwise("no members").alias("error"),
    )
    return members.unionByName(lost)
