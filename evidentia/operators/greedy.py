"""Order-dependent state, one group (picture, segment, parent) at a time.

Rows are hash-partitioned by group and sorted within partitions by Spark; a task then walks its rows once, run after run, so
thousands of small groups share one Arrow batch and a task holds one batch and one group. Groups are one picture's or one
parent's rows, so they are small by nature. Where they need not be, they are cut first: C1 and C3 at safe breaks, where no later
row can reach what came before, and suppression is decided in rounds over the whole cluster (`suppressed`).

Where the order of rows matters, rows that share the ordering columns go by all their columns, so results do not depend on
partitions.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import written


def _walk(df: DataFrame, key: list[str], order: list[Column], finished: Callable[[pa.Table, list[tuple]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """What `finished` makes of whole groups, a table of them and their rows' keys at a time, in a task's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[pa.Table, list[tuple]]] = []  # the pieces of the group that is still open

        def held() -> Iterator[pa.RecordBatch]:
            if rest:
                yield from finished(pa.concat_tables([t for t, _ in rest]), [k for _, keys in rest for k in keys])
                rest.clear()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = list(zip(*[t.column(c).to_pylist() for c in key], strict=True))
            if not keys:
                continue
            if rest and rest[-1][1][-1] != keys[0]:
                yield from held()
            cut = len(keys)
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if cut:
                rest.append((t.slice(0, cut), keys[:cut]))
                yield from held()
            rest.append((t.slice(cut), keys[cut:]))
        yield from held()

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, ddl)


def _each(keys: list[tuple]) -> Iterator[tuple[int, int]]:
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield at, i
            at = i


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def _fields(ddl: str) -> list[pa.Field]:
    return [pa.field(n, _KINDS[k]) for n, k in (a.split() for a in ddl.split(", "))] if ddl else []


def by_group(df: DataFrame, key: list[str], order: list[Column], inputs: list[str], fn: Callable[[list[tuple]], list], added: str) -> DataFrame:
    """df with columns `added` (a DDL string, may be empty). fn gets a group's input tuples in order and gives for each the tuple
    of added values, or None where the row goes."""
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ([added] if added else []))
    extra = _fields(added)

    def finished(t: pa.Table, keys: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(zip(*[t.column(c).to_pylist() for c in inputs], strict=True))
        out: list = []
        for i, j in _each(keys):
            out += fn(rows[i:j])
        kept = t.filter(pa.array([o is not None for o in out]))
        values = [o for o in out if o is not None]
        for n, field in enumerate(extra):
            kept = kept.append_column(field.name, pa.array([v[n] for v in values], field.type))
        yield from kept.to_batches()

    return _walk(df, key, order, finished, ddl)


def per_group(df: DataFrame, key: str, order: list[Column], inputs: list[str], fn: Callable[[list[tuple]], list[tuple]], made: str) -> DataFrame:
    """The key and the rows of `made` (a DDL string) that fn gives for each group's input tuples in order."""
    fields = _fields(made)
    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, {made}"

    def finished(t: pa.Table, keys: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(zip(*[t.column(c).to_pylist() for c in inputs], strict=True))
        out = [(keys[i][0], *o) for i, j in _each(keys) for o in fn(rows[i:j])]
        if out:
            columns = list(zip(*out, strict=True))
            types = [t.schema.field(key).type, *[f.type for f in fields]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=[key, *[f.name for f in fields]])

    return _walk(df, [key], order, finished, ddl)


def whole_groups(df: DataFrame, key: str, order: list[Column], fn: Callable[[pa.Table], pa.Table | None], ddl: str) -> DataFrame:
    """The rows of `ddl` that fn makes of each group's table of rows in order. Rows stay in Arrow columns, a group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []  # the pieces of the group that is still open
        last = None

        def held() -> Iterator[pa.RecordBatch]:
            if rest and (made := fn(pa.concat_tables(rest))) is not None:
                yield from made.to_batches()
            rest.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).dictionary_encode(null_encoding="encode")
            codes = keys.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            t = pa.Table.from_batches([batch])
            for i, j in zip(cuts, cuts[1:], strict=False):
                own = keys.dictionary[int(codes[i])].as_py()
                if own != last:
                    yield from held()
                rest.append(t.slice(i, j - i))
                last = own
        yield from held()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, ddl)


def all_columns(df: DataFrame, *first: str) -> list[Column]:
    """An order by some columns and then by all others that can be compared."""
    return [F.col(c) for c in first] + [F.col(f.name) for f in df.schema if f.name not in first and not isinstance(f.dataType, (T.MapType, T.VariantType))]


def in_runs(df: DataFrame, key: str, y: str, reach: Column, order: list[Column], inputs: list[str], fn: Callable[[list[tuple]], list], added: str) -> DataFrame:
    """Groups of rows in order of y that are numbered from 0 by fn, cut into runs that do not know of each other.

    A row reaches back by `reach` at most, so before a row from which on all rows reach less far back than to the row before it,
    everything held so far is closed: fn sees runs, in parallel, and a run's numbers begin after those of the runs before it."""
    w = Window.partitionBy(key).orderBy(*order)
    least = F.min("_r").over(w.rowsBetween(0, Window.unboundedFollowing))
    back = df.withColumn("_r", F.col(y) - reach).withColumn("_b", (least > F.lag(y).over(w)).cast("int")).withColumn("_run", F.sum(F.coalesce("_b", F.lit(0))).over(w)).drop("_r", "_b")
    done = written(by_group(back, [key, "_run"], order, inputs, fn, added))
    many = done.groupBy(F.col(key).alias("_k"), F.col("_run").alias("_n")).agg((F.max(added.split()[0]) + 1).alias("_m"))
    start = many.withColumn("_s", F.sum("_m").over(Window.partitionBy("_k").orderBy("_n")) - F.col("_m"))
    name = added.split()[0]
    joined = done.join(start, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_run") == F.col("_n")))
    return joined.select(*df.columns, (F.col(name) + F.col("_s")).cast("int").alias(name))


def merge_evidence(df: DataFrame, key: str, y: str, lane: str, height: str, step: str) -> DataFrame:
    """(C1) Add node: rows in order of (y, lane, then all columns) join the nearest node within max(18, 0.4 height) in y and
    max(5, 0.3 step) in lane, or failing that in y alone; a node's y is the median of its rows."""

    def run(rows: list[tuple]) -> list:
        ys: list[list[float]] = []
        centre: list[float] = []
        lanes: list[float] = []
        out = []
        for yy, ll, hh, ss in rows:
            near = [k for k, c in enumerate(centre) if abs(c - yy) <= max(18.0, 0.4 * hh)]
            near = [k for k in near if abs(lanes[k] - ll) <= max(5.0, 0.3 * ss)] or near
            if near:
                k = min(near, key=lambda k: abs(centre[k] - yy))
                insort(ys[k], yy)
                centre[k] = _middle(ys[k])
            else:
                k = len(ys)
                ys.append([yy])
                centre.append(yy)
                lanes.append(ll)
            out.append((k,))
        return out

    return in_runs(df, key, y, F.greatest(F.lit(18.0), 0.4 * F.col(height)), all_columns(df, y, lane), [y, lane, height, step], run, "node int")


def group_rows(df: DataFrame, key: str, y: str, x: str, tolerance: float = 10.0) -> DataFrame:
    """(C3) Add row: words in order of (y, x, then all columns) join the row with the nearest centre within the tolerance; centres
    are medians."""

    def run(rows: list[tuple]) -> list:
        held: list[list[float]] = []
        centre: list[float] = []
        out = []
        for (yy,) in rows:
            near = [k for k, c in enumerate(centre) if abs(c - yy) <= tolerance]
            if near:
                k = min(near, key=lambda k: abs(centre[k] - yy))
            else:
                k = len(held)
                held.append([])
                centre.append(0.0)
            insort(held[k], yy)
            centre[k] = _middle(held[k])
            out.append((k,))
        return out

    return in_runs(df, key, y, F.lit(tolerance), all_columns(df, y, x), [y], run, "row int")


def _middle(values: list[float]) -> float:
    """The median of sorted values."""
    n = len(values)
    return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2


@dataclass(frozen=True)
class Rule:
    """When two boxes cannot both stay. `conflict` says so of two structs of `columns`; cells(b) are the cells (arrays of whole numbers)
    that a box stands in, one each, and probes(b) those in which it finds all boxes that it may conflict with, and itself: boxes
    of one cell have the same probes, so what a cell's first box finds goes for all of them."""

    columns: dict[str, Column]
    conflict: Callable[[Column, Column], Column]
    cells: Callable[[Column], Column]
    probes: Callable[[Column], Column]


def _around(x: Column, y: Column, *rest: Column) -> Column:
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.array(x + i, y + j, *rest))))


def near_centres(x: Column, y: Column, apart: float) -> Rule:
    """(C10, J22) Centres closer than `apart`."""
    at = lambda c: F.floor(c / apart).cast("long")
    return Rule(
        {"x": x.cast("double"), "y": y.cast("double")}, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]) < apart,
        lambda b: F.array(F.array(at(b["x"]), at(b["y"]))), lambda b: _around(at(b["x"]), at(b["y"])),
    )


def near_turned(x: Column, y: Column, height: Column, angle: Column, tallest: float, least: float = 8.0, share: float = 0.45, degrees: float = 3.0) -> Rule:
    """(C10) Centres within max(least, share of both heights together), of angles at most `degrees` apart. Cells are as wide as two
    boxes of the height `tallest` reach; a taller box is an error."""
    size = max(least, 2 * share * tallest)
    at = lambda c: F.floor(c / size).cast("long")
    fit = F.when(height > tallest, F.raise_error(F.lit(f"a box is taller than {tallest}"))).otherwise(height)

    def conflict(a: Column, b: Column) -> Column:
        near = F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= F.greatest(F.lit(least), share * (a["h"] + b["h"]))
        return near & (F.abs(a["t"] - b["t"]) <= degrees)

    return Rule(
        {"x": x.cast("double"), "y": y.cast("double"), "h": fit.cast("double"), "t": angle.cast("double")}, conflict,
        lambda b: F.array(F.array(at(b["x"]), at(b["y"]))), lambda b: _around(at(b["x"]), at(b["y"])),
    )


def near_equal(x: Column, y: Column, width: Column, height: Column, place: float = 3.0, size: float = 5.0) -> Rule:
    """(C7) Boxes whose centres differ by at most `place` and whose sides by at most `size`, each way."""
    at = lambda c, s: F.floor(c / s).cast("long")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))

    def conflict(a: Column, b: Column) -> Column:
        return (F.abs(a["x"] - b["x"]) <= place) & (F.abs(a["y"] - b["y"]) <= place) & (F.abs(a["w"] - b["w"]) <= size) & (F.abs(a["h"] - b["h"]) <= size)

    def probes(b: Column) -> Column:
        four = F.transform(near, lambda k: F.transform(near, lambda m: F.array(at(b["w"], size) + k, at(b["h"], size) + m)))
        return F.flatten(F.transform(_around(at(b["x"], place), at(b["y"], place)), lambda c: F.transform(F.flatten(four), lambda s: F.concat(c, s))))

    return Rule(
        {"x": x.cast("double"), "y": y.cast("double"), "w": width.cast("double"), "h": height.cast("double")}, conflict,
        lambda b: F.array(F.array(at(b["x"], place), at(b["y"], place), at(b["w"], size), at(b["h"], size))), probes,
    )


def suppressed(df: DataFrame, key: str, order: list[Column], rule: Rule, most: int | None = None) -> DataFrame:
    """(C7-C10, J22) The rows that stay of each group: in ascending order (equal rows by all columns) a row stays unless one that
    stays conflicts with it; with `most`, that many first ones of each group.

    Rounds over the cluster, no group in one task: a row that comes first of all open rows in the cells around it stays, and what it
    conflicts with goes. Only the first row of a cell and rows that stay are told to the cells around, and of these few share a
    cell, so rounds cost in proportion to the open rows. Equal boxes are one, the first."""
    rank = Window.partitionBy(key, "_b").orderBy("_o")
    box = F.struct(*[c.alias(n) for n, c in rule.columns.items()])
    by = F.struct(*[c.alias(f"_{k}") for k, c in enumerate([*order, *all_columns(df)])])
    rows = df.withColumn("_b", box).withColumn("_o", by)
    # Rows without a place conflict with nothing.
    placeless = F.coalesce(*[F.when(F.col(f"_b.{n}").isNull(), F.lit(True)) for n in rule.columns], F.lit(False))
    rows = rows.withColumn("_n", F.row_number().over(rank)).where((F.col("_n") == 1) | placeless).drop("_n").withColumn("_free", placeless)
    rows = written(rows.withColumn("_id", F.monotonically_increasing_id()))
    open_ = rows.where("NOT _free").select(key, "_id", "_o", "_b", rule.cells(F.col("_b")).alias("_cs"))
    stay = rows.where("_free").select("_id")
    # Cells and probes are many more than the tables' sizes tell, so no side of these joins goes to the driver.
    while True:
        tops = open_.withColumn("_c", F.explode("_cs")).groupBy(key, "_c").agg(F.min(F.struct("_o", "_b")).alias("_t"))
        around = tops.select(F.col(key).alias("_k"), F.col("_t._o").alias("_first"), F.explode(F.array_distinct(rule.probes(F.col("_t._b")))).alias("_q")).groupBy("_k", "_q").agg(F.min("_first").alias("_first"))
        own = open_.withColumn("_c", F.explode("_cs")).join(around.hint("merge"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_c") == F.col("_q")))
        chosen = written(own.where(F.col("_first") >= F.col("_o")).select(*open_.columns))
        if chosen.isEmpty():
            break
        stay = stay.union(chosen.select("_id"))
        left = open_.join(chosen.select(F.col("_id").alias("_w")).hint("merge"), F.col("_id") == F.col("_w"), "left_anti")
        against = chosen.select(F.col(key).alias("_k"), F.explode(F.array_distinct(rule.probes(F.col("_b")))).alias("_q"), F.col("_b").alias("_d"))
        seen = left.select(key, "_id", "_b", F.explode("_cs").alias("_c"))
        gone = seen.join(against.hint("merge"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_c") == F.col("_q"))).where(rule.conflict(F.col("_d"), F.col("_b"))).select(F.col("_id").alias("_w")).distinct()
        open_ = written(left.join(gone.hint("merge"), F.col("_id") == F.col("_w"), "left_anti"))
    out = rows.join(stay.select(F.col("_id").alias("_w")).hint("merge"), F.col("_id") == F.col("_w"), "left_semi")
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_o"))).where(F.col("_n") <= most)
    return out.select(*df.columns)


def suppress_boxes(df: DataFrame, key: str, box: tuple[str, str, str, str], order: list[Column], cut: float, most: int | None = None) -> DataFrame:
    """(C7-C10) Boxes kept in the given order unless they overlap a kept one by more than `cut` (intersection over union)."""

    def run(rows: list[tuple]) -> list:
        kept: list[tuple] = []
        out: list = []
        for x, y, w, h in rows:
            ok = most is None or len(kept) < most
            for a, b, c, d in kept if ok else ():
                i = max(0.0, min(x + w, a + c) - max(x, a)) * max(0.0, min(y + h, b + d) - max(y, b))
                if i > cut * (w * h + c * d - i):
                    ok = False
                    break
            if ok:
                kept.append((x, y, w, h))
            out.append(() if ok else None)
        return out

    return by_group(df, [key], order, list(box), run, "")


def touching_components(df: DataFrame, key: str, node: str, box: tuple[str, str, str, str], gap: float) -> DataFrame:
    """(C4, C5) Add component: the least node of the boxes that touch within `gap`, directly or through others. A sweep from left
    to right compares only boxes that can still touch."""

    def run(rows: list[tuple]) -> list:
        up = list(range(len(rows)))

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        open_: list[int] = []
        for i, (_, x, y, w, h) in enumerate(rows):
            open_ = [j for j in open_ if rows[j][1] + rows[j][3] + gap >= x]
            for j in open_:
                if rows[j][2] <= y + h + gap and y <= rows[j][2] + rows[j][4] + gap:
                    p, q = top(i), top(j)
                    if rows[p][0] > rows[q][0]:
                        p, q = q, p
                    up[q] = p
            open_.append(i)
        return [(rows[top(k)][0],) for k in range(len(rows))]

    return by_group(df, [key], [F.col(box[0])], [node, *box], run, "component long")


#: Letters that end an identifier and the digit each is misread from.
SEQUENCE_LOOKS = {"O": "0", "I": "1", "L": "1", "Z": "2", "S": "5"}


def infer_sequence(df: DataFrame, key: list[str], pos: str, text: str) -> DataFrame:
    """(W7) Add inferred_text, inferred: a sibling whose last letter looks like the digit that continues two consecutive ones of
    its prefix among the four before it gets that number; later siblings see it."""

    def run(rows: list[tuple]) -> list:
        texts = [r[0] or "" for r in rows]
        out = []
        for i, t in enumerate(texts):
            m = re.fullmatch(r"([A-Za-z]+)([OILSZ])", t) if i >= 2 else None
            if m:
                past = [re.fullmatch(re.escape(m[1]) + r"(\d+)", p) for p in texts[max(0, i - 4) : i]]
                n = [int(p[1]) for p in past if p]
                if len(n) >= 2 and n[-2] + 1 == n[-1] and str(n[-1] + 1) == SEQUENCE_LOOKS[m[2]]:
                    texts[i] = f"{m[1]}{n[-1] + 1}"
            out.append((texts[i], texts[i] != t))
        return out

    return by_group(df, key, [F.col(pos)], [text], run, "inferred_text string, inferred boolean")


def recover_sequence(df: DataFrame, key: list[str], pos: str, current: str, options: str, recent: int | None = None) -> DataFrame:
    """(W8; with recent W9) Add chosen, replaced. In order, a row's code that was seen before (or among the last `recent`) gives
    way to its best unseen option (array<struct<score, code>>); without one the row goes (with recent: only if it had others)."""

    def run(rows: list[tuple]) -> list:
        seen: list[str] = []
        out: list = []
        for own, more in rows:
            free = sorted((-o["score"], o["code"]) for o in more or () if o["code"] not in seen)
            double = own is not None and own in (seen if recent is None else seen[-recent:])
            new = free[0][1] if free and (own is None or double) else None
            if double and new is None and (recent is None or len(more or ()) > 1):
                out.append(None)
                continue
            pick = new or own
            if pick:
                seen.append(pick)
            out.append((pick, new is not None))
        return out

    return by_group(df, key, [F.col(pos)], [current, options], run, "chosen string, replaced boolean")


def assign_greedily(df: DataFrame, key: str, item: str, code: str, score: str) -> DataFrame:
    """(J20) One-to-one pairs by descending score, ties by item and code."""

    def run(rows: list[tuple]) -> list:
        items, codes, out = set(), set(), []
        for i, c in rows:
            ok = i not in items and c not in codes
            if ok:
                items.add(i)
                codes.add(c)
            out.append(() if ok else None)
        return out

    return by_group(df, [key], [F.col(score).desc(), F.col(item), F.col(code)], [item, code], run, "")


def control_step(df: DataFrame, key: str, pos: str, ratio: str, start: float = 90.0, low: float = 45.0, high: float = 180.0) -> DataFrame:
    """(Z2) Add step: a feedback control. Little change makes the next step longer, much makes it shorter, within bounds."""

    def run(rows: list[tuple]) -> list:
        step, out = start, []
        for (r,) in rows:
            out.append((step,))
            step = min(high, max(low, step * (1.25 if r < 0.02 else 1.20 if r < 0.10 else 0.75 if r > 0.60 else 1.0)))
        return out

    return by_group(df, [key], [F.col(pos)], [ratio], run, "step double")


def spaced_peaks(df: DataFrame, key: str, x: str, weight: str, bin_: float = 1.0, apart: float = 1.6, most: int = 9) -> DataFrame:
    """(A20) Heaviest bins that lie at least `apart` from any chosen before, at most `most`."""
    bins = df.groupBy(key, (F.bround(F.col(x) / bin_) * bin_).alias("bin")).agg(F.round(F.sum(weight), 6).alias("w"))

    def run(rows: list[tuple]) -> list:
        got: list[float] = []
        out: list = []
        for (b,) in rows:
            ok = len(got) < most and all(abs(b - o) >= apart for o in got)
            if ok:
                got.append(b)
            out.append(() if ok else None)
        return out

    return by_group(bins, [key], [F.col("w").desc(), F.col("bin")], ["bin"], run, "")
