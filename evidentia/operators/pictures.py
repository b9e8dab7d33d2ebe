"""What is read off pictures: cells in line, sets of walls, windows of neighbouring walls, the shift between two captures.

A picture's cells and walls are few, so a task walks picture after picture (`greedy`); windows are lead() over sorted walls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from math import cos, hypot, radians, sin
from statistics import mean, median

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .greedy import all_columns, per_group, whole_groups

#: Fixed values of C4: degrees between cells of a group, least distance across and greatest along their line, distance of groups that are one.
TURN, ACROSS, ACROSS_SHARE, ALONG, SAME = 5.0, 16.0, 0.60, 330.0, 45.0


def _mean(v: np.ndarray) -> float:
    """The exact mean, rounded once. Places repeat, so each is taken once, as often as it occurs."""
    values, times = np.unique(v, return_counts=True)
    return float(sum((Fraction(a) * b for a, b in zip(values.tolist(), times.tolist(), strict=True)), Fraction(0)) / len(v))


def _turn(a: float, b: float) -> float:
    d = abs(a - b) % 180
    return min(d, 180 - d)


def collinear_groups(df: DataFrame, key: str, cell: tuple[str, str, str, str, str], area: str) -> DataFrame:
    """(C4) Add group: cells (centre x and y, width, height, angle) in line with the largest free one, by angle and by distance across
    (16, or 0.6 of the greater height) and along (330) its axis, form a group, until none is free. Of groups at one place with
    one angle the larger stays, and its cells with it; groups are numbered from 0 in reading order of their centres. Of cells
    of one area the first by all columns seeds."""

    def run(table: pa.Table) -> pa.Table | None:
        x, y, _, h, t, size = (table.column(c).cast(pa.float64()).to_numpy() for c in (*cell, area))
        free, groups = np.arange(len(x)), []
        while len(free):
            k = free[0]
            ux, uy = cos(radians(t[k])), sin(radians(t[k]))
            dx, dy, turn = x[free] - x[k], y[free] - y[k], np.abs(t[free] - t[k]) % 180
            near = (np.minimum(turn, 180 - turn) <= TURN) & (np.abs(dy * ux - dx * uy) <= np.maximum(ACROSS, ACROSS_SHARE * np.maximum(h[k], h[free]))) & (np.abs(dx * ux + dy * uy) <= ALONG)
            near[0] = True
            groups.append(free[near])
            free = free[~near]
        seen: list[tuple[float, float, float, np.ndarray]] = []
        for own in sorted(groups, key=lambda g: -sum(size[g].tolist())):
            cy, cx, turn = _mean(y[own]), _mean(x[own]), float(np.median(t[own]))
            if not any(hypot(cx - px, cy - py) < SAME and _turn(turn, pt) < TURN for py, px, pt, _ in seen):
                seen.append((cy, cx, turn, own))
        number = np.full(len(x), -1, np.int32)
        for n, (_, _, _, own) in enumerate(sorted(seen, key=lambda s: s[:2])):
            number[own] = n
        return table.append_column("group", pa.array(number)).filter(pa.array(number >= 0))

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["group int"])
    return whole_groups(df, key, [F.col(area).desc(), *all_columns(df)], run, ddl)


#: Fixed values of C6.
ONE_WALL, ONE_ROW, APART, LEAST_HEIGHT, SAME_SET, MOST_SETS = 3.3, 5.0, 5.0, 8.0, 3.0, 12


def wall_sets(df: DataFrame, key: str, wall: tuple[str, str, str, str, str], least: int = 3, most: int = MOST_SETS) -> DataFrame:
    """(C6) (key, bounds, y1, y2, height, score) of sets of walls alike in length and height, the best `most` of each picture.

    wall: x, middle y, length, low and high end. Lines at one place (3.3 across, 5 along) are one wall, the longest. Every wall
    seeds the set of those 0.70 to 1.42 times as long at its height; of walls within 5 the longer stays, and sets of fewer than
    `least` walls or under 8 high go. Of sets whose bounds differ by less than 3 on average the first in order of score stays."""

    def run(rows: list[tuple]) -> list[tuple]:
        # Rows come from left to right, so a bunch whose mean is left of a row's reach gets no more rows. Equal rows, which are
        # neighbours in this order, are in one bunch: they come once, with their number. [longest, sum x, sum y, rows, means]
        bunches: list[list] = []
        near: list[list] = []
        for *r, times in rows:
            near = [b for b in near if r[0] - b[4] <= ONE_WALL]
            home = next((b for b in near if abs(r[0] - b[4]) <= ONE_WALL and abs(r[1] - b[5]) <= ONE_ROW), None)
            if home is None:
                bunches.append(home := [r, Fraction(0), Fraction(0), 0, 0.0, 0.0])
                near.append(home)
            if r[2] > home[0][2]:
                home[0] = r
            home[1], home[2], home[3] = home[1] + Fraction(r[0]) * times, home[2] + Fraction(r[1]) * times, home[3] + times
            home[4], home[5] = float(home[1] / home[3]), float(home[2] / home[3])
        walls = [b[0] for b in bunches]
        walls = [walls[k] for k in np.argsort([w[0] for w in walls], kind="stable")]
        middle, long = (np.array([w[c] for w in walls], np.float64) for c in (1, 2))
        found = []
        for first in bunches:
            seed = first[0]
            share = long / seed[2]
            like = [walls[k] for k in np.flatnonzero((share >= 0.70) & (share <= 1.42) & (np.abs(middle - seed[1]) <= max(3.5, 0.22 * seed[2])))]
            taken: list[list] = []
            for w in like:
                if not taken or w[0] - taken[-1][0] > APART:
                    taken.append(w)
                elif w[2] > taken[-1][2]:
                    taken[-1] = w
            y1, y2 = median(w[3] for w in taken), median(w[4] for w in taken)
            if len(taken) < least or y2 - y1 < LEAST_HEIGHT:
                continue
            xs = [w[0] for w in taken]
            fit = sum(0.42 * (y2 - y1) <= b - a <= 4.8 * (y2 - y1) for a, b in zip(xs, xs[1:], strict=False))
            found.append((median(w[2] for w in taken) + 1.55 * min(len(xs), 7) + fit, xs, y1, y2))
        sets: list[tuple] = []
        for score, xs, y1, y2 in sorted(found, key=lambda f: -f[0]):
            if len(sets) == most:
                break
            if not any(len(xs) == len(s[0]) and mean(abs(a - b) for a, b in zip(xs, s[0], strict=True)) < SAME_SET for s in sets):
                sets.append((xs, y1, y2, y2 - y1, score))
        return sets

    # Walls that are equal in all columns come as one, with their number.
    each = df.where(F.col(wall[2]) > 0).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_group(each, key, all_columns(df, wall[0]), [*wall, "_n"], run, "bounds array<double>, y1 double, y2 double, height double, score double")


def wall_windows(walls: DataFrame, key: str, x: str, size: int, fits: Callable[[Sequence[Column]], Column], worth: Callable[[Sequence[Column]], Sequence[Column]], most: int = 1) -> DataFrame:
    """(W13) (key, window, rank): `size` neighbouring walls of a key for which fits(xs) holds, the best `most` by worth(xs) ascending and
    then from the left. Walls at one place are one."""
    w = Window.partitionBy(key).orderBy(x)
    names = [f"_x{k}" for k in range(size)]
    runs = walls.where(F.col(x).isNotNull()).select(key, x).distinct().select(key, *[F.lead(x, k).over(w).alias(n) for k, n in enumerate(names)]).where(F.col(names[-1]).isNotNull())
    xs = [F.col(n) for n in names]
    order = Window.partitionBy(key).orderBy(*worth(xs), *names)
    return runs.where(fits(xs)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, F.array(*xs).alias("window"), "rank")


def value_cells(walls: DataFrame, key: str, x: str, end: str, height: str, most: int = 2) -> DataFrame:
    """(W13) The two cells right of a code that ends at `end` and is `height` high: three neighbouring walls, the first cell 0.35 to 4.2
    and the second 0.35 to 5.0 heights wide, the first wall within 4 heights of the code; the nearest `most`."""
    box = F.greatest(F.col(height), F.lit(8.0))
    keyed = walls.select(F.struct(key, end, box.alias("h")).alias("_k"), x)
    tall, far = F.col("_k.h"), lambda xs: F.abs(xs[0] - F.col(f"_k.{end}"))
    fits = lambda xs: (xs[1] - xs[0]).between(0.35 * tall, 4.2 * tall) & (xs[2] - xs[1]).between(0.35 * tall, 5.0 * tall) & (far(xs) <= 4.0 * tall)
    return wall_windows(keyed, "_k", x, 3, fits, lambda xs: [far(xs)], most).select(F.col(f"_k.{key}").alias(key), F.col(f"_k.{end}").alias(end), "window", "rank")


#: Fixed values of W10.
LEAST_SHIFT, LEAST_ROWS, LEAST_SHARE, LEAST_FILLED, CLEAR, MARGIN, NEAR = 10, 120, 0.18, 80, 0.22, 0.015, 10


def shifts(before: np.ndarray, after: np.ndarray, least: int = LEAST_SHIFT, rows: int = LEAST_ROWS, share: float = LEAST_SHARE, filled: int = LEAST_FILLED) -> tuple[np.ndarray, np.ndarray]:
    """(shift, centred correlation) of all shifts either way. Products of all shifts come from one Fourier transform along the
    rows, means and norms from running sums over them."""
    height = min(len(before), len(after))
    a, b = before[:height].astype(np.float64), after[:height].astype(np.float64)
    most = height - max(rows, round(height * share))
    s = np.arange(least, most + 1)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0)
    n = 1 << (2 * height - 1).bit_length()
    cross = np.fft.irfft((np.fft.rfft(a, n, axis=0) * np.conj(np.fft.rfft(b, n, axis=0))).sum(1), n)
    run = lambda v: np.append(0.0, np.cumsum(v.sum(1)))
    tail = lambda c: c[-1] - c[s]
    head = lambda c: c[height - s]
    size = (height - s) * a.shape[1]
    out = []
    for products, x, y, of_x, of_y in ((cross[s], a, b, tail, head), (cross[n - s], a, b, head, tail)):
        mx, my = of_x(run(x)), of_y(run(y))
        vx, vy = of_x(run(x * x)) - mx * mx / size, of_y(run(y * y)) - my * my / size
        enough = (of_x(run(x != 0)) >= filled) & (of_y(run(y != 0)) >= filled) & (vx > 1e-9 * size) & (vy > 1e-9 * size)
        out.append(np.where(enough, (products - mx * my / size) / np.sqrt(np.maximum(vx * vy, 1e-300)), -1.0))
    return np.concatenate([s, -s]), np.round(np.concatenate(out), 9)


def register_pictures(df: DataFrame, before: str, after: str, width: int, near: int = NEAR, clear: float = CLEAR, margin: float = MARGIN, **least: float) -> DataFrame:
    """(W10) df without the two pictures (arrays of numbers, rows of `width` one after the other), with shift, score and second: the
    shift at which they correlate best, of equal ones the greatest, and the best one further than `near` from it (-1 without
    one). The shift is null unless the score is `clear` and `margin` above the second; pictures that are null, or too small
    to overlap, have no shift and scores of -1."""
    keep = [c for c in df.columns if c not in (before, after)]
    kinds = df.select(*keep).schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["shift int", "score double", "second double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for a, b in zip(batch.column(batch.schema.get_field_index(before)), batch.column(batch.schema.get_field_index(after)), strict=True):
                if not (a.is_valid and b.is_valid):
                    found.append((None, -1.0, -1.0))
                    continue
                one, two = (v.values.to_numpy(zero_copy_only=False) for v in (a, b))
                s, r = shifts(one[: len(one) // width * width].reshape(-1, width), two[: len(two) // width * width].reshape(-1, width), **least)
                if not len(s):
                    found.append((None, -1.0, -1.0))
                    continue
                best = np.lexsort((s, r))[-1]
                others = r[np.abs(s - s[best]) > near]
                second = float(others.max()) if len(others) else -1.0
                good = r[best] >= clear and round(r[best] - second, 9) >= margin
                found.append((int(s[best]) if good else None, float(r[best]), second))
            shift, score, second = zip(*found, strict=True) if found else ((), (), ())
            held = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*held, pa.array(shift, pa.int32()), pa.array(score, pa.float64()), pa.array(second, pa.float64())], names=[*keep, "shift", "score", "second"])

    return df.mapInArrow(run, ddl)


def with_anchors(registered: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(W10, J8) Registered pictures, those without a clear shift with what their labels say where they say anything; method says
    which: picture, labels or none."""
    said = anchors.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("shift").alias("_s"), F.col("weight").alias("_w"), F.col("second").alias("_o"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = registered.join(said, on, "left")
    use = F.col("shift").isNull() & F.col("_w").isNotNull()
    pick = lambda a, b: F.when(use, F.col(a)).otherwise(F.col(b))
    method = F.when(F.col("shift").isNotNull(), "picture").when(F.col("_s").isNotNull(), "labels").otherwise("none")
    changed = {"shift": pick("_s", "shift"), "score": pick("_w", "score"), "second": pick("_o", "second")}
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in registered.columns], method.alias("method"))
