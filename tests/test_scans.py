"""Object and record scans, workbooks, alike labels, crowded pictures, runs of evidence."""

import random
import zipfile
from difflib import SequenceMatcher
from math import hypot
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import greedy, match, pictures, scan
from evidentia.sources import readers, workbook

LINKS = "doc int, parent string, ord int, item int, child string, name string"
ROOTS = "doc int, ord int, item int, node string, name string"


def walked(links, roots):
    """A walk in order that enters every object once."""
    out = []
    for doc in sorted({r[0] for r in roots}):
        seen = {}

        def enter(node, parent, level, path, doc=doc, seen=seen):
            if node in seen:
                return
            row = [doc, len(seen) + 1, node, parent, level, path, 0]
            seen[node] = row
            if parent:
                seen[parent][6] += 1
            for _, _, _, _, child, name in sorted((x for x in links if x[0] == doc and x[1] == node), key=lambda x: (x[2], x[3])):
                enter(child, node, level + 1, f"{path} > {name}")

        for _, _, _, node, name in sorted((r for r in roots if r[0] == doc), key=lambda r: (r[1], r[2])):
            enter(node, None, 0, name)
        out += [tuple(r) for r in seen.values()]
    return out


def scanned(spark, links, roots, **kw):
    df = scan.scan_objects(spark.createDataFrame(links, LINKS).repartition(3), spark.createDataFrame(roots, ROOTS), **kw)
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed", range(4))
def test_scan_of_objects_that_hold_each_other(spark, seed):
    rng = random.Random(seed)
    links, roots = [], []
    for doc in range(6):
        n = rng.randrange(2, 9)
        roots += [(doc, 0, k, f"n{k}", f"N{k}") for k in range(rng.randrange(1, 3))]
        for k in range(n * 2):
            a, b = rng.randrange(n), rng.randrange(n)
            links.append((doc, f"n{a}", rng.randrange(3), k, f"n{b}", f"N{b}"))
    assert scanned(spark, links, roots) == walked(links, roots)


def test_scan_of_trees_deep_and_unreached(spark):
    links = [(1, f"n{k}", 0, 1, f"n{k + 1}", f"N{k + 1}") for k in range(18)] + [(1, "lost", 0, 1, "more", "x"), (1, "a", 0, 1, "b", "x"), (1, "b", 0, 1, "a", "x"), (2, "n0", 0, 1, "n1", "other"), (1, None, 0, 1, None, "x")]
    roots = [(1, 0, 0, "n0", "N0"), (2, 0, 0, "n0", "top")]
    assert scanned(spark, links, roots) == walked(links[:-1], roots)
    for bad, kw in (({"depth": 17}, "deeper"), ({"nodes": 18}, "19 nodes"), ({"items": 0}, "items")):
        with pytest.raises(ValueError, match=kw):
            scanned(spark, links, roots, **bad)
    assert scanned(spark, [], roots) == [(1, 1, "n0", None, 0, "N0", 0), (2, 1, "n0", None, 0, "top", 0)]
    assert scanned(spark, [], []) == []


def test_scan_raises_below_a_shared_object_that_is_too_deep(spark):
    links = [(1, f"n{k}", 0, 1, f"n{k + 1}", "x") for k in range(5)] + [(1, "n0", 0, 2, "n3", "x")]
    assert len(scanned(spark, links, [(1, 0, 0, "n0", "r")], depth=5)) == 6
    with pytest.raises(ValueError, match="deeper"):
        scanned(spark, links, [(1, 0, 0, "n0", "r")], depth=4)


FIELDS = (scan.Field("n", ("$.n", "$.count"), "int"), scan.Field("t", ("$.t",)), scan.Field("v", ("$.v.x",), "double"))


def test_records_keep_their_errors(spark):
    rows = [(1, '{"n": 3, "t": " a  b ", "v": {"x": "1,5"}}'), (2, '{"count": "4"}'), (3, '{"n": "x", "t": null}'), (4, "{"), (5, None), (6, "  "), (7, "[1]"), (8, '{"n": 1e99}'), (1, '{"n": 3}')]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = [tuple(r) for r in scan.scan_records(df, ["id"], "raw", FIELDS).orderBy("id", F.col("t").desc()).collect()]
    assert got[:2] == [(1, 3, "a b", 1.5, "OK", ""), (1, 3, None, None, "OK", "")]
    assert [g[4] for g in got[2:]] == ["OK", "PARTIAL", "ERROR", "EMPTY", "EMPTY", "OK", "PARTIAL"]
    assert got[3][5].startswith("n: not a int: x") and got[4][5] == "no JSON: {"
    audit = [tuple(r) for r in scan.audit_records(df, ["id"], "raw", FIELDS).collect()]
    assert {(a[0], a[1], a[5]) for a in audit} == {(1, "n", "ok"), (1, "t", "ok"), (1, "v", "unused"), (2, "count", "ok"), (3, "n", "invalid"), (3, "t", "unused"), (4, "", "not_available"), (5, "", "not_available"), (6, "", "not_available"), (7, "", "not_available"), (8, "n", "invalid")}
    assert scan.scan_records(df.limit(0), ["id"], "raw", FIELDS).count() == 0


# Workbooks


def test_workbook_round_trip(spark, tmp_path):
    odd = ["", " a ", "x\ny", "<&>\"'", "\x01\x0b_x0041_\r", "é日\U0001f600", "1.0", None]
    df = spark.createDataFrame([(i, odd[i % 8], i / 4, i % 3 == 0, [i]) for i in range(300)], "n long, s string, d double, b boolean, a array<int>").repartition(4, "n").sortWithinPartitions("n")
    path = str(tmp_path / "out" / "book.xlsx")
    workbook.write_workbook({"First": df, "None": df.limit(0), "Other & more": df.select("s")}, path)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["book.xlsx"]
    back = workbook.read_workbooks(spark, path, "line long, n long, s string, d double, b boolean, a string, error string", sheet="First").collect()
    assert [(r.n, r.s, r.d, r.b, r.a) for r in sorted(back, key=lambda r: r.line)] == [(r.n, r.s, r.d, r.b, f"[{r.n}]") for r in df.collect()] and not any(r.error for r in back)
    every = workbook.read_workbooks(spark, str(tmp_path / "out"), sheet="*").groupBy("sheet").count().collect()
    assert {(r.sheet, r["count"]) for r in every} == {("First", 300), ("Other & more", 300)}
    workbook.write_workbook({"First": df.limit(2)}, path)
    assert workbook.read_workbooks(spark, path).count() == 2


def test_nothing_is_seen_of_a_failed_write(spark, tmp_path):
    good = spark.range(50).select(F.col("id").cast("string").alias("s"))
    path = tmp_path / "b.xlsx"
    with pytest.raises(Exception, match="32767"):
        workbook.write_workbook({"S": good.union(spark.range(1).select(F.repeat(F.lit("x"), 40_000)))}, str(path))
    assert list(tmp_path.iterdir()) == []
    workbook.write_workbook({"S": good}, str(path))
    before = path.read_bytes()
    with pytest.raises(Exception, match="32767"):
        workbook.write_workbook({"S": good.union(spark.range(1).select(F.repeat(F.lit("x"), 40_000)))}, str(path))
    assert path.read_bytes() == before and list(tmp_path.iterdir()) == [path]
    with pytest.raises(Exception, match="FileExists"):
        good.write.format("workbook").mode("append").save(str(path))
    good.write.format("workbook").mode("overwrite").option("sheet", "T").save(str(path))
    assert workbook.read_workbooks(spark, str(path)).first().sheet == "T"


def by_hand(path, sheet, shared=""):
    """A workbook as other programs write it: shared texts, cells that name their place, gaps."""
    main = workbook.MAIN[1:-1]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{workbook.LINK[1:-3]}"><sheets><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{shared}</sst>')


def test_trees_of_a_folder_of_workbooks(spark, tmp_path):
    shared = "<si><t>level</t></si><si><r><t>te</t></r><r><t>xt</t></r><rPh><t>no</t></rPh></si><si><t>leaf</t></si>"
    by_hand(
        tmp_path / "a.xlsx",
        '<row r="1"><c r="B1" t="inlineStr"><is><t>a title</t></is></c></row><row r="3"><c r="B3" t="s"><v>0</v></c><c r="D3" t="s"><v>1</v></c></row>'
        '<row r="4"><c r="B4"><v>0</v></c><c r="D4" t="inlineStr"><is><t>top</t></is></c></row><row r="5"><c r="D5" t="s"><v>2</v></c><c r="B5"><v>1</v></c></row>'
        '<row r="6"><c r="B6" t="str"><v>deep</v></c><c r="D6" t="s"><v>9</v></c></row><row r="7"><c r="B7"><v>2</v></c><c r="D7" t="e"><v>#REF!</v></c></row>', shared)
    by_hand(tmp_path / "b.xlsx", '<row><c t="inlineStr"><is><t>text</t></is></c></row><row><c><v>1</v></c></row>')
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("x", "y")
    (tmp_path / "~$a.xlsx").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(b"")
    workbook.write_workbook({"TREE": spark.createDataFrame([("n", "up", 0), ("m", "down", 1)], "node_id string, text string, level int").coalesce(1)}, str(tmp_path / "sub" / "f.xlsx"))
    nodes, errors = readers.workbook_trees(spark, str(tmp_path))
    got = [(r.file[-6:], r.line, r.node_id, r.parent_id, r.level, r.text) for r in nodes.orderBy("file", "line").collect()]
    assert got == [
        ("a.xlsx", 1, "X00001", "", 0, "top"), ("a.xlsx", 2, "X00002", "X00001", 1, "leaf"), ("a.xlsx", 3, "X00003", "", 0, ""), ("a.xlsx", 4, "X00004", "X00003", 2, ""),
        ("f.xlsx", 1, "n", "", 0, "up"), ("f.xlsx", 2, "m", "n", 1, "down"),
    ]
    wrong = {(r.file[-6:], r.line): r.error for r in errors.collect()}
    assert set(wrong) == {("a.xlsx", 3), ("a.xlsx", 4), ("b.xlsx", None), ("c.xlsx", None), ("d.xlsx", None)}
    assert "no shared string 9" in wrong["a.xlsx", 3] and "#REF!" in wrong["a.xlsx", 4] and "text, level" in wrong["b.xlsx", None]
    assert workbook.read_workbooks(spark, str(tmp_path), splitBytes="1").rdd.getNumPartitions() == 5


# Alike labels


def test_every_alike_pair_is_found(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 14))) for _ in range(120)]
    words += ["".join(c if rng.random() > 0.1 else rng.choice("abcdx") for c in w) + rng.choice(["", "z"]) for w in words]
    words += ["aaaa" * k for k in range(1, 30)] + [("ab" * 130)[:n] for n in (230, 240, 260)]
    rows = [(w, rng.randrange(2)) for w in words] + [(None, 0), ("", 0), ("x", 1)]
    df = spark.createDataFrame(rows, "w string, level int")
    for cut in (0.86, 0.75):
        got = {(r.level, r.w, r.w_b): r.ratio for r in match.similar_pairs(df, df, "level", "w", cut).collect()}
        want = {}
        for a, la in rows:
            for b, lb in rows:
                if a and b and la == lb and min(len(a), len(b)) >= 4 and (ratio := SequenceMatcher(None, a, b).ratio()) >= cut:
                    want[la, a, b] = ratio
        assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_anchor_shifts_against_a_loop(spark):
    rng = random.Random(8)
    words = ["general notes", "tolerances", "views", "captures", "sets", "frames"]
    rows = [(g, f, rng.randrange(2), rng.choice(words) + rng.choice(["", "x", ""]), rng.choice([30.0, 50.0, 90.0]), rng.randrange(0, 400)) for g in range(3) for f in range(5) for _ in range(14)]
    df = spark.createDataFrame(rows, "k int, f int, level int, label string, conf double, top int")
    got = {(r.k, r.f): (r["shift"], r.weight, r.second) for r in match.anchor_shifts(df, "k", "f", "level", "label", "conf", "top").collect()}
    want = {}
    for g in range(3):
        for f in range(4):
            votes = []
            for _, _, la, a, ca, ta in (r for r in rows if r[:2] == (g, f)):
                for _, _, lb, b, cb, tb in (r for r in rows if r[:2] == (g, f + 1)):
                    ratio = SequenceMatcher(None, a, b).ratio()
                    if min(len(a), len(b)) >= 4 and min(ca, cb) >= 48 and la == lb and ratio >= 0.86 and ta - tb > 10:
                        votes.append((ta - tb, ratio * min(ca, cb) / 100, a))
            bins = {}
            for v in votes:
                bins.setdefault(round(v[0] / 5) * 5, []).append(v)
            if not bins:
                continue
            best = max(bins, key=lambda b: (len({v[2] for v in bins[b]}), round(sum(v[1] for v in bins[b]), 9), -b))
            w = sum(v[1] for v in bins[best])
            shift = round(sum(v[0] * v[1] for v in bins[best]) / w) if len({v[2] for v in bins[best]}) >= 2 and w >= 0.8 else None
            want[g, f] = (shift, pytest.approx(w, abs=1e-5), pytest.approx(sum(v[1] for v in votes) - w, abs=1e-5))
    assert got == want


# Crowded pictures

BOX = "g int, i long, x double, y double, w double, h double, t double, s double"


def crowd(seed, n=160):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), i, float(rng.randrange(150)), float(rng.randrange(120)), float(rng.choice([8, 20, 24, 60, 200])), float(rng.choice([6, 20, 22, 90])), float(rng.choice([0, 2, 45])), float(rng.randrange(9))) for i in range(n)]
    return rows + rows[:3] + [(0, 999, None, 1.0, 1.0, 1.0, 0.0, 9.0)]


def staying(rows, conflict, most=None):
    kept = {}
    for r in sorted(rows, key=lambda r: (r[0], -r[7], r[1])):
        own = kept.setdefault(r[0], [])
        if (most is None or len(own) < most) and (r[2] is None or not any(k[2] is not None and conflict(r, k) for k in own)):
            own.append(r)
    return sorted(str(r) for own in kept.values() for r in own)


def centre(r):
    return r[2] + r[4] / 2, r[3] + r[5] / 2


def far(a, b):
    return hypot(*(p - q for p, q in zip(centre(a), centre(b), strict=True)))


def near(a, b):
    (ax, ay), (bx, by) = centre(a), centre(b)
    return abs(ax - bx) <= 3 and abs(ay - by) <= 3 and abs(a[4] - b[4]) <= 5 and abs(a[5] - b[5]) <= 5


def box():
    x, y, w, h = (F.col(c) for c in "xywh")
    return x + w / 2, y + h / 2, w, h


RULES = {
    "centres": (lambda: greedy.near_centres(*box()[:2], 28.0), lambda a, b: far(a, b) < 28, None),
    "first 7": (lambda: greedy.near_centres(*box()[:2], 12.0), lambda a, b: far(a, b) < 12, 7),
    "equals": (lambda: greedy.near_equal(*box()), near, None),
    "turned": (lambda: greedy.near_turned(*box()[:2], F.col("h"), F.col("t"), 90.0), lambda a, b: far(a, b) <= max(8.0, 0.45 * (a[5] + b[5])) and abs(a[6] - b[6]) <= 3, None),
}


@pytest.mark.parametrize("name", RULES)
def test_rounds_keep_what_the_loop_keeps(spark, name):
    rule, conflict, most = RULES[name]
    rows = crowd(len(name))
    got = greedy.suppressed(spark.createDataFrame(rows, BOX).repartition(5), "g", [-F.col("s"), F.col("i")], rule(), most).collect()
    assert sorted(str(tuple(r)) for r in got) == staying(rows, conflict, most)


def test_crowd_of_copies_and_no_boxes(spark):
    copies = spark.range(3000).select(F.lit(0).alias("g"), F.col("id").alias("i"), *[F.lit(v).cast("double").alias(c) for c, v in zip("xywhts", (5, 5, 9, 9, 0, 1), strict=True)])
    assert [r.i for r in greedy.suppressed(copies, "g", [-F.col("s"), F.col("i")], RULES["centres"][0]()).collect()] == [0]
    assert greedy.suppressed(copies.limit(0), "g", [F.col("i")], RULES["centres"][0]()).count() == 0


# Runs


def nodes_of(rows):
    """C1 by its words, without runs."""
    ys, lanes, out = [], [], []
    for y, lane, h, step in rows:
        centres = [median(v) for v in ys]
        close = [k for k, c in enumerate(centres) if abs(c - y) <= max(18.0, 0.4 * h)]
        close = [k for k in close if abs(lanes[k] - lane) <= max(5.0, 0.3 * step)] or close
        if close:
            k = min(close, key=lambda k: abs(centres[k] - y))
            ys[k].append(y)
        else:
            k = len(ys)
            ys.append([y])
            lanes.append(lane)
        out.append(k)
    return out


def test_runs_give_the_nodes_of_the_whole_group(spark):
    rng = random.Random(3)
    rows = [(0, i, float(rng.randrange(6000)), float(rng.randrange(3) * 20), float(rng.choice([10, 30, 90])), 20.0) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, i int, y double, lane double, h double, step double")
    got = {r.i: r.node for r in greedy.merge_evidence(df, "g", "y", "lane", "h", "step").collect()}
    order = sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1], r[4]))
    assert [got[r[1]] for r in order] == nodes_of([(r[2], r[3], r[4], r[5]) for r in order])
    tied = spark.createDataFrame([(0, i, 5.0 * (i % 4), 1.0) for i in range(40)] + [(0, 50, 500.0, 1.0)], "g int, i int, y double, x double")
    one, two = ({r.i: r.row for r in greedy.group_rows(tied.repartition(n), "g", "y", "x").collect()} for n in (1, 7))
    assert one == two and one[50] == max(one.values())


def test_recognised_rows_read_their_own_text(spark):
    df = spark.createDataFrame([(1, "2X 05A01 A 0,2", None, None), (2, None, "0,5", " c "), (3, None, None, None)], "id int, text string, tolerance_value string, references string")
    got = {r.id: r for r in readers.recognised(df, ["id"]).collect()}
    assert (got[1].series_code, got[1].multiplicity, got[1].tolerance_value, got[1].datum_a, got[1].datum_c) == ("05A01", 2, 0.2, True, False)
    assert (got[2].tolerance_value, got[2].datum_c, got[3].series_code, got[3].raw_text) == (0.5, True, None, "")


def straight(rows):
    """C4 by its words."""
    left, groups = sorted(rows, key=lambda r: (-r[6], r)), []
    turn = lambda a, b: min(abs(a - b) % 180, 180 - abs(a - b) % 180)
    from math import cos, radians, sin

    while left:
        s = left[0]
        u = (cos(radians(s[5])), sin(radians(s[5])))
        v = (-u[1], u[0])
        group = [r for r in left if r is s or (turn(r[5], s[5]) <= 5 and abs((r[1] * v[0] + r[2] * v[1]) - (s[1] * v[0] + s[2] * v[1])) <= max(16, 0.6 * max(s[4], r[4])) and abs((r[1] - s[1]) * u[0] + (r[2] - s[2]) * u[1]) <= 330)]
        groups.append(group)
        left = [r for r in left if r not in group]
    place = lambda g: (sum(r[2] for r in g) / len(g), sum(r[1] for r in g) / len(g))
    final = []
    for g in sorted(groups, key=lambda g: -sum(r[6] for r in g)):
        if not any(hypot(place(g)[0] - place(p)[0], place(g)[1] - place(p)[1]) < 45 and turn(median(r[5] for r in g), median(r[5] for r in p)) < 5 for p in final):
            final.append(g)
    return {r[0]: n for n, g in enumerate(sorted(final, key=place)) for r in g}


def test_cells_in_line(spark):
    rng = random.Random(6)
    rows = [(i, float(rng.randrange(900)), float(rng.randrange(400)), 20.0, float(rng.choice([10, 40])), float(rng.choice([0, 3, 44, 90, 178])), float(rng.randrange(50, 900))) for i in range(90)]
    df = spark.createDataFrame([(g, *r) for g in (0, 1) for r in rows], "g int, i int, x double, y double, w double, h double, t double, a double")
    got = pictures.collinear_groups(df, "g", ("x", "y", "w", "h", "t"), "a").collect()
    want = straight(rows)
    assert len(want) < 90
    for g in (0, 1):
        assert {r.i: r.group for r in got if r.g == g} == want


def test_sets_of_walls(spark):
    frame = [(10.0, 30.0), (40.0, 31.0), (42.0, 12.0), (90.0, 30.0), (140.0, 29.0)]
    rows = [(0, x + dx, 50.0, length, 50 - length / 2, 50 + length / 2) for x, length in frame for dx in (0.0, 1.5)] + [(0, 300.0, 200.0, 30.0, 185.0, 215.0), (0, 5.0, 5.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "g int, x double, m double, n double, lo double, hi double").repartition(3)
    got = pictures.wall_sets(df, "g", ("x", "m", "n", "lo", "hi")).collect()
    assert [(r.bounds, r.y1, r.y2, r.height) for r in got] == [([10.0, 40.0, 90.0, 140.0], 35.0, 65.0, 30.0)]
    assert got[0].score == pytest.approx(30 + 1.55 * 4 + 3)
    assert pictures.wall_sets(df, "g", ("x", "m", "n", "lo", "hi"), least=5).count() == 0
    assert pictures.wall_sets(df.limit(0), "g", ("x", "m", "n", "lo", "hi")).count() == 0


def test_shifts_equal_the_direct_form():
    rng = np.random.default_rng(2)
    scene = (rng.random((1400, 80)) < 0.1) * rng.random((1400, 80))
    for a, b in ((scene[:800], scene[430:1230]), (scene[300:700], scene[250:640]), (np.zeros((300, 80)), scene[:300])):
        s, r = pictures.shifts(a, b)
        height = min(len(a), len(b))
        for k in [*range(0, len(s), 37), int(np.argmax(r))]:
            n = abs(int(s[k]))
            x, y = (a[n:height], b[: height - n]) if s[k] > 0 else (a[: height - n], b[n:height])
            x, y = x.ravel() - x.mean(), y.ravel() - y.mean()
            norm = np.linalg.norm(x) * np.linalg.norm(y)
            assert r[k] == pytest.approx(float(x @ y / norm) if norm else -1.0, abs=1e-6)
    assert int(s[0]) == 10


def test_pictures_fall_back_to_labels(spark):
    rng = np.random.default_rng(3)
    scene = rng.random((300, 8)).round(3)
    rows = [(1, scene[:200].ravel().tolist(), scene[60:260].ravel().tolist()), (2, rng.random(1600).tolist(), rng.random(1600).tolist()), (3, None, [1.0]), (4, rng.random(1600).tolist(), rng.random(1600).tolist())]
    df = pictures.register_pictures(spark.createDataFrame(rows, "k int, a array<double>, b array<double>"), "a", "b", 8)
    anchors = spark.createDataFrame([(1, 5, 1.0, 0.0), (2, 33, 1.5, 0.5)], "k int, shift int, weight double, second double")
    got = {r.k: (r["shift"], r.method) for r in pictures.with_anchors(df, anchors, ["k"]).collect()}
    assert got == {1: (60, "picture"), 2: (33, "labels"), 3: (None, "none"), 4: (None, "none")}
