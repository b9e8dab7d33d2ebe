"""Operators against small Python loops and the cases that the survey lists."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import numbers as N
from evidentia.functions import text as X
from evidentia.operators import greedy, lines, match, review, tree, votes


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_conflicting_votes_are_flagged(spark):
    obs = spark.createDataFrame([("98X01", 2.5, 0.92, 1), ("98X01", 0.8, 0.90, 2)], "k string, v double, c double, p int")
    (row,) = votes.consensus(obs, "k", "v", "c", "p", conflicts=True).collect()
    assert (row.winner, row.second, row.status, row.confidence) == (2.5, 0.8, "CONFLICT", 0.60)


def test_consensus_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(6)}", rng.choice([1.0, 1.4, 2.0, 2.5, None]), rng.random(), i) for i in range(200)]
    got = {r.k: (r.winner, round(r.top_weight, 6)) for r in votes.consensus(spark.createDataFrame(rows, "k string, v double, c double, p int"), "k", "v", "c", "p").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        w = {}
        for _, v, c, _ in (r for r in rows if r[0] == k and r[1] is not None):
            w[v] = w.get(v, 0) + max(0.2, c)
        w = {v: x + (0.35 * w.get(float(int(v)), 0) if v % 1 else 0) for v, x in w.items()}
        best = max(w, key=lambda v: w[v])
        want[k] = (best, round(w[best], 6))
    assert got == want


def test_parents_of_the_small_tree(spark):
    rows = [(0, 1, 0, "r"), (0, 2, 1, "a"), (0, 3, 2, "b"), (0, 4, 4, "c"), (0, 5, 2, "d"), (0, 6, 1, "e"), (0, 7, 0, "r2"), (1, 1, 2, "x"), (1, 2, 1, "y"), (1, 3, 3, "z")]
    df = tree.parents(spark.createDataFrame(rows, "s int, p int, l int, n string"), "s", "p", "l", 5)
    got = [(r.n, r.parent_pos, r.hierarchy_status) for r in df.orderBy("s", "p").collect()]
    assert got == [
        ("r", None, "root"), ("a", 1, "direct"), ("b", 2, "direct"), ("c", 3, "parent_inferred_gap"), ("d", 2, "direct"), ("e", 1, "direct"),
        ("r2", None, "root_level_unconfirmed"), ("x", None, "parent_unknown"), ("y", None, "parent_unknown"), ("z", 2, "parent_inferred_gap"),
    ]
    paths = tree.paths(spark.createDataFrame(rows, "s int, p int, l int, n string"), "s", "p", "l", 5, "n")
    assert [r.full_path for r in paths.where("s = 0").orderBy("p").collect()] == ["r", "r > a", "r > a > b", "r > a > b > c", "r > a > d", "r > e", "r2"]


def test_parents_equal_a_stack(spark):
    rng = random.Random(2)
    rows = [(s, p, rng.randrange(5)) for s in range(5) for p in range(40)]
    got = {(r.s, r.p): r.parent_pos for r in tree.parents(spark.createDataFrame(rows, "s int, p int, l int"), "s", "p", "l", 5).collect()}
    for s in range(5):
        stack = {}
        for _, p, lv in (r for r in rows if r[0] == s):
            above = [k for k in stack if k < lv]
            assert got[s, p] == (stack[max(above)] if above else None)
            stack = {k: v for k, v in stack.items() if k < lv} | {lv: p}


def test_code_matching_of_arbitrary_codes(spark):
    known = spark.createDataFrame([(c,) for c in ("98X01", "98X02", "14F01", "14F02", "55K03")], "code string")
    readings = spark.createDataFrame([(1, "98X01"), (2, "98X02"), (3, "98X0I"), (4, None), (5, "")], "id int, txt string")
    scores = match.code_scores(readings, known, "id", "txt")
    got = {r.id: (r.accepted, round(r.score, 4)) for r in votes.accept_by_margin(scores, "id", "code", "score", 0.92, 0.78, 0.08).collect()}
    assert got == {1: ("98X01", 1.0), 2: ("98X02", 1.0), 3: ("98X01", 0.9538)}


def test_interval_and_lane_joins(spark):
    points = spark.createDataFrame([(i, i * 7.3) for i in range(50)], "i int, x double")
    bands = spark.createDataFrame([(0, 0.0, 100.0), (1, 50.0, 220.0), (2, 300.0, 301.0)], "o int, lo double, hi double")
    got = {r.i: r.o for r in match.interval_join(points, bands, "x", "lo", "hi", "o", 64.0).collect()}
    assert got == {i: o for i in range(50) if (o := next((o for o, a, b in ((0, 0, 100), (1, 50, 220), (2, 300, 301)) if a <= i * 7.3 < b), None)) is not None}
    lanes = match.nearest(spark.createDataFrame([(5.0,), (6.0,), (None,)], "x double"), "x", [4, 6, 8]).collect()
    assert [r.lane_index for r in lanes][:2] == [0, 1]


def test_reconcile_and_fallbacks(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, l int"), spark.createDataFrame([("a", 1), ("c", 2), ("", 3), (None, 4)], "k string, r int")
    got = {(r.k, r.l, r.r): r.status for r in match.reconcile(left, right, "k").collect()}
    assert got == {("a", 1, 1): "MATCHED", ("b", 2, None): "LEFT_ONLY", ("c", None, 2): "RIGHT_ONLY", ("", None, 3): "RIGHT_NO_KEY", (None, None, 4): "RIGHT_NO_KEY"}
    assert match.union_if_empty(left.limit(0), left).count() == 2
    with pytest.raises(ValueError, match="more than"):
        match.small(spark.range(20), 10)


def test_text_functions(spark):
    r = one(
        spark, X.fold_key(F.lit("Tolérance  Géométrique.2")).alias("a"), X.fold_key_exact(F.lit("Ǆ Éa")).alias("b"), X.codes(F.lit("GE 05A01 (05A0), 99A01x")).alias("c"),
        X.unconfused_code(F.lit("O5A0I")).alias("d"), X.multiplicity(F.lit("pos 5 x")).alias("e"), X.tolerance(F.lit("5X 05A01 A 1,4"), F.lit("05A01")).alias("f"),
        X.clean_label(F.lit(")cPC Découpe|")).alias("g"), X.short_identifier(F.lit("K2")).alias("h"), X.similarity(F.lit("abcd"), F.lit("bcde")).alias("i"),
        X.plain_number(F.lit("1.G")).alias("j"), X.number(F.lit("x")).alias("k"), X.keyword(F.lit("HE1GHT < 3")).alias("l"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("tolerancegeometrique2", "dzea", ["05A01"], "05A01", 5, 1.4)
    assert (r.g, r.h, r.i, r.j, r.k) == ("CPC Découpe", "X2", 0.75, "1.6", None)
    assert r.l == "HEIGHT"


def test_text_rules_one_by_one(spark):
    """Each case follows from its rule, not from the code."""
    f = lambda fn, *cases: [getattr(one(spark, fn(F.lit(c)).alias("v")), "v") for c in cases]
    assert f(X.unconfused_code, "05815", "05415", "O5A0I", "05A1", "05a15") == [None, "05A15", "05A01", None, "05A15"]
    assert f(X.short_identifier, "X1", "K12", "X123", "XI", "A1") == ["X1", "X12", None, "X1", None]
    assert f(X.plain_number, "L5", "L.5", "1 . 6", "0.G", "3,B", "5 . S") == ["L5", "1.5", "1.6", "0.6", "3.8", "5.6"]
    assert f(X.clean_label, "a\tb", "a\nb c", "x\x0cy", "  cPC  é ", "l’axe", "straße Öß", None) == ["ab", "ab c", "x y", "CPC é", "l'axe", "straße ÖSS", ""]
    assert f(X.keyword, "WALL THICKNESS > 5", "GAP<2", "HE1GHT", "WIDHT", "D E P T H", "RADIUS", "") == ["THICKNESS", "GAP", "HEIGHT", "WIDTH", "", "", ""]
    assert f(lambda c: X.condition(c, F.lit("GAP")), "a < b > 12,345 mm", "< 5", "<", "> 1234") == ["GAP > 12.34 mm", "GAP < 5 mm", None, "GAP > 123 mm"]
    assert f(X.fold_key, "Straße Nº", "Ça-va") == ["strassen", "cava"] and f(X.fold_key_exact, "straße", "Ő1") == ["strasse", "o1"]


def test_numeric_vote_prefers_a_decimal_to_its_truncated_reading(spark):
    rows = [(1, "1.6", 0.3), (1, "1", 0.9), (2, "1.6", 0.1), (2, "1", 2.0), (3, "1234", 1.0), (3, "12", 0.5), (4, "0.125", 0.2), (4, "7", 0.9), (5, "2 . S", 1.0), (6, "none", 1.0)]
    got = {r.k: r.value for r in votes.numeric_vote(spark.createDataFrame(rows, "k int, t string, w double"), "k", "t", "w").collect()}
    assert got == {1: 1.6, 2: 1.0, 3: 12.0, 4: 0.125, 5: 2.6}


def test_geometry(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = one(spark, N.iou(box(0, 0, 2, 2), box(1, 0, 2, 2)).alias("a"), N.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("b"), N.angle_difference(F.lit(170.0), F.lit(-5.0)).alias("c"), N.normal_angle(F.lit(135.0)).alias("d"))
    assert (round(r.a, 6), r.b, r.c, r.d) == (0.333333, 0.0, 5.0, -45.0)


def test_evidence_merge_keeps_running_medians(spark):
    rows = [(0, y, 50.0, 20.0, 28.0) for y in (100.0, 110.0, 117.0, 160.0)]
    got = [r.node for r in greedy.merge_evidence(spark.createDataFrame(rows, "k int, y double, lane double, h double, st double"), "k", "y", "lane", "h", "st").orderBy("y").collect()]
    assert got == [0, 0, 0, 1]


def test_box_suppression_and_components(spark):
    rows = [(0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 2, 1.0, 0.0, 10.0, 10.0, 0.8), (0, 3, 20.0, 0.0, 10.0, 10.0, 0.7), (1, 4, 0.0, 0.0, 5.0, 5.0, 0.1)]
    df = spark.createDataFrame(rows, "k int, id long, x double, y double, w double, h double, s double")
    assert sorted(r.id for r in greedy.suppress_boxes(df, "k", ("x", "y", "w", "h"), [F.col("s").desc(), F.col("id")], 0.55).collect()) == [1, 3, 4]
    assert {r.id: r.component for r in greedy.touching_components(df, "k", "id", ("x", "y", "w", "h"), 9.5).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_sequences(spark):
    df = spark.createDataFrame([(0, 1, "Y3"), (0, 2, "Y4"), (0, 3, "YS"), (0, 4, "YO"), (1, 1, "YS")], "g int, p int, t string")
    assert [r.inferred_text for r in greedy.infer_sequence(df, ["g"], "p", "t").orderBy("g", "p").collect()] == ["Y3", "Y4", "Y5", "YO", "YS"]
    df = spark.createDataFrame([(0, 1, "a", []), (0, 2, "a", [(1.0, "b")]), (0, 3, "a", []), (0, 4, None, [(2.0, "c"), (3.0, "a")])], "g int, p int, t string, o array<struct<score: double, code: string>>")
    assert [(r.p, r.chosen) for r in greedy.recover_sequence(df, ["g"], "p", "t", "o").orderBy("p").collect()] == [(1, "a"), (2, "b"), (4, "c")]


def test_groups_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).selectExpr("cast(id % 3 as int) k", "cast(id as double) y", "0.0 x")
        got = greedy.group_rows(df, "k", "y", "x", 0.5).groupBy("k").agg(F.countDistinct("row").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.k: r.n for r in got} == {0: 67, 1: 67, 2: 66}


def test_windows_equal_their_recurrences(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(6)) for k in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "seg int, pos int, lev int")
    got = {(r.seg, r.pos): r.clamped for r in tree.clamp_levels(df, "seg", "pos", "lev").collect()}
    for k in range(4):
        x = 0
        for _, i, a in (r for r in rows if r[0] == k):
            x = 0 if i == 0 else min(max(1, a), x + 1)
            assert got[k, i] == x


def test_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], "k string, v double, c double, p int")
    assert votes.consensus(empty, "k", "v", "c", "p", conflicts=True).count() == 0
    assert greedy.group_rows(spark.createDataFrame([], "k int, y double, x double"), "k", "y", "x").count() == 0
    words = spark.createDataFrame([("a", None, 1, 20), ("", "50", 1, 20), ("b", "50", 1, 20)], "text string, conf string, top int, height int")
    assert [r.text for r in lines.usable_words(words).collect()] == ["b"]
    rows = review.with_status(spark.createDataFrame([(None, "x"), (" ", "y")], "a string, b string"), {"a": F.col("a")})
    assert {r.status for r in rows.collect()} == {"TO_REVIEW"}
