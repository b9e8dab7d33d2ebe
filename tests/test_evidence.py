"""Evidence operators: the cases that their rules are made for, and odd input."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import codes as C
from evidentia.functions import text as X
from evidentia.operators import evidence, match, tree


@pytest.mark.parametrize(
    ("text", "others", "parent", "want", "marker"),
    [
        ("92401 (02A01...)", "", "Notes", "02A01 (02A01...)", "identifier_from_repeated_display"),
        ("OGA02 (06A02...)", "", "Notes", "06A02 (06A02...)", "identifier_normalised"),
        ("GE93403", "03A03 | 93403", "notes", "03A03", ""),
        ("05B01", "05A01 | 05A01 (05A01)", "notes", "05B01", ""),
        ("GE 05B01", "", "Notes", "05B01", "identifier_normalised"),
        ("Designations (TOL3D...)", "", "notes", "Designations (TOL3D...)", ""),
        ("92401 (02A01...)", "", "views", "92401 (02A01...)", ""),
        (None, None, None, "", ""),
    ],
)
def test_code_recovery(spark, text, others, parent, want, marker):
    df = spark.createDataFrame([(text, others, parent)], "t string, o string, p string")
    (row,) = evidence.recover_codes(df, "t", "o", "p").collect()
    assert row.recovered == want
    assert row.marker == marker or want == "03A03" and row.marker.startswith("identifier_")


def test_readings_keep_their_digits(spark):
    row = spark.range(1).select(X.alternatives(F.lit("a"), F.lit("05A01| 1b")).alias("a"), C.readings(F.lit("a"), F.lit("05A01 | 1b")).alias("b")).first()
    assert row.a == row.b == ["a", "05A01", "1b"]


def test_suffix_and_texts(spark):
    row = spark.range(1).select(
        C.conditional_suffix(F.array(F.lit("03A01 | 2"), F.lit("3 AOI HEIGHT < 2"))).alias("s"), C.conditional_suffix(F.array(F.lit(None).cast("string"))).alias("none"),
        C.unique_texts(F.array(F.lit(" B"), F.lit("a"), F.lit("b"), F.lit(""), F.lit("A"))).alias("u"), C.first_filled(F.lit(None), F.lit(""), F.lit("x")).alias("f"),
    ).first()
    assert (row.s, row.none, row.u, row.f) == ("A01", "", ["B", "a"], "x")


def test_tolerance_votes(spark):
    rows = [(1, 1, "03A01 | 1.4 | A"), (1, 2, "03A01 |1 | A"), (2, 1, "2X 03A01"), (3, 1, None)]
    df = spark.createDataFrame(rows, "k int, p int, t string").withColumn("c", F.lit("03A01"))
    assert {r.k: r.value for r in evidence.standard_tolerance(df, "k", "p", "t", "c").collect()} == {1: 1.4}
    rows = [(1, 1, "03A01 2 HEIGHT < 7.25"), (1, 2, "2 < 7.25"), (1, 3, "1.5 > 3"), (2, 1, "4 < 1.5"), (3, 1, "< 2.5"), (4, 1, None)]
    got = evidence.conditional_tolerance(spark.createDataFrame(rows, "k int, p int, t string"), "k", "p", "t").collect()
    assert {r.k: (r.value, r.confidence) for r in got} == {1: (1.5, 0.96), 2: (4.0, 0.90)}


def test_lane_conflict(spark):
    rows = [(1, 1, 0, "Notes", 90.0, False), (1, 2, 1, "LA Notes", 90.0, False), (2, 1, 0, "Notes", 90.0, False), (2, 2, 1, "Frames", 88.0, False), (3, 1, 0, "x", 90.0, True)]
    df = spark.createDataFrame(rows, "k int, p int, lane int, t string, c double, part boolean").withColumn("m", F.lit("full"))
    assert {r.k: r.conflict for r in evidence.lane_conflicts(df, "k", "p", "lane", "t", "c", "m", "part").collect()} == {1: False, 2: True}


def test_completion_needs_one_clear_code(spark):
    known = spark.createDataFrame([("08B01",), ("03A01",), ("03A02",)], "code string")
    df = spark.createDataFrame([(1, "08B0"), (2, "3A01"), (3, "03A0"), (4, "ab"), (5, None)], "k int, t string")
    assert {r.k: r.code for r in evidence.complete_fragments(df, known, "k", "t").collect()} == {1: "08B01", 2: "03A01"}


def test_registration_finds_the_shift_or_nothing(spark):
    wave = [float((i * i * 7) % 59) for i in range(60)]
    rows = [(1, wave, wave[5:] + wave[:5]), (2, [1.0] * 60, [1.0] * 60), (3, [], [])]
    got = {r.k: r.shift for r in evidence.register(spark.createDataFrame(rows, "k int, a array<double>, b array<double>"), "a", "b", 1, 20, apart=2).collect()}
    assert got == {1: 5, 2: None, 3: None}


def test_matching_of_repeated_rows(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 50.0)], "k int, x double")
    bands = spark.createDataFrame([(0, 0.0, 10.0, "a"), (1, 4.0, 6.0, "b")], "o int, low double, high double, n string")
    assert [r.n for r in match.interval_join(points, bands, "x", "low", "high", "o", 4.0, ["n"]).collect()] == ["a", "a"]
    rows = spark.createDataFrame([("A01", "03"), ("A01", "03"), ("1", "03")], "s string, p string")
    known = spark.createDataFrame([("03A01",), ("03A01",), ("03B01",)], "code string")
    assert [r.resolved for r in match.sibling_by_suffix(rows, known, "s", "p").collect()] == ["03A01", "03A01"]


def test_limits_of_trees_are_errors(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(4)], "c int, p int")
    root = spark.createDataFrame([(0,)], "node int")
    assert tree.descendants(chain, "c", "p", root, 4).count() == 5
    with pytest.raises(ValueError):
        tree.descendants(chain, "c", "p", root, 3)
    with pytest.raises(Exception, match="a level is 2 or more"):
        tree.parents(spark.createDataFrame([(0, 1, 2)], "s int, p int, l int"), "s", "p", "l", 2).collect()
