"""Work that does not grow faster than the tables, and nothing left out."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.operators import evidence, greedy, match, pictures
from evidentia.plans.queries import REGISTERED
from evidentia.sources.folders import written


def test_code_scores_are_against_the_codes_of_all_parts(spark, tmp_path):
    """Parts 300 and 785 have a code that no nation has."""
    spark.createDataFrame([(k, 9) for k in (7, 300, 785)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    own = {r.p_partkey: r.code for r in REGISTERED["code_score_match"](spark, str(tmp_path)).where("score = 1").collect()}
    assert own[785] == "09A09" and own[7] == "07G09"


def test_code_scores_take_a_dictionary_of_any_size(spark):
    known = spark.range(25_000).select(F.concat(F.lpad(F.floor(F.col("id") / 250).cast("string"), 2, "0"), F.lit("A"), F.lpad((F.col("id") % 250).cast("string"), 3, "0")).alias("code"))
    known = known.union(spark.createDataFrame([("12A07",)], "code string"))
    got = match.code_scores(spark.createDataFrame([(1, "12A07")], "k int, t string"), known, "k", "t").where("code = '12A07'").collect()
    assert [r.score for r in got] == [1.0]


def test_codes_that_meet_are_all_that_score(spark):
    """Against every window and code compared with each other."""
    windows = ["12A34", "I2A34", "OIAO1", "88888", "ABCDE", "2A34", "A4O1", "GG6|L", "00000"]
    codes = ["12A34", "01A01", "02A34", "08B88", "00O00", "9AG61", "0A40", "12B34"]
    w, c = spark.createDataFrame([(x,) for x in windows], "w string"), spark.createDataFrame([(x,) for x in codes], "code string")
    short = F.length("w") == 4
    cost = match.window_cost(F.col("w"), F.col("code"), F.when(short, 2).otherwise(1), F.when(short, match.LOST_ZERO).otherwise(0.0))
    every = w.join(c, ~short | F.startswith("code", F.lit("0"))).where(cost < match.WORST)
    met = match._close_codes(w, c, "w", "code").distinct().where(cost < match.WORST)
    pairs = lambda df: {(r.w, r.code) for r in df.select("w", "code").collect()}
    assert pairs(met) == pairs(every) and len(pairs(every)) > 10


def test_votes_are_numbers_only(spark):
    """texts are sorted once, for the readings' order; no sum, window or choice after it holds them."""
    rows = [(1, 2, "03A01 | 5 | A", "03A01"), (1, 1, "03A01 | 7 | A", "03A01"), (1, 1, "03A01 7.5", "03A01"), (2, 1, None, "x")]
    got = evidence.standard_tolerance(spark.createDataFrame(rows, "k int, pos int, t string, c string"), "k", "pos", "t", "c")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") <= 2 and "min(_o" not in plan
    assert [(r.k, r.value) for r in got.collect()] == [(1, 7.5)]


def test_runs_are_scored_once_a_reading(spark, monkeypatch):
    """a thousand lines read alike, and the score is asked of what they read."""
    asked = []
    monkeypatch.setattr(evidence, "written", lambda df: asked.append(df.count()) or df)
    words = spark.range(1000).select("id", F.lit(0).alias("line"), F.lit("03A01").alias("code"), F.explode(F.array(F.struct(F.lit("03").alias("t"), F.lit(0).alias("x")), F.struct(F.lit("A01").alias("t"), F.lit(50).alias("x")))).alias("w"))
    words = words.select("id", "line", "code", F.col("w.t").alias("text"), F.col("w.x").alias("left"), F.lit(5).alias("top"), F.lit(40).alias("width"), F.lit(10).alias("height"))
    got = evidence.locate_code(words, "id", "line", "code", "text", ("left", "top", "width", "height"))
    assert {tuple(r)[1:] for r in got.collect()} == {(1.0, 0, 5, 90, 15)} and got.count() == 1000
    assert asked == [3]


def test_fragments_are_compared_once(spark):
    """the codes meet the distinct fragments; keys that repeat still decide together."""
    rows = [(k, "3A01") for k in range(500)] + [(999, "3A01"), (999, "7B02")]
    known = spark.createDataFrame([("03A01",), ("07B02",)], "code string")
    got = evidence.complete_fragments(spark.createDataFrame(rows, "k int, t string"), known, "k", "t")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_fs" in plan[plan.rindex("Join ") :]
    assert {r.code for r in got.where("k < 500").collect()} == {"03A01"} and got.where("k < 500").count() == 500


def _sent_whole(df) -> bool:
    return "Broadcast" in df._jdf.queryExecution().sparkPlan().toString()


def test_rows_of_alike_labels_are_not_sent_to_the_driver(spark, tmp_path):
    """a small file of long texts is taken for a small table, and its words are many."""
    spark.createDataFrame([(1, "abcdef ghijkl " * 50), (1, "abcdeg ghijkl " * 50)], "p int, t string").write.parquet(f"{tmp_path}/t")
    words = spark.read.parquet(f"{tmp_path}/t").select("p", F.explode(F.split("t", " ")).alias("w")).where("w != ''")
    got = match.similar_pairs(words, words, "p", "w", 0.8)
    assert not _sent_whole(got) and got.count() == 4 * 50 * 50 + 100 * 100


def test_ratios_are_worked_out_once_a_pair_and_for_near_ones(spark, monkeypatch):
    """in each of 20 places the same labels; most differ in more characters than alike ones can."""
    tables = []
    monkeypatch.setattr(match, "written", lambda df: tables.append(df.localCheckpoint()) or tables[-1])
    labels = spark.range(20).select(F.col("id").alias("p"), F.explode(F.array(*[F.lit(f"label {w} 1") for w in ("abcdefgh", "abcdefgi", "zyxwvuts", "lmnopqrk")])).alias("w"))
    got = {(r.p, r.w, r.w_b) for r in match.similar_keys(labels, labels, "p", "w").collect()}
    assert len(got) == 20 * 6 and tables[1].count() == 20 * 6


def test_levenshtein_loses_no_alike_pair(spark):
    from difflib import SequenceMatcher
    from random import Random

    rng = Random(5)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(4, 15))) for _ in range(25)]
    words = sorted({*base, *[b[:i] + rng.choice("abcdex") + b[i + rng.randrange(2) :] for b in base for i in (1, 3)], *[b[2:] + b[:2] for b in base]})
    df = spark.createDataFrame([(1, w) for w in words], "p int, w string")
    want = {(a, b) for a in words for b in words if SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert {(r.w, r.w_b) for r in match.similar_keys(df, df, "p", "w", 0.8).collect()} == want


def test_suppression_sends_nothing_whole_to_the_driver(spark, monkeypatch):
    """the tables of a round are small files, their probes are not."""
    plans = []

    def seen(df):
        plans.append(df)
        return written(df)

    monkeypatch.setattr(greedy, "written", seen)
    boxes = spark.range(400).select((F.col("id") % 2).alias("p"), F.col("id").alias("b"), *[(F.col("id") * k % m).cast("double").alias(n) for n, k, m in (("x", 7, 40), ("y", 3, 30), ("w", 1, 9), ("h", 2, 9))])
    greedy.suppressed(boxes, "p", [F.col("b")], greedy.near_equal(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).collect()
    assert len(plans) > 2 and not any(_sent_whole(p) for p in plans)


def test_walls_of_a_crowded_picture(spark):
    """equal walls reach Python once, and many thousands of a picture end."""
    w = spark.range(60_000).select(F.lit(1).alias("p"), (F.col("id") % 50 * 6.0).alias("x"), (F.col("id") % 10 * 9.0).alias("y"), F.lit(20.0).alias("l"))
    w = w.select("p", "x", "y", "l", (F.col("y") - 10).alias("low"), (F.col("y") + 10).alias("high"))
    got = pictures.wall_sets(w, "p", ("x", "y", "l", "low", "high"))
    once = pictures.wall_sets(w.distinct(), "p", ("x", "y", "l", "low", "high"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, once.collect())) and got.count() > 0


def test_cells_of_a_large_picture_stay_in_columns(monkeypatch):
    """F8: a group is walked as Arrow columns, with less than its rows as Python objects would take."""
    import tracemalloc

    n = 200_000
    table = pa.table({"p": np.zeros(n, np.int64), **{c: np.arange(n) % m * 1.0 for c, m in (("x", 200), ("y", 90), ("w", 7), ("h", 50), ("t", 4))}, "a": np.arange(n)[::-1] * 1.0})
    taken = {}
    monkeypatch.setattr(pictures, "whole_groups", lambda df, key, order, fn, ddl: taken.update(fn=fn))
    monkeypatch.setattr(pictures, "all_columns", lambda df: [])
    monkeypatch.setattr(pictures.F, "col", lambda c: type("C", (), {"desc": lambda self: None})())
    pictures.collinear_groups(type("D", (), {"schema": type("S", (), {"fields": []})()})(), "p", ("x", "y", "w", "h", "t"), "a")
    tracemalloc.start()
    out = taken["fn"](table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows > 0 and most < 250 * n
