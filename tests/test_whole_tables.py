"""Registered queries work on every row of their tables."""

import pytest

from evidentia.plans.queries import REGISTERED, _boxes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("whole")
    lines = [(k, k * 7 + n, n + 1, n + 1, 1.0 + n, 0.05, "N") for k in range(1, 12) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{base}/lineitem.parquet")
    return str(base)


def test_boxes_are_of_all_orders(spark, folder):
    assert {r.l_orderkey for r in _boxes(lambda name: spark.read.parquet(f"{folder}/{name}.parquet")).collect()} == set(range(1, 12))


@pytest.mark.parametrize("name", ["merge_evidence", "row_grouping", "iou_nms", "box_components"])
def test_all_orders_have_rows(spark, folder, name):
    assert {r.l_orderkey for r in REGISTERED[name](spark, folder).collect()} == set(range(1, 12))


def test_code_scores_are_of_all_parts(spark, tmp_path):
    """Parts 118 and 201 have the codes of nations 3 and 1, and part 485 + k that of part k."""
    parts = [(k + more, size) for k, size in ((118, 7), (201, 3)) for more in (0, 485)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,), (3,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    best = {}
    for r in REGISTERED["code_score_match"](spark, str(tmp_path)).collect():
        best[r.p_partkey] = max(best.get(r.p_partkey, (0.0, "")), (r.score, r.code))
    assert {k: c for k, (_, c) in best.items()} == {118: "21O07", 603: "21O07", 201: "07B03", 686: "07B03"}
