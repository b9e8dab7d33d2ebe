"""Sources, sinks, the cache and the streaming counterpart."""

import json
import random
import time

from pyspark.sql import functions as F

from evidentia.sources import readers, writers
from evidentia.streaming.capture import Control, captured, capturing
from evidentia.streaming.stability import stable_stops


def test_reports_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "é"), (2, None, None)], "i int, b boolean, s string")
    writers.csv_report(writers.sheet(df), str(tmp_path / "a.csv"))
    assert (tmp_path / "a.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    writers.json_report(df, str(tmp_path / "a.json"))
    assert [x["i"] for x in json.loads((tmp_path / "a.json").read_text())] == [1, 2]
    first, second = (writers.tables({"t": df}, str(tmp_path))["t"] for _ in range(2))
    assert first != second and spark.read.parquet(second).count() == 2
    assert json.loads(writers.diagnostics({"x": df, "y": df.limit(0)}).first().document)["y"] == []


def test_cache_and_signature(spark, tmp_path):
    a, b = spark.range(10), spark.range(9, -1, -1)
    assert readers.signature(a, ["id"]) == readers.signature(b, ["id"]) != readers.signature(a, ["id"], "2")
    made = []

    def make():
        made.append(1)
        return a

    for _ in range(2):
        assert readers.cached(spark, str(tmp_path), "k", make).count() == 10
    assert len(made) == 1


def test_manifest_images_words_and_tree(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"series": [{"order": 2, "code": "a"}, {"order": 1, "code": "A"}, {"order": 3, "code": ""}]}))
    assert [r.order for r in readers.manifest_items(spark, str(tmp_path / "m.json"), "series", "code", "order").collect()] == [1]
    for n in ("img10.png", "img9.png", "x.txt"):
        (tmp_path / n).write_bytes(b"0")
    assert [r.name for r in readers.images(spark, str(tmp_path)).collect()] == ["img9.png", "img10.png"]
    spark.createDataFrame([("i", "w", "10")], "image string, text string, left string").write.parquet(str(tmp_path / "w"))
    row = readers.words(spark, str(tmp_path / "w"), scale=4.0).first()
    assert row.left == 2 and row.conf is None
    (tmp_path / "t.csv").write_text("line,text,level\n1,a,0\n2,b,1\n")
    assert [r.parent_id for r in readers.ordered_tree(spark, str(tmp_path / "t.csv")).orderBy("line").collect()] == ["", "X00001"]
    assert [r.v for r in spark.createDataFrame([("raw",), ("binary",), ("code_7",)], "x string").select(readers.variant(F.col("x")).alias("v")).collect()] == [None, 128, 7]


def test_stream_stops_like_the_batch(spark, tmp_path):
    rows = [("a", i, v) for i, v in enumerate([0.0, 9.0, 9.1, 9.2, 20.0, 20.0, 20.0])] + [("b", i, float(i * 5)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, p long, v double")
    for part in (df.where("p < 3"), df.where("p >= 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stable_stops(stream, "k", "p", "v", 0.5).writeStream.format("memory").queryName("stops").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.k, r.stop_pos) for r in spark.table("stops").collect()] == [("a", 3)]


def test_capture_restarts_where_it_stopped(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, p, rng.choice([0.0, 0.0001, 0.01, 0.1, 0.5, None])) for k in ("a", "b", "c", "d") for p in range(24)]
    df = spark.createDataFrame(rows, "k string, p long, r double")
    control = Control(limit=9)
    want = {tuple(r) for r in captured(df, "k", "p", "r", control).collect()}
    assert {a for _, _, a, _ in want} == {"save", "wait", "end", "limit", "closed"}
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(3):
            df.where(f"p >= {8 * part} AND p < {8 * part + 8}").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
            query = capturing(stream, "k", "p", "r", control).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
            # Timers keep a stream alive, so it is watched and not awaited.
            until = time.monotonic() + 60
            while time.monotonic() < until and sum(p["numInputRows"] for p in query.recentProgress) < 32:
                time.sleep(0.5)
            query.stop()
    finally:
        spark.conf.unset(provider)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_control_of_steps():
    control = Control(start=100)
    state, done = control.begin(), []
    for r in (0.5, 0.01, 0.05, 0.0, 0.05, 0.0, 0.0, 0.3):
        state, action = control.advance(state, r)
        done.append((action, state[0]))
    assert done == [("save", 75), ("save", 94), ("save", 94), ("wait", 113), ("save", 113), ("wait", 136), ("end", 136), ("closed", 136)]


def test_documents(spark, tmp_path):
    nodes = spark.createDataFrame([(2, "03A01", "p"), (1, "", "q"), (3, "03A01", None)], "n int, code string, ref string")
    doc = writers.code_manifest(nodes, "part", "n", "code", ["ref"])
    assert json.loads(doc.first().document) == {"document": "part", "method": "direct_tree", "series_count": 2, "series": [{"order": 2, "series_code": "03A01", "ref": "p"}, {"order": 3, "series_code": "03A01"}]}
    writers.document_file(doc, str(tmp_path / "m"))
    assert [r.order for r in readers.manifest_items(spark, str(tmp_path / "m"), "series", "series_code", "order").collect()] == [2]
    assert json.loads(writers.document(nodes.limit(0), "n", "captures", "capture_count").first().document) == {"capture_count": 0, "captures": []}
