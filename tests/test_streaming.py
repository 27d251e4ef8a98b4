"""Streams run to their end over small folders."""

from datetime import datetime, timedelta

from idforge.operators.lineage import cut, release, spread
from idforge.operators.nearest import nearest
from idforge.streaming import runs

START = datetime(2024, 1, 1)


def folder(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return path


def test_windows_close_with_the_watermark(spark, tmp_path):
    rows = [(START + timedelta(minutes=m), "a" if m % 2 else "b", 1.0) for m in range(0, 600, 10)]
    schema = "ts timestamp, kind string, value double"
    stream = runs.read_stream(spark, folder(spark, tmp_path, rows, schema), schema)
    out = runs.drained(runs.windowed_counts(stream, "ts", "kind", "value"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.start.hour, r.kind): (r.n, r.total) for r in out.collect()}
    assert all(v == (6, 6.0) for v in got.values())
    assert (0, "b") in got and (9, "b") not in got  # the last window is still open


def test_repeated_judgements_come_once(spark, tmp_path):
    rows = [("q", "d", START), ("q", "d", START + timedelta(hours=1)), ("q", "e", START)]
    schema = "qid string, docid string, judged_at timestamp"
    stream = runs.read_stream(spark, folder(spark, tmp_path, rows, schema), schema)
    out = runs.drained(runs.first_judgements(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r.qid, r.docid) for r in out.collect()) == [("q", "d"), ("q", "e")]


def test_nearest_with_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.nearest, r.cosine, r.near) for r in nearest(v, v, 0.9).collect()}
    assert got[1] == (2, 1.0, 1) and got[2] == (1, 1.0, 1) and 4 not in got and got[3][2] == 0
    assert nearest(v, v.limit(0), 0.9).count() == 0


def test_cut_and_spread(spark):
    df = cut(spark.range(10).toDF("id"), "t")
    assert df.count() == 10
    release(df)
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 64)).rdd.getNumPartitions() == 64
