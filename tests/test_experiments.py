"""Experiment tables: CSV round trip, matrix, labels; and streams of edges."""

import pytest
from pyspark.sql import functions as F

from cutweave.operators import experiments as ex
from cutweave.sources import edge_lists
from cutweave.streaming import edges


def test_results_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("g", 1.5)], "graph string, time double")
    b = spark.createDataFrame([("h", 3)], "graph string, cut int")
    edge_lists.write_results([a, b], str(tmp_path / "r"), missing=-1)
    got = {r["graph"]: (r["time"], r["cut"]) for r in edge_lists.read_results(spark, [str(tmp_path / "r")]).collect()}
    assert got == {"g": (1.5, -1), "h": (-1.0, 3)}


def test_matrix_and_equation(spark):
    assert ex.configurations(spark, ["a", "b"], [0.1], seeds=3).count() == 2 * 9 * 3
    p = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    r = ex.regression(p, F.col("x"), F.col("y"), []).first()
    assert r["slope"] == pytest.approx(2) and r["equation"] == "y = 1.000 + 2.000 x"


def test_traces(spark):
    t = ex.traces(spark.createDataFrame([(1, [5.0, 2.0]), (2, [3.0])], "run int, potentials array<double>"))
    assert {(r["iteration"], r["potential"]) for r in ex.trace_medians(t, []).collect()} == {(0, 4.0), (1, 2.0)}


def test_streamed_degrees(spark, tmp_path):
    rows = [(1, 2, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:01:00"), (2, 3, "2024-01-01 00:02:00"), (4, 4, "2024-01-01 00:03:00")]
    df = spark.createDataFrame(rows, "u long, v long, t string").select("u", "v", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = edges.stream_degrees(stream).writeStream.format("memory").queryName("degs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["id"], r["deg"]) for r in spark.table("degs").collect()} == {(1, 1), (2, 2), (3, 1)}


def test_streamed_windows_count_edges_exactly(spark, tmp_path):
    rows = [(k % 40, 100 + k % 23, f"2024-01-01 00:{k % 30:02d}:00") for k in range(3_000)] + [(100, 0, "2024-01-01 00:00:30"), (1, 1, "2024-01-01 00:00:00"), (5, 6, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "u long, v long, at string").selectExpr("u", "v", "cast(at as timestamp) as ts")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = edges.stream_edge_windows(stream, exact=True).writeStream.format("memory").queryName("exact_windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["window"]["start"].minute, r["n_pairs"], r["n_edges"]) for r in spark.table("exact_windows").collect())
    want: dict = {}
    for u, v, at in rows[:-2]:
        want.setdefault(int(at[14:16]) // 10 * 10, []).append((min(u, v), max(u, v)))
    assert got == sorted((m, len(x), len(set(x))) for m, x in want.items())
