import logging

import numpy as np
import pandas as pd
import pytest

from tidemark import metrics
from tidemark.api import FeatureCollection, FeatureDescriptor, SeriesPipeline, SeriesProcessor, chunk_data
from tidemark.functions.adapters import catch22_wrapper, seglearn_wrapper, tsfresh_settings_wrapper
from tidemark.operators import processing as P
from tidemark.streaming import windows


def seconds(spark, n, start=0, step="1s", name="v"):
    return spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq=step)[start:], name: np.arange(start, n, dtype=float)}))


def test_one_chunk_without_gaps(spark):
    got = chunk_data(seconds(spark, 1000), {"v": 1}).groupBy("chunk_id").count().collect()
    assert [(r[0], r[1]) for r in got] == [(0, 1000)]


def test_gaps_margins_and_lengths(spark):
    whole = seconds(spark, 200)
    cut = whole.where("not (v between 10 and 19) and not (v between 100 and 102)")
    assert sorted(r[1] for r in chunk_data(cut, {"v": 1}).groupBy("chunk_id").count().collect()) == [10, 80, 97]
    assert chunk_data(cut, {"v": 1}, min_chunk_dur="30s").select("chunk_id").distinct().count() == 2
    parts = chunk_data(whole, {"v": 1}, max_chunk_dur="50s").groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert len(parts) == 4 and parts[0][1] == 51
    assert chunk_data(whole.limit(1), {"v": 1}).count() == 0
    with pytest.raises(ValueError):
        chunk_data(whole)


def test_chunks_of_two_rates_match(spark):
    both = [seconds(spark, 100), seconds(spark, 200, step="500ms", name="w")]
    got = chunk_data(both, {"v": 1, "w": 2}).groupBy("chunk_id", "series").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(0, "v", 100), (0, "w", 200)}


def test_pipeline_contract(spark):
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=6, freq="s"), "a": [1.0, -2, 3, -4, 5, -6], "b": [1.0] * 6}))
    pipe = SeriesPipeline([SeriesProcessor(P.absolute, "a"), SeriesProcessor(P.combine, ("a", "b"), name="c", signs=[1, -1])])
    got = pipe.process(df, return_df=True, drop_keys=["b"]).toPandas().sort_values("ts")
    assert got.a.tolist() == [1, 2, 3, 4, 5, 6] and got.c.tolist() == [0, 1, 2, 3, 4, 5] and "b" not in got
    doubled = SeriesPipeline([SeriesProcessor(lambda s: s * 2, "a")]).process(df, return_df=True).toPandas().sort_values("ts")
    assert doubled.a.tolist() == [2, -4, 6, -8, 10, -12]
    with pytest.raises(P.ProcessingError):
        SeriesPipeline([SeriesProcessor(P.absolute, "missing")]).process(df)
    with pytest.raises(TypeError):
        pipe.append("x")


def test_fir_matches_numpy(spark):
    rng = np.random.default_rng(0)
    v, taps = rng.random(50), P.savgol_taps(5, 2)
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=50, freq="s"), "v": v}))
    got = SeriesPipeline([SeriesProcessor(P.fir, "v", taps=taps)]).process(df, return_df=True).toPandas().sort_values("ts").v.to_numpy()
    assert np.allclose(got[2:-2], np.convolve(v, taps[::-1], "valid"))


def test_logs(spark, tmp_path):
    fc = FeatureCollection(FeatureDescriptor("sum", "v", "10s", "5s"))
    fc.calculate(seconds(spark, 60), return_df=True, logging_file_path=str(tmp_path / "f.log"))
    assert metrics.get_feature_logs(spark, tmp_path / "f.log").first()["window"] == "10s"
    assert metrics.get_function_stats(spark, tmp_path / "f.log").count() == 1
    assert len(metrics.logging_file_to_df(tmp_path / "f.log")) == 1
    with pytest.warns(RuntimeWarning):
        metrics.add_logging_handler(logging.getLogger("x"), tmp_path / "f.log")
    SeriesPipeline([SeriesProcessor(P.absolute, "v")]).process(seconds(spark, 5), logging_file_path=str(tmp_path / "p.log"))
    assert metrics.get_processor_logs(spark, tmp_path / "p.log").first()["function"] == "absolute"


def test_adapters():
    def bins(x):
        return np.array([[1.0, 2.0]])

    bins.bins = 2
    assert seglearn_wrapper(bins).output_names == ("bins_bin1", "bins_bin2")

    class Module:
        @staticmethod
        def energy(x):
            return float((x * x).sum())

    assert tsfresh_settings_wrapper({"energy": None}, Module)[0](np.array([1.0, 2.0])) == 5
    assert catch22_wrapper(lambda x: {"names": ["n"], "values": [len(x)]}).output_names == ("n",)


def test_streaming_windows(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=100, freq="min"), "k": ["a"] * 100, "v": np.arange(100.0)})).selectExpr("cast(ts as timestamp) ts", "k", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    out = windows.hopping(stream, "ts", "10 minutes", "5 minutes", [F.sum("v").alias("s")], ["k"])
    q = out.writeStream.format("memory").queryName("hops").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select s from hops where start = timestamp'2024-01-01 00:10:00'").first()[0] == sum(range(10, 20))


def test_streaming_sessions_and_runs(spark, tmp_path):
    from pyspark.sql import functions as F

    t = pd.date_range("2024-01-01", periods=30, freq="min")
    kinds = ["x"] * 10 + ["y"] * 5 + ["x"] * 15
    rows = pd.DataFrame({"ts": t, "k": ["a"] * 30, "v": kinds}).drop(index=[20, 21, 22, 23])
    df = spark.createDataFrame(rows).selectExpr("cast(ts as timestamp) ts", "k", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def collected(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).toPandas()

    sessions = collected(windows.gap_sessions(stream, "ts", "2 minutes", ["k"], [F.count(F.lit(1)).alias("n")], late="0 seconds"), "sessions", "append")
    assert sessions.n.tolist() == [20]  # the last session is still open
    runs = collected(windows.consecutive_runs(stream, "ts", "v", ["k"]), "runs", "append").sort_values("start")
    assert list(zip(runs.v, runs.n, strict=True)) == [("x", 10), ("y", 5)] and (runs.end - runs.start).tolist() == [pd.Timedelta("9min"), pd.Timedelta("4min")]


def test_neighbourhoods_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 4)
    df = seconds(spark, 60)
    got = SeriesPipeline([SeriesProcessor(P.median_filter, "v", size=25)]).process(df, return_df=True).toPandas().sort_values("ts")
    v = np.arange(60.0)
    assert got.v.tolist() == [np.median(v[max(0, k - 12) : k + 13]) for k in range(60)]
