"""Windows of many samples, tables of several slices, and several rows of one index."""

import re
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.api import FeatureCollection, FeatureDescriptor, FuncWrapper, Series, SeriesPipeline, SeriesProcessor, chunk_data, outer_merge
from tidemark.operators import processing as P
from tidemark.plans import ordering
from tidemark.plans.catalogue import ORACLES, QUERIES


def in_one_window(spark, values, *functions, seconds=60):
    """Functions over one window that holds all values, stopped if they take longer than what grows with its size."""
    n = len(values)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n + 1), "v": [*values, 0.0]}))
    fc = FeatureCollection([FeatureDescriptor(f, "v", n, n) for f in functions])
    late = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        row = fc.calculate(df, return_df=True, index="k", approve_sparsity=True).first()
    finally:
        late.cancel()
    return {c.split("__")[1]: row[c] for c in row.asDict() if c.startswith("v__")}


VALUES = np.random.default_rng(0).normal(size=30_000)


def test_entropy_of_a_large_window(spark):
    got = in_one_window(spark, VALUES, "binned_entropy", "value_entropy")
    counts = np.histogram(VALUES, 10)[0] / len(VALUES)
    assert got["binned_entropy"] == pytest.approx(-sum(p * np.log(p) for p in counts if p))
    assert got["value_entropy"] == pytest.approx(1.0)  # all values are distinct
    assert in_one_window(spark, [1.0, 1.0, 2.0, 2.0, 2.0, 2.0], "value_entropy")["value_entropy"] == pytest.approx(-(np.log2(1 / 3) / 3 + 2 * np.log2(2 / 3) / 3))
    assert in_one_window(spark, [4.0, 4.0], "value_entropy")["value_entropy"] == 0


def test_changes_in_a_large_window(spark):
    got = in_one_window(spark, VALUES, "std_diff", "distance", "std_time_diff")
    steps = np.diff(VALUES)
    assert got == pytest.approx({"std_diff": steps.std(), "distance": np.sqrt(1 + steps**2).sum(), "std_time_diff": 0.0})


def test_order_in_a_large_window(spark):
    got = in_one_window(spark, VALUES, FuncWrapper("autocorrelation", "autocorrelation", lag=1), "peaks", FuncWrapper("index_mass_quantile", "half", q=0.5))
    apart, passed = VALUES - VALUES.mean(), np.cumsum(np.abs(VALUES))
    assert got["autocorrelation"] == pytest.approx((apart[1:] * apart[:-1]).mean() / VALUES.var())
    assert got["peaks"] == ((VALUES[1:-1] > VALUES[:-2]) & (VALUES[1:-1] > VALUES[2:])).sum()
    assert got["half"] == pytest.approx((np.argmax(passed >= passed[-1] / 2) + 1) / len(VALUES))


def test_slope_of_a_large_window(spark):
    got = in_one_window(spark, VALUES, "slope", "auc")
    assert got["slope"] == pytest.approx(np.polyfit(np.arange(len(VALUES)), VALUES, 1)[0])
    assert got["auc"] == pytest.approx(np.trapezoid(VALUES))


def test_slices_keep_the_index_out_of_lambdas(spark):
    """Spark would infer a filter on it for the other side of a join, where it is not."""
    plan = spark.range(3).toDF("moment").select(ordering.Slicing([1, 2]).of_value(F.col("moment")))._jdf.queryExecution().analyzed().toString().split("+-")[0]
    assert "moment#" in plan and not re.search(r"moment#\d", plan.split("lambdafunction", 1)[1])


def test_chunks_of_equal_times(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_ROWS", 50)
    t = pd.date_range("2024-01-01", periods=100, freq="s").delete(range(40, 50))
    df = spark.createDataFrame(pd.DataFrame({"ts": t.repeat(3), "v": np.tile([1.0, 2.0, 3.0], len(t))}))
    got = chunk_data(df.repartition(5), {"v": 1}).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()
    assert sorted(map(tuple, got)) == [(0, 120, 240.0), (1, 150, 300.0)]


#: Queries whose tables may hold several rows of one time.
OF_EQUAL_TIMES = [
    "group_by_consecutive",
    "group_by_of_two_tables",
    "nested_pipelines",
    "outer_merge_of_three",
    "outer_merge_series",
    "pipeline_round_trip",
    "process_array",
    "process_clip_abs",
    "process_dataframe_func",
    "process_detrend",
    "process_difference",
    "process_difference_by_key",
    "process_frame",
    "process_interpolate",
    "process_median_filter",
    "process_named_series",
    "process_rolling_mean",
    "process_series_list",
    "process_shift_rows",
    "python_runs",
]


@pytest.fixture(scope="module")
def thrice(spark, tmp_path_factory):
    """The events with each row three times, of other ids, in no order."""
    folder = tmp_path_factory.mktemp("thrice")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400)
    copies = events.crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    copies.withColumn("event_id", F.col("event_id") + F.col("copy") * 10**6).drop("copy").repartition(3).write.parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("name", OF_EQUAL_TIMES)
def test_equal_times_as_in_sql(spark, thrice, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{thrice}/events.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, thrice).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = list(want.columns)
    want, got = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
    for c in cols:
        if pd.api.types.is_float_dtype(want[c].dtype):
            assert np.allclose(got[c].astype(float), want[c], equal_nan=True, atol=2e-6)
        else:
            assert got[c].tolist() == want[c].tolist()


def several(spark, values, name="v", at=None):
    """Values at times, three of each time if not said otherwise."""
    t = pd.to_datetime(pd.Series(at if at is not None else np.arange(len(values)) // 3), unit="s")
    return spark.createDataFrame(pd.DataFrame({"ts": t, name: values})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_what_is_made_of_a_row_stays_with_it(spark):
    df = several(spark, [5.0, 1.0, 3.0, 2.0, 8.0, 2.0]).repartition(3)
    made = SeriesProcessor(lambda s: [(-s).rename("minus"), s[s > 2].rename("large")], "v")
    pipe = SeriesPipeline([made, SeriesProcessor(P.combine, ("v", "minus"), name="zero"), SeriesProcessor(P.threshold, "v", least=3.0), SeriesProcessor(P.drop_na, "v")])
    got = pipe.process(df, return_df=True).toPandas()
    assert sorted(-got.minus) == [1, 2, 2, 3, 5, 8] and (got.zero == 0).all()
    assert sorted(got.v.dropna()) == [3, 5, 8] and (got.v + got.minus).dropna().eq(0).all()
    assert sorted(got.large.dropna()) == [3, 5, 8]


def test_merge_of_tables_is_a_full_join(spark):
    a = several(spark, [1.0, 2.0, 3.0, 4.0], "a", [0, 0, 1, None])
    b = several(spark, [10.0, 20.0, 30.0, 40.0], "b", [0, 0, 2, None])
    got = outer_merge([Series("a", a, "ts", "a"), Series("b", b, "ts", "b")]).toPandas()
    pairs = sorted(zip(got.a.fillna(0), got.b.fillna(0), strict=True))
    assert pairs == [(0, 30), (0, 40), (1, 10), (1, 20), (2, 10), (2, 20), (3, 0), (4, 0)]


@pytest.mark.parametrize("slice_rows", [3, 1 << 20])
def test_runs_of_equal_times(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(ordering, "SLICE_ROWS", slice_rows)
    kinds = ["x", "x", "x", "y", "y", None, "y", None, None, "x", "x", "x"]
    df = several(spark, np.arange(12.0)).toPandas().assign(kind=kinds)
    df = spark.createDataFrame(df).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3)
    got = FeatureCollection([FeatureDescriptor(f, "v") for f in ("sum", "len")]).calculate(df, return_df=True, group_by_consecutive="kind", index="ts", checks=False)
    assert sorted(tuple(r)[:3] for r in got.orderBy("__start").collect()) == sorted([(3.0, 3, "x"), (33.0, 6, "y"), (30.0, 3, "x")])
