"""Operators cut into many slices, blocks and panes give what they give in one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.api import FeatureCollection, FeatureDescriptor, FuncWrapper, MultipleFeatureDescriptors, Series, SeriesPipeline, SeriesProcessor, SeriesSet, chunk_data
from tidemark.operators import collection
from tidemark.operators import processing as P
from tidemark.plans import ordering


@pytest.fixture(params=[5, 1 << 20])
def slice_rows(request, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_ROWS", request.param)
    return request.param


def bursts(n=120, seed=3, keys=1):
    """Rows whose index bunches up, with ties between keys and missing values."""
    rng = np.random.default_rng(seed)
    t = np.cumsum(np.where(rng.random(n) < 0.1, 1000, rng.integers(1, 3, n)))
    v = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n).round(3))
    return pd.DataFrame({"k": rng.integers(0, keys, n), "t": t, "v": v})


def spark_rows(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(4)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ordered_steps(spark, slice_rows, keys):
    pdf = bursts(keys=3)
    df = spark_rows(spark, pdf)
    assert (len(ordering.Slicing.of(df, "t").bounds) > 10) == (slice_rows == 5)
    by = lambda p: p.groupby("k") if keys else p.groupby(lambda _: 0)
    got = ordering.with_previous(df, "t", {"p": "v"}, keys).toPandas().sort_values("t")
    assert np.allclose(got.p.astype(float), by(pdf).v.shift(1), equal_nan=True)
    got = ordering.with_position(df, "t", "n", keys).toPandas().sort_values("t")
    assert got.n.tolist() == by(pdf).cumcount().tolist()
    got = ordering.with_running_sum(df, "t", F.coalesce("v", F.lit(0.0)), "s", keys).toPandas().sort_values("t")
    assert np.allclose(got.s, by(pdf.fillna({"v": 0})).v.cumsum())
    for steps in (2, -3):
        got = ordering.with_shifted(df, "t", "v", "x", steps, keys).toPandas().sort_values("t")
        assert np.allclose(got.x.astype(float), by(pdf).v.shift(steps), equal_nan=True)
    got = ordering.with_known_neighbours(df, "t", "v", keys).toPandas().sort_values("t")
    before = got["__prev"].map(lambda r: np.nan if r is None else r["v"])
    after = got["__next"].map(lambda r: np.nan if r is None else r["v"])
    assert np.allclose(before.astype(float), by(pdf).v.ffill(), equal_nan=True) and np.allclose(after.astype(float), by(pdf).v.bfill(), equal_nan=True)
    got = ordering.trailing(df, "t", 1500, {"m": F.sum("v"), "c": F.count("v")}, keys).toPandas().sort_values("t")
    assert len(got) == len(pdf)
    for r in got.itertuples():
        near = pdf[(pdf.t > r.t - 1500) & (pdf.t <= r.t) & ((pdf.k == r.k) if keys else True)].v
        assert r.c == near.count() and (r.c == 0 or abs(r.m - near.sum()) < 1e-9)


def test_slices_hold_equal_shares(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_ROWS", 100)
    df = spark.range(2000).select(F.when(F.col("id") < 1900, F.col("id")).otherwise(F.col("id") * 10**9).alias("t"))
    slicing = ordering.Slicing.of(df, "t")
    sizes = df.select(slicing.of_value(F.col("t")).alias("s")).groupBy("s").count().toPandas()
    assert len(sizes) >= 15 and sizes["count"].max() <= 250
    bounds = slicing.bounds
    for t in (-1, 0, bounds[0] - 1, bounds[0], bounds[-1], bounds[-1] + 1, 10**15):
        assert spark.range(1).select(slicing.of_value(F.lit(t))).first()[0] == sum(b <= t for b in bounds)


def test_runs_and_processors_in_slices(spark, slice_rows):
    rng = np.random.default_rng(1)
    groups = rng.choice(["a", "b", None], 90).tolist()
    t = pd.date_range("2024-01-01", periods=90, freq="s")
    df = spark.createDataFrame([(x.to_pydatetime(), float(i), g) for i, (x, g) in enumerate(zip(t, groups, strict=True))], "t timestamp_ntz, v double, g string").repartition(3)
    got = FeatureCollection(FeatureDescriptor("len", "v")).calculate(df, return_df=True, group_by_consecutive="g", index="t", checks=False).toPandas().sort_values("__start")
    known = [g for g in groups if g]
    assert got.g.tolist() == [g for i, g in enumerate(known) if i == 0 or known[i - 1] != g]
    out = SeriesPipeline([SeriesProcessor(P.difference, "v"), SeriesProcessor(P.rolling_mean, "v", window="10s")]).process(df.select("t", "v"), return_df=True).toPandas().sort_values("t")
    assert np.allclose(out.v.iloc[20:], 1.0)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_panes_give_what_samples_give(spark, monkeypatch, keys):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 600), "t": np.sort(rng.integers(0, 400, 600)), "v": rng.normal(1e6, 1e-2, 600)})
    pdf.loc[50:60, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    functions = ["sum", "nansum", "abs_area", "abs_energy", "len", "count", "min", "max", "ptp", "mean", "rms", "var", "std", "time_span"]
    fc = FeatureCollection(MultipleFeatureDescriptors(functions, "v", 40, [4, 6]))
    run = lambda: fc.calculate(df.select("k", "t", "v") if keys else df.select("t", "v"), return_df=True, index="t", keys=keys, include_final_window=True, approve_sparsity=True).toPandas().sort_values([*keys, "t"]).reset_index(drop=True)
    got = run()
    monkeypatch.setattr(collection, "PANE_COPIES", 1e9)
    want = run()
    pd.testing.assert_frame_equal(got, want, rtol=1e-6, check_dtype=False)
    assert want["v__std__w=40"].dropna().between(1e-3, 1e-1).all()


def test_panes_take_the_place_of_copies(spark, capsys):
    df = spark.range(100_000).select((F.col("id") * 1).alias("t"), F.rand(1).alias("v"))
    FeatureCollection(FeatureDescriptor("mean", "v", 10_000, 100)).calculate(df, return_df=True, index="t", approve_sparsity=True).explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate explode") == 1 and "pane" in plan


def test_python_windows_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 300), "t": np.sort(rng.integers(0, 500, 300)), "v": rng.random(300)})
    df = spark.createDataFrame(pdf)
    cuts = spark.createDataFrame([(i, int(a), int(a) + int(n)) for i, (a, n) in enumerate(zip(rng.integers(0, 480, 60), rng.integers(0, 200, 60), strict=True))], "segment long, start long, end long")
    total = FuncWrapper(lambda x: float(np.sum(x)), "total")
    for rows in (7, 1 << 17):
        monkeypatch.setattr(collection, "BLOCK_ROWS", rows)
        for keys in ([], ["k"]):
            data = df if keys else df.drop("k")
            both = FeatureCollection([FeatureDescriptor(total, "v", 30, 20), FeatureDescriptor("sum", "v", 30, 20)]).calculate(data, return_df=True, index="t", keys=keys, approve_sparsity=True).toPandas()
            assert len(both) > 20 and np.allclose(both["v__total__w=30"], both["v__sum__w=30"])
            both = FeatureCollection([FeatureDescriptor(total, "v"), FeatureDescriptor("sum", "v")]).calculate(data, return_df=True, index="t", keys=keys, segments=cuts, checks=False).toPandas()
            assert len(both) == 60 * (3 if keys else 1) and np.allclose(both["v__total__w=manual"], both["v__sum__w=manual"])


def test_segment_tables(spark):
    df = spark.range(20).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    run = lambda window=None, **k: FeatureCollection(FeatureDescriptor("sum", "v", window)).calculate(df, return_df=True, index="i", checks=False, **k).toPandas().sort_values("segment")
    starts = spark.createDataFrame([(7, 3), (5, 0), (6, 100)], "segment long, start long")
    assert run(4, segments=starts).iloc[:, 2].tolist() == [6, 0, 18]
    assert sorted(run(4, segment_start_idxs=starts.select("start")).iloc[:, 2]) == [0, 6, 18]
    assert run(4, segment_end_idxs=[4, 7]).iloc[:, 2].tolist() == [6, 18]
    assert len(run(segments=spark.createDataFrame([], "start long, end long"))) == 0
    many = run(segments=spark.range(3000).select((F.col("id") % 20).alias("start"), (F.col("id") % 20 + 1).alias("end"), F.col("id").alias("segment")))
    assert many.iloc[:, 2].tolist() == [float(k % 20) for k in range(3000)]


def test_values_are_paired_by_position(spark):
    even = spark.createDataFrame([(i, float(i)) for i in range(0, 20, 2)], "i long, a double")
    odd = spark.createDataFrame([(i, float(i)) for i in range(1, 20, 2)] + [(30, 1.0)], "i long, b double")
    series = SeriesSet([Series("a", even, "i", "a"), Series("b", odd, "i", "b")])
    fc = FeatureCollection(MultipleFeatureDescriptors(["sum_2", "dot", "abs_mean_diff"], [("a", "b")], 10, 5))
    got = fc.calculate(series, return_df=True, window_idx="begin", approve_sparsity=True, bound_method="outer").toPandas().sort_values("i")
    for r in got.itertuples(index=False):
        a, b = ([x for x in range(k, 20, 2) if r.i <= x < r.i + 10] for k in (0, 1))
        b += [1] if r.i <= 30 < r.i + 10 else []
        pairs = list(zip([float(x) for x in a], [float(x) for x in b], strict=False))
        mean = sum(abs(x - y) for x, y in pairs) / len(pairs) if pairs else np.nan
        assert r[got.columns.get_loc("a|b__sum_2__w=10")] == sum(a) + sum(b) and r[got.columns.get_loc("a|b__dot__w=10")] == sum(x * y for x, y in pairs)
        assert np.isclose(r[got.columns.get_loc("a|b__abs_mean_diff__w=10")], mean, equal_nan=True)


def plain_chunk_ids(tables, margin):
    """Ranges in order of series and time join the first known one within the margin."""
    known, out = [], {}
    for name, ranges in tables:
        for b, e in sorted(ranges):
            found = next((k for k, (x, y) in enumerate(known) if abs(x - b) <= margin and abs(y - e) <= margin), None)
            if found is None:
                found = len(known)
                known.append((b, e))
            out[name, b, e] = found
    return out


def test_chunk_ranges_against_loop(spark):
    rng = np.random.default_rng(4)
    tables, frames, rates = [], [], {}
    for name in "xyz":
        ranges, at = [], 0
        for _ in range(12):
            at += int(rng.integers(20, 25))
            n = int(rng.integers(8, 11))
            ranges.append((at, at + n - 1))
            at += n
        tables.append((name, ranges))
        seconds = [s for b, e in ranges for s in range(b, e + 1)]
        frames.append(spark.createDataFrame(pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, unit="s"), name: 1.0})))
        rates[name] = 1
    got = chunk_data(frames, rates, chunk_range_margin=6).groupBy("series", "chunk_id").agg(F.min("ts").alias("b"), F.max("ts").alias("e")).toPandas()
    second = lambda x: int((x - pd.Timestamp("2024-01-01")) / pd.Timedelta("1s"))
    assert {(r.series, second(r.b), second(r.e)): r.chunk_id for r in got.itertuples()} == plain_chunk_ids(tables, 6)
    alike = frames[0].unionByName(frames[0].select((F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), "x"))
    with pytest.raises(ValueError):
        chunk_data(alike, {"x": 1}, chunk_range_margin="2D")
