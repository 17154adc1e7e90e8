import numpy as np
import pandas as pd
import pytest

from tidemark import timeargs
from tidemark.api import FeatureCollection, FeatureDescriptor, FuncWrapper, MultipleFeatureDescriptors, make_robust
from tidemark.plans import grid
from tidemark.sources.readers import load_config


def frame(spark, values, index=None):
    rows = [(float(i) if isinstance(i, float) else i, float(v)) for i, v in zip(index if index is not None else range(len(values)), values, strict=True)]
    return spark.createDataFrame(rows, "i double, v double" if index is not None else "i long, v double")


def run(spark, df, func, window, stride=None, **kw):
    out = FeatureCollection(FeatureDescriptor(func, "v", window, stride)).calculate(df, return_df=True, index="i", **kw).toPandas()
    by = "segment" if "segment" in out else "i"
    return out.sort_values(by)


@pytest.mark.parametrize(("window", "stride", "default", "final"), [(3, 1, 2, 3), (3, 2, 1, 2), (3, 4, 1, 2), (3, 5, 1, 1), (4, 1, 1, 2), (5, 1, 0, 1), (6, 1, 0, 1)])
def test_window_counts(window, stride, default, final):
    assert grid.window_count(0, 4, window, stride) == default
    assert grid.window_count(0, 4, window, stride, True) == final


def test_hops_and_final_window(spark):
    df = frame(spark, range(6))
    assert run(spark, df, "min", 3, 1, window_idx="begin").iloc[:, 1].tolist() == [0, 1, 2]
    assert run(spark, df, "min", 3, 1, window_idx="begin", include_final_window=True).iloc[:, 1].tolist() == [0, 1, 2, 3]
    assert run(spark, frame(spark, range(10)), "max", 2, 2).iloc[:, 1].tolist() == [1, 3, 5, 7]


def test_float_index(spark):
    df = frame(spark, range(6), [0.0, 1.0, 2.0, 2.5, 3.0, 4.0])
    assert run(spark, df, "min", 3.0, 1.0, window_idx="begin").iloc[:, 1].tolist() == [0, 1]


def test_stride_union(spark):
    t = pd.date_range("2024-01-01", periods=20, freq="h")
    df = spark.createDataFrame(pd.DataFrame({"i": t, "v": np.arange(20.0)}))
    got = run(spark, df, "len", "3h", ["3h", "5h"], window_idx="begin")
    assert ((got.i - t[0]) / pd.Timedelta("1h")).tolist() == [0, 3, 5, 6, 9, 10, 12, 15]


def test_random_grids_against_numpy(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        t = np.sort(rng.integers(0, 200, 60))
        w, s = int(rng.integers(1, 40)), sorted({int(x) for x in rng.integers(1, 30, 2)})
        df = spark.createDataFrame(pd.DataFrame({"i": t, "v": rng.random(60)}))
        got = run(spark, df, "len", w, s, window_idx="begin")
        starts = sorted({int(t[0] + k * x) for x in s for k in range(max((t[-1] - t[0] - w) // x + 1, 0))})
        assert got.i.tolist() == starts
        assert got.iloc[:, 1].tolist() == [int(((t >= a) & (t < a + w)).sum()) for a in starts]


def test_segments_keep_order(spark):
    df = frame(spark, range(20))
    got = run(spark, df, "len", None, segment_start_idxs=[0, 5, 3, 3], segment_end_idxs=[5, 10, 8, 5])
    assert got["v__len__w=manual"].tolist() == [5, 5, 5, 2]
    assert run(spark, df, "len", 5, segment_start_idxs=[200])["v__len__w=5"].tolist() == [0]
    with pytest.raises(AssertionError):
        run(spark, df, "len", None, segment_start_idxs=[3], segment_end_idxs=[1])


def plain_runs(groups):
    """(start, end, value) of runs of equal values over positions; rows without a value neither start nor end one."""
    out = []
    for i, g in enumerate(groups):
        if g is None:
            continue
        if out and out[-1][2] == g:
            out[-1][1] = i
        else:
            out.append([i, i, g])
    return [tuple(r) for r in out]


def test_consecutive_runs(spark):
    rng = np.random.default_rng(6)
    groups = [g for g in rng.choice(["p", "q", "r", ""], 30).tolist() for _ in range(int(rng.integers(1, 6)))]
    groups = [g or None for g in groups]
    df = spark.createDataFrame([(i, float(i), g) for i, g in enumerate(groups)], "i long, v double, g string")
    fc = FeatureCollection([FeatureDescriptor("sum", "v"), FeatureDescriptor(FuncWrapper(lambda x: float(x.max()), "top"), "v")])
    got = fc.calculate(df, return_df=True, group_by_consecutive="g", index="i", checks=False).toPandas().sort_values("__start")
    want = plain_runs(groups)
    assert list(zip(got["__start"], got["__end"], got["g"], strict=True)) == want
    # A run's features are over all rows up to the next run.
    ends = [r[0] for r in want[1:]] + [len(groups)]
    assert got["v__sum__w=manual"].tolist() == [sum(range(r[0], e)) for r, e in zip(want, ends, strict=True)]
    assert got["v__top__w=manual"].tolist() == [e - 1 for e in ends]


def test_nan_policies(spark):
    df = spark.createDataFrame([(0, 1.0, "x"), (1, float("nan"), "x"), (2, 4.0, "x"), (3, 9.0, "x")], "i long, v double, g string")
    fc = FeatureCollection(MultipleFeatureDescriptors(["sum", "min", "median"], "v"))
    skip = fc.calculate(df.select("i", "v", "g"), return_df=True, group_by_all="g", index="i").toPandas().iloc[0]
    assert skip["v__sum__w=manual"] == 14 and skip["v__min__w=manual"] == 1 and np.isnan(skip["v__median__w=manual"])
    whole = fc.calculate(df.select("i", "v"), return_df=True, index="i", segment_start_idxs=[0], segment_end_idxs=[4]).toPandas().iloc[0]
    assert np.isnan(whole[["v__sum__w=manual", "v__min__w=manual", "v__median__w=manual"]].astype(float)).all()


def test_python_functions(spark):
    df = frame(spark, range(10))
    fc = FeatureCollection([FeatureDescriptor(FuncWrapper(lambda x: (x.min(), x.max()), ["lo", "hi"]), "v", 4, 2), FeatureDescriptor(FuncWrapper(np.mean, "m", vectorized=True, axis=1), "v", 4, 2)])
    got = fc.calculate(df, return_df=True, index="i", window_idx="begin").toPandas().sort_values("i")
    assert got["v__lo__w=4"].tolist() == [0, 2, 4] and got["v__hi__w=4"].tolist() == [3, 5, 7] and got["v__m__w=4"].tolist() == [1.5, 3.5, 5.5]


def test_robust(spark):
    df = frame(spark, [5.0, 6.0, 7.0], [0.0, 1.0, 9.0])
    got = run(spark, df, make_robust("min", min_nb_samples=2), 3.0, 3.0)
    assert got.iloc[:, 1].fillna(-1).tolist() == [5, -1, -1]


@pytest.mark.parametrize(
    ("name", "want"),
    [("std_diff", lambda t, v: np.std(np.diff(v))), ("distance", lambda t, v: np.sqrt(1 + np.diff(v) ** 2).sum()), ("std_time_diff", lambda t, v: np.std(np.diff(t)))],
)
def test_change_features(spark, name, want):
    rng = np.random.default_rng(4)
    t, v = np.cumsum(rng.integers(1, 4, 30)).astype(float), rng.normal(size=30)
    got = run(spark, frame(spark, v, t.tolist()), name, 20.0, 10.0, window_idx="begin")
    inside = [(t >= s) & (t < s + 20) for s in got["i"]]
    assert len(got) > 2 and np.allclose(got.iloc[:, 1], [want(t[k], v[k]) for k in inside])


def test_minute_of_last_value(spark):
    rows = [(i, pd.Timestamp(2024, 1, 1, 5, 7 * i).to_pydatetime()) for i in range(6)]
    got = run(spark, spark.createDataFrame(rows, "i long, v timestamp"), "minute_of_last", 3, 1, window_idx="begin")
    assert got.iloc[:, 1].tolist() == [14, 21, 28]


def test_registry_and_config(tmp_path):
    fc = FeatureCollection(MultipleFeatureDescriptors(["sum", "max"], ["a", "b"], [4, 8], 2))
    assert fc.get_nb_output_features() == 8 and set(fc.get_required_series()) == {"a", "b"}
    small = fc.reduce(["a__sum__w=4"])
    assert small.get_nb_output_features() == 1 and "win: 4" in repr(small)
    with pytest.raises(AssertionError):
        fc.reduce(["c__sum__w=4"])
    with pytest.raises(AssertionError):
        fc.add(FeatureDescriptor("sum", "a", 4, 1))
    with pytest.raises(TypeError):
        fc.add("x")
    with pytest.raises(TypeError):
        FeatureDescriptor("sum", "a", "4h", 2)
    with pytest.raises(AssertionError):
        FeatureDescriptor("sum", "a", None, 2)
    fc.serialize(tmp_path / "fc.bin")
    assert load_config(tmp_path / "fc.bin").get_nb_output_features() == 8


@pytest.mark.parametrize(("text", "short"), [("3W", "21D"), ("5h", "5h"), ("45min", "45m"), ("60ms", "0.06s"), ("2500us", "0.002s"), ("-90min", "NEG_1h30m"), ("2D 6h", "2D_6h")])
def test_time_strings(text, short):
    assert timeargs.short(timeargs.parse_time(text)) == short


def test_time_arguments():
    with pytest.raises(ValueError):
        timeargs.parse_time("30")
    with pytest.raises(TypeError):
        timeargs.parse_time(3)


def test_plans_have_no_loops_and_no_python(spark, capsys):
    t = pd.date_range("2024-01-01", periods=20, freq="h")
    df = spark.createDataFrame(pd.DataFrame({"i": t, "v": np.arange(20.0)}))
    FeatureCollection(FeatureDescriptor("sum", "v", "3h", "1h")).calculate(df, return_df=True, index="i").explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Python" not in plan and "Pandas" not in plan
