"""Feature functions as Catalyst aggregates.

``NaN`` policy: windows see values as arrays do (NaN propagates), groups of
``group_by_all`` as labelled series do (NaN is skipped, except by the median).
Empty windows: sum 0, count 0, else NaN.

Functions with an entry in ``FROM_PARTS`` can also be made from aggregates of
panes, the gap-free stretches that windows are unions of.  Functions of two
series pair their values by position in the window (``PAIRED``) or aggregate
each series by itself (``APART``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
PROPAGATE, SKIP = "propagate", "skip"
#: Kept by identity: numpy and built-in functions with a native counterpart.
BY_FUNCTION = {np.sum: "sum", np.min: "min", np.max: "max", np.mean: "mean", np.median: "median", np.std: "std", np.var: "var", np.nansum: "nansum", len: "len", sum: "sum", min: "min", max: "max"}


def native_name(func) -> str | None:
    if isinstance(func, str):
        return func if func in NATIVE else None
    try:
        return BY_FUNCTION.get(func)
    except TypeError:
        return None


def number(v: Column) -> Column:
    return v.cast("double")


def kept(v: Column, policy: str) -> Column:
    """Values that take part; with ``skip`` NaN becomes null, which aggregates leave out."""
    return F.when(~F.isnan(number(v)), number(v)) if policy == SKIP else number(v)


def guarded(v: Column, policy: str, out: Column) -> Column:
    """NaN if any value is: for aggregates that would sort or drop it."""
    return out if policy == SKIP else F.when(F.bool_or(F.isnan(number(v))), F.lit(NAN)).otherwise(out)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once.

    A lambda works out all that it refers to for each element, so what holds
    for the whole array is named by this before.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ordered_pairs(t: Column, v: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct(t.alias("t"), number(v).alias("v"))))


def ordered(t: Column, v: Column) -> Column:
    """Values by index."""
    return F.transform(ordered_pairs(t, v), lambda p: p["v"])


def ordered_times(t: Column) -> Column:
    return F.sort_array(F.collect_list(t))


def neighbours(a: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` each element but the last and the one after it, in an array of two or more, else an empty array."""
    n = lambda a: F.greatest(F.size(a) - 1, F.lit(0))
    return once(a, lambda a: F.zip_with(F.slice(a, 1, n(a)), F.slice(a, 2, n(a)), of))


def diffs(a: Column) -> Column:
    """Differences of neighbours in an array of two or more, else an empty array."""
    return neighbours(a, lambda x, y: y - x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column) -> Column:
    return once(a, lambda a: total(a) / F.nullif(F.size(a), F.lit(0)))


def variance_of(a: Column) -> Column:
    """Population variance of an array."""
    return once(a, lambda a: once(mean_of(a), lambda m: mean_of(F.transform(a, lambda x: (x - m) * (x - m)))))


def spread_of(a: Column) -> Column:
    """Population standard deviation of an array."""
    return F.sqrt(variance_of(a))


def seconds(t: Column, time: bool) -> Column:
    return t / 1e6 if time else t.cast("double")


def _moment(name: str) -> Callable:
    def build(t, v, p, time, **_):
        return [F.coalesce(guarded(v, p, getattr(F, name)(kept(v, p))), F.lit(NAN))]

    return build


def _trend(t, v, p, time, per: float = 3600.0, **_):
    # Hours since the epoch keep slope and correlation; the intercept is moved to the first sample.
    x = seconds(t, time) / per if time else seconds(t, time)
    slope = F.regr_slope(kept(v, p), x)
    return [slope, F.regr_intercept(kept(v, p), x) + slope * F.min(x), F.corr(kept(v, p), x)]


def _quantile(t, v, p, time, q=0.5, **_):
    qs = list(q) if isinstance(q, list | tuple) else [q]
    got = F.percentile(kept(v, p), F.array(*map(F.lit, qs)))
    return [F.coalesce(guarded(v, p, got[i]), F.lit(NAN)) for i in range(len(qs))]


def _index_mass_quantile(t, v, p, time, q=0.5, **_):
    """Share of the window, by position, that has passed when a share ``q`` of the absolute mass has."""
    def share(sizes, mass):
        steps = F.aggregate(sizes, F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n")), lambda s, x: F.struct((s["mass"] + x).alias("mass"), (s["n"] + F.when(s["mass"] + x < F.lit(q) * mass, 1).otherwise(0)).alias("n")))
        return F.when(mass > 0, F.least(steps["n"] + 1, F.size(sizes)) / F.size(sizes))

    return [once(F.transform(ordered(t, v), F.abs), lambda sizes: once(total(sizes), lambda mass: share(sizes, mass)))]


def _autocorrelation(t, v, p, time, lag=1, **_):
    """Mean product of deviations ``lag`` samples apart, by the population variance."""
    def ratio(a, middle):
        n = F.size(a) - lag
        products = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(a, lag + 1, F.greatest(n, F.lit(0))), lambda x, y: (x - middle) * (y - middle))
        return F.when(n > 0, F.try_divide(total(products) / n, variance_of(a)))

    return [once(ordered(t, v), lambda a: once(mean_of(a), lambda middle: ratio(a, middle)))]


def _peaks(t, v, p, time, n=1, **_):
    """Values larger than each of their ``n`` neighbours on both sides."""
    def count(a):
        inside = F.when(F.size(a) > 2 * n, F.sequence(F.lit(n), F.size(a) - n - 1)).otherwise(F.array().cast("array<int>"))
        higher = lambda i: fold(lambda x, y: x & y, [(F.get(a, i) > F.get(a, i + k)) & (F.get(a, i) > F.get(a, i - k)) for k in range(1, n + 1)])
        return F.size(F.filter(inside, higher))

    return [once(ordered(t, v), count)]


def _value_entropy(t, v, p, time, **_):
    """Shannon entropy (bits) of the distinct values' shares, by the number of distinct values' bits; 0 for one value."""
    n = F.count(kept(v, p))
    part = lambda k: F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(F.lit(0.0))

    def add(s, x):
        # Equal values lie together; a run's part is added when the next one begins.
        same = s["x"] == x
        return F.struct(x.alias("x"), F.when(same, s["k"] + 1).otherwise(F.lit(1)).alias("k"), (s["d"] + F.when(same, 0).otherwise(1)).alias("d"), (s["bits"] + F.when(same, F.lit(0.0)).otherwise(part(s["k"]))).alias("bits"))

    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0).alias("k"), F.lit(0).alias("d"), F.lit(0.0).alias("bits"))
    whole = F.aggregate(F.sort_array(F.collect_list(kept(v, p))), start, add, lambda s: F.struct(s["d"].alias("d"), (s["bits"] + part(s["k"])).alias("bits")))
    return [once(whole, lambda w: F.when(w["d"] > 1, w["bits"] / F.log2(w["d"])).when(w["d"] > 0, F.lit(0.0)))]


def _binned_entropy(t, v, p, time, bins=10, **_):
    """Shannon entropy (nats) of the shares of equal bins from the smallest to the largest value."""
    low, high, n = F.min(kept(v, p)), F.max(kept(v, p)), F.count(kept(v, p))
    places = F.transform(F.collect_list(kept(v, p)), lambda x: F.least(F.floor(F.try_divide(x - low, high - low) * bins), F.lit(bins - 1).cast("long")))
    shares = once(places, lambda a: F.filter(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(a, lambda x: x == k)) / n), lambda x: x > 0))
    return [F.when(n == 0, F.lit(None).cast("double")).when(low == high, F.lit(0.0)).otherwise(-total(F.transform(shares, lambda x: x * F.log(x))))]


def _histogram(t, v, p, time, bins=10, low=0.0, high=1.0, **_):
    """Counts of ``bins`` equal bins of [low, high], the last one closed."""
    x, width = number(v), (high - low) / bins
    place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1).cast("long"))
    return [F.count_if((x >= F.lit(low)) & (x <= F.lit(high)) & (place == k)) for k in range(bins)]


def _relative_slope(t, v, p, time, **_):
    first, last = F.min_by(number(v), t), F.max_by(number(v), t)
    return [F.when(first == 0, F.lit(0.0)).otherwise((last - first) / first)]


def _area_under_curve(t, v, p, time, **_):
    """Trapezoids over the index (seconds for times)."""
    return [total(neighbours(ordered_pairs(t, v), lambda x, y: (x["v"] + y["v"]) / 2 * seconds(y["t"] - x["t"], time)))]


def _category_counts(t, v, p, time, categories=(), **_):
    return [F.count_if(v.cast("string") == str(c)) for c in categories]


#: name -> (outputs, builder, values for empty windows)
NATIVE: dict[str, tuple] = {
    "sum": (["sum"], lambda t, v, p, time, **_: [F.coalesce(F.sum(kept(v, p)), F.lit(0.0))], 0.0),
    "nansum": (["nansum"], lambda t, v, p, time, **_: [F.coalesce(F.sum(kept(v, SKIP)), F.lit(0.0))], 0.0),
    "abs_area": (["abs_area"], lambda t, v, p, time, **_: [F.coalesce(F.sum(F.abs(kept(v, p))), F.lit(0.0))], 0.0),
    "abs_energy": (["abs_energy"], lambda t, v, p, time, **_: [F.coalesce(F.sum(kept(v, p) * kept(v, p)), F.lit(0.0))], 0.0),
    "len": (["len"], lambda t, v, p, time, **_: [F.count(F.lit(1))], 0),
    "count": (["count"], lambda t, v, p, time, **_: [F.count(kept(v, SKIP))], 0),
    "n_unique": (["n_unique"], lambda t, v, p, time, **_: [F.count_distinct(v)], 0),
    "min": (["min"], _moment("min"), NAN),
    "max": (["max"], _moment("max"), NAN),
    "mean": (["mean"], _moment("avg"), NAN),
    "std": (["std"], _moment("stddev_pop"), NAN),
    "var": (["var"], _moment("var_pop"), NAN),
    "median": (["median"], lambda t, v, p, time, **_: [F.coalesce(guarded(v, PROPAGATE, F.median(number(v))), F.lit(NAN))], NAN),
    "skew": (["skew"], _moment("skewness"), NAN),
    "kurtosis": (["kurtosis"], _moment("kurtosis"), NAN),
    "rms": (["rms"], lambda t, v, p, time, **_: [F.coalesce(F.sqrt(F.avg(kept(v, p) * kept(v, p))), F.lit(NAN))], NAN),
    "ptp": (["ptp"], lambda t, v, p, time, **_: [F.coalesce(guarded(v, p, F.max(kept(v, p)) - F.min(kept(v, p))), F.lit(NAN))], NAN),
    "quantile": (["quantile"], _quantile, NAN),
    "iqr": (["iqr"], lambda t, v, p, time, **_: [F.coalesce(guarded(v, p, F.percentile(kept(v, p), F.lit(0.75)) - F.percentile(kept(v, p), F.lit(0.25))), F.lit(NAN))], NAN),
    "first": (["first"], lambda t, v, p, time, **_: [F.min_by(number(v), t)], NAN),
    "last": (["last"], lambda t, v, p, time, **_: [F.max_by(number(v), t)], NAN),
    "mean_diff": (["mean_diff"], lambda t, v, p, time, **_: [mean_of(diffs(ordered(t, v)))], NAN),
    "mean_abs_diff": (["mean_abs_diff"], lambda t, v, p, time, **_: [mean_of(F.transform(diffs(ordered(t, v)), F.abs))], NAN),
    "sum_abs_diff": (["sum_abs_diff"], lambda t, v, p, time, **_: [total(F.transform(diffs(ordered(t, v)), F.abs))], 0.0),
    "std_diff": (["std_diff"], lambda t, v, p, time, **_: [spread_of(diffs(ordered(t, v)))], NAN),
    "distance": (["distance"], lambda t, v, p, time, **_: [total(F.transform(diffs(ordered(t, v)), lambda x: F.sqrt(1 + x * x)))], 0.0),
    "std_time_diff": (["std_time_diff"], lambda t, v, p, time, **_: [spread_of(F.transform(diffs(ordered_times(t)), lambda x: seconds(x, time)))], NAN),
    "cid_ce": (["cid_ce"], lambda t, v, p, time, **_: [F.sqrt(total(F.transform(diffs(ordered(t, v)), lambda x: x * x)))], 0.0),
    "zero_cross": (["zero_cross"], lambda t, v, p, time, **_: [F.size(F.filter(diffs(F.transform(ordered(t, v), F.signum)), lambda x: x != 0))], 0),
    "slope": (["slope"], lambda t, v, p, time, **_: [_slope_by_position(ordered(t, v))], NAN),
    "trend": (["slope", "intercept", "rvalue"], _trend, NAN),
    "time_span": (["time_span"], lambda t, v, p, time, **_: [seconds(F.max(t) - F.min(t), time)], NAN),
    "max_time_diff": (["max_time_diff"], lambda t, v, p, time, **_: [seconds(F.array_max(diffs(ordered_times(t))), time)], NAN),
    "min_time_diff": (["min_time_diff"], lambda t, v, p, time, **_: [seconds(F.array_min(diffs(ordered_times(t))), time)], NAN),
    "category_counts": (["category_counts"], _category_counts, 0),
    "variance_larger_than_std": (["variance_larger_than_std"], lambda t, v, p, time, **_: [(F.var_pop(kept(v, p)) > F.stddev_pop(kept(v, p))).cast("double")], NAN),
    "hour_of_last": (["hour_of_last"], lambda t, v, p, time, **_: [F.hour(F.max_by(v, t))], NAN),
    "minute_of_last": (["minute_of_last"], lambda t, v, p, time, **_: [F.minute(F.max_by(v, t))], NAN),
    "index_mass_quantile": (["index_mass_quantile"], _index_mass_quantile, NAN),
    "autocorrelation": (["autocorrelation"], _autocorrelation, NAN),
    "peaks": (["peaks"], _peaks, 0),
    "value_entropy": (["value_entropy"], _value_entropy, NAN),
    "binned_entropy": (["binned_entropy"], _binned_entropy, NAN),
    "histogram": (["histogram"], _histogram, 0),
    "relative_slope": (["relative_slope"], _relative_slope, NAN),
    "auc": (["auc"], _area_under_curve, 0.0),
    "weekday_of_last": (["weekday_of_last"], lambda t, v, p, time, **_: [F.weekday(F.max_by(v, t))], NAN),
}

#: Functions of two series' values, paired by position: name -> (outputs, builder(a, b), empty)
PAIRED: dict[str, tuple] = {
    "corr": (["corr"], lambda a, b: [F.coalesce(F.corr(number(a), number(b)), F.lit(NAN))], NAN),
    "dot": (["dot"], lambda a, b: [F.coalesce(F.sum(number(a) * number(b)), F.lit(0.0))], 0.0),
    "abs_mean_diff": (["abs_mean_diff"], lambda a, b: [F.coalesce(F.avg(F.abs(number(a) - number(b))), F.lit(NAN))], NAN),
}
#: Functions of several series that put together an aggregate of each: name -> (outputs, aggregate of one, combination, empty)
APART: dict[str, tuple] = {
    "sum_2": (["sum_2"], lambda v: F.sum(number(v)), lambda parts: [fold(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in parts])], 0.0),
}
NATIVE |= {k: (v[0], None, v[2]) for k, v in PAIRED.items()} | {k: (v[0], None, v[3]) for k, v in APART.items()}

#: Aggregates of panes and how they come together: name -> (of a pane's values, of panes)
PARTS: dict[str, tuple] = {
    "rows": (lambda v, t: F.count(F.lit(1)), F.sum),
    "count": (lambda v, t: F.count(number(v)), F.sum),
    "known": (lambda v, t: F.count(kept(v, SKIP)), F.sum),
    "nan": (lambda v, t: F.coalesce(F.bool_or(F.isnan(number(v))), F.lit(False)), F.bool_or),
    "sum": (lambda v, t: F.sum(number(v)), F.sum),
    "nansum": (lambda v, t: F.sum(kept(v, SKIP)), F.sum),
    "abs": (lambda v, t: F.sum(F.abs(number(v))), F.sum),
    "square": (lambda v, t: F.sum(number(v) * number(v)), F.sum),
    "min": (lambda v, t: F.min(number(v)), F.min),
    "max": (lambda v, t: F.max(number(v)), F.max),
    "begin": (lambda v, t: F.min(t), F.min),
    "end": (lambda v, t: F.max(t), F.max),
    "first": (lambda v, t: F.min(F.struct(t.alias("t"), number(v).alias("v"))), F.min),
    "last": (lambda v, t: F.max(F.struct(t.alias("t"), number(v).alias("v"))), F.max),
    "spread": (lambda v, t: F.struct(F.count(number(v)).alias("n"), F.avg(number(v)).alias("m"), (F.var_pop(number(v)) * F.count(number(v))).alias("s")), F.collect_list),
}


def _merged_variance(panes: Column) -> Column:
    """Population variance from the counts, means and squared deviations of panes, added one at a time."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def add(a, b):
        n, step = a["n"] + b["n"], b["m"] - a["m"]
        return F.struct(n.alias("n"), (a["m"] + step * b["n"] / n).alias("m"), (a["s"] + b["s"] + step * step * a["n"] * b["n"] / n).alias("s"))

    whole = F.aggregate(F.filter(panes, lambda x: x["n"] > 0), start, add)
    return F.when(whole["n"] > 0, whole["s"] / whole["n"])


def _or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(NAN))


#: name -> (parts, value of the merged parts m): windows, so NaN propagates
FROM_PARTS: dict[str, tuple] = {
    "sum": (["sum"], lambda m, time: F.coalesce(m["sum"], F.lit(0.0))),
    "nansum": (["nansum"], lambda m, time: F.coalesce(m["nansum"], F.lit(0.0))),
    "abs_area": (["abs"], lambda m, time: F.coalesce(m["abs"], F.lit(0.0))),
    "abs_energy": (["square"], lambda m, time: F.coalesce(m["square"], F.lit(0.0))),
    "len": (["rows"], lambda m, time: m["rows"]),
    "count": (["known"], lambda m, time: m["known"]),
    "min": (["min", "nan"], lambda m, time: _or_nan(F.when(m["nan"], NAN).otherwise(m["min"]))),
    "max": (["max", "nan"], lambda m, time: _or_nan(F.when(m["nan"], NAN).otherwise(m["max"]))),
    "ptp": (["min", "max", "nan"], lambda m, time: _or_nan(F.when(m["nan"], NAN).otherwise(m["max"] - m["min"]))),
    "mean": (["sum", "count"], lambda m, time: _or_nan(F.try_divide(m["sum"], m["count"]))),
    "rms": (["square", "count"], lambda m, time: _or_nan(F.sqrt(F.try_divide(m["square"], m["count"])))),
    "var": (["spread"], lambda m, time: _or_nan(_merged_variance(m["spread"]))),
    "std": (["spread"], lambda m, time: _or_nan(F.sqrt(_merged_variance(m["spread"])))),
    "first": (["first"], lambda m, time: m["first"]["v"]),
    "last": (["last"], lambda m, time: m["last"]["v"]),
    "time_span": (["begin", "end"], lambda m, time: seconds(m["end"] - m["begin"], time)),
}


def has_parts(name: str, kwargs: dict) -> bool:
    return name in FROM_PARTS and set(kwargs) <= {"min_nb_samples", "error_val", "passthrough_nans"} and kwargs.get("passthrough_nans", True)


def parts_of(name: str, kwargs: dict) -> list[str]:
    return [*FROM_PARTS[name][0], *(["count"] if kwargs.get("min_nb_samples") else [])]


def from_parts(name: str, merged: dict[str, Column], time: bool, kwargs: dict) -> Column:
    out = FROM_PARTS[name][1](merged, time)
    return F.when(merged["count"] >= kwargs["min_nb_samples"], out).otherwise(F.lit(kwargs.get("error_val", NAN))) if kwargs.get("min_nb_samples") else out


def _slope_by_position(a: Column) -> Column:
    def slope(a):
        n = F.size(a).cast("double")  # its cube is too large for an integer from 1,291 values on
        return total(F.transform(a, lambda x, i: (i - (n - 1) / 2) * x)) / F.nullif(n * (n * n - 1) / 12, F.lit(0.0))

    return once(a, slope)


def default_outputs(name: str, kwargs: dict) -> list[str]:
    if name == "quantile" and "q" in kwargs:
        q = kwargs["q"]
        return [f"quantile_{x:g}" for x in (q if isinstance(q, list | tuple) else [q])]
    if name == "category_counts":
        return [f"count_{c}" for c in kwargs.get("categories", ())]
    if name == "histogram":
        return [f"histogram_{k}" for k in range(kwargs.get("bins", 10))]
    return list(NATIVE[name][0])


def build(name: str, values: list[Column], t: Column, policy: str, time: bool, kwargs: dict) -> list[Column]:
    """Aggregate columns of a native function; robust settings mask NaN and ask for a number of samples."""
    kwargs = dict(kwargs)
    least, error, passing = kwargs.pop("min_nb_samples", 0), kwargs.pop("error_val", NAN), kwargs.pop("passthrough_nans", True)
    if not passing:
        values = [F.when(~F.isnan(number(v)), v) for v in values]
    cols = PAIRED[name][1](*values) if name in PAIRED else NATIVE[name][1](t, values[0], policy, time, **kwargs)
    if least:
        enough = fold(lambda a, b: a & b, [F.count(v) >= least for v in values])
        errors = list(error) if isinstance(error, list | tuple) else [error] * len(cols)
        cols = [F.when(enough, c).otherwise(F.lit(e)) for c, e in zip(cols, errors, strict=True)]
    return cols


def empty_values(name: str, kwargs: dict, n: int) -> list:
    if kwargs.get("min_nb_samples"):
        e = kwargs.get("error_val", NAN)
        return list(e) if isinstance(e, list | tuple) else [e] * n
    return [NATIVE[name][2]] * n


def make_robust(func, min_nb_samples: int = 1, error_val=NAN, passthrough_nans: bool = True, output_names=None):
    """A wrapper that gives ``error_val`` for windows of too few samples and may drop NaN first."""
    from ..model import FuncWrapper, name_of

    inner = func if isinstance(func, FuncWrapper) else FuncWrapper(func, output_names)
    if inner.native:
        return FuncWrapper(inner.native, list(inner.output_names), **(inner.kwargs | {"min_nb_samples": min_nb_samples, "error_val": error_val, "passthrough_nans": passthrough_nans}))

    def robust(*series, **kwargs):
        xs = [np.asarray(s) for s in series] if passthrough_nans else [np.asarray(s)[~np.isnan(np.asarray(s, float))] for s in series]
        return error_val if any(len(x) < min_nb_samples for x in xs) else inner.func(*xs, **inner.kwargs)

    robust.__name__ = name_of(inner.func)
    return FuncWrapper(robust, list(inner.output_names))
