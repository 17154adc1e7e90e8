"""Window grids as arithmetic over index numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def window_count(t0, t1, window, stride, include_final: bool = False) -> int:
    """Number of windows of one stride on the driver."""
    n = 0 if t1 - t0 - window < 0 else int((t1 - t0 - window) // stride) + 1
    return n + (1 if include_final and t0 + stride * n <= t1 else 0)


def count_column(t0: Column, t1: Column, window, stride, include_final: bool) -> Column:
    n = F.when(t1 - t0 - F.lit(window) < 0, F.lit(0)).otherwise(F.floor((t1 - t0 - F.lit(window)) / F.lit(stride)) + 1).cast("long")
    return n + F.when(t0 + n * F.lit(stride) <= t1, 1).otherwise(0) if include_final else n


def _span(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def distinct_union(arrays: list[Column]) -> Column:
    return arrays[0] if len(arrays) == 1 else F.array_distinct(F.concat(*arrays))


def starts_of(t: Column, t0: Column, t1: Column, window, strides, include_final: bool) -> Column:
    """Starts of all windows that hold a sample at ``t``.

    Candidates are found by division and, as division of floats rounds, one
    further on both sides; the comparison with the start itself decides.
    """
    arrays = []
    for s in strides:
        n = count_column(t0, t1, window, s, include_final)
        lo = F.greatest(F.floor((t - t0 - F.lit(window)) / F.lit(s)).cast("long"), F.lit(0).cast("long"))
        hi = F.least(n - 1, F.floor((t - t0) / F.lit(s)).cast("long") + 1)
        arrays.append(F.filter(_starts(_span(lo, hi), t0, s), lambda x: (x <= t) & (t < x + F.lit(window))))
    return distinct_union(arrays)


def _starts(numbers: Column, t0: Column, stride) -> Column:
    return F.transform(numbers, lambda k: t0 + k * F.lit(stride))


def grid(spark: SparkSession, t0, t1, window, strides, include_final: bool) -> DataFrame:
    """All window starts (column s), made in parallel; several strides give the distinct union."""
    kind = "double" if any(isinstance(x, float) for x in (t0, t1, window, *strides)) else "bigint"
    parts = [spark.range(window_count(t0, t1, window, s, include_final)).select((F.lit(t0) + F.col("id") * F.lit(s)).cast(kind).alias("s")) for s in strides]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct() if len(parts) > 1 else out


def keyed_grid(bounds: DataFrame, keys, window, strides, include_final: bool) -> DataFrame:
    """Window starts of every key from its bounds t0 and t1."""
    t0, t1 = F.col("t0"), F.col("t1")
    arrays = [_starts(_span(F.lit(0).cast("long"), count_column(t0, t1, window, s, include_final) - 1), t0, s) for s in strides]
    return bounds.select(*keys, F.explode(distinct_union(arrays)).alias("s"))


def output_index(start: Column, end: Column, window_idx: str) -> Column:
    if window_idx == "begin":
        return start
    if window_idx == "end":
        return end
    if window_idx == "middle":
        return start + (end - start) / 2
    raise ValueError(f"window_idx must be begin, middle or end, not {window_idx!r}")
