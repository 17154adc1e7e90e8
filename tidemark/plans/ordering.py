"""Row order without one big sort: work in slices of the index, carry over small per-slice summaries.

An ordered window would bring all rows (or all rows of a key) to one task.  Here
the index is cut at its quantiles into slices of about ``SLICE_ROWS`` rows, each
slice (of each key) is ordered by itself, and what a slice needs from those
before it comes from one row per slice.  A table of few rows is one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task orders, about.
SLICE_ROWS = 1 << 20
#: Slices at most: their bounds are an array in the plan, and their summaries without keys one ordered table.
MOST_SLICES = 1 << 14


class Slicing:
    """Slice numbers by the bounds of an index; steps over the same index share one."""

    def __init__(self, bounds: Sequence = ()):
        self.bounds = sorted(set(bounds))

    @classmethod
    def of(cls, df: DataFrame, t: str) -> Slicing:
        """Bounds at approximate quantiles, as many as the number of rows asks for."""
        slices = min(MOST_SLICES, -(-df.count() // SLICE_ROWS))
        if slices < 2:
            return cls()
        cuts = F.percentile_approx(t, F.array(*[F.lit(k / slices) for k in range(1, slices)]), F.lit(20 * slices))
        return cls(df.agg(cuts).first()[0] or ())

    @property
    def single(self) -> bool:
        return not self.bounds

    def of_value(self, t: Column) -> Column:
        """The number of bounds at or below ``t``, by binary search in an array of constants.

        ``t`` is an argument of the lambda around it: of a column inside a lambda,
        Spark may infer a filter for the other side of a join, which does not have it.
        """
        if self.single:
            return F.lit(0)
        steps = 1 << (len(self.bounds).bit_length() - 1)
        padded = F.array(*map(F.lit, self.bounds))
        halves = F.array(*[F.lit(steps >> k) for k in range(steps.bit_length())])
        at_or_below = lambda place, t: (place <= len(self.bounds)) & (F.get(padded, place - 1) <= t)
        search = lambda t: F.aggregate(halves, F.lit(0), lambda n, step: n + F.when(at_or_below(n + step, t), step).otherwise(F.lit(0)))
        return F.get(F.transform(F.array(t), search), F.lit(0))


def _parts(df: DataFrame, t: str, keys: Sequence[str], slicing: Slicing | None) -> tuple[DataFrame, list[str], Slicing]:
    """Rows with their slice, and what partitions them."""
    slicing = slicing or Slicing.of(df, t)
    return df.withColumn("__slice", slicing.of_value(F.col(t))), [*keys, "__slice"], slicing


def _joined(rows: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    # Without keys a summary has one row a slice, MOST_SLICES at most.
    return rows.join(summary if len(by) > 1 else F.broadcast(summary), by, "left")


def with_previous(df: DataFrame, t: str, cols: dict[str, str], keys: Sequence[str] = (), tie: Sequence[str] = (), slicing: Slicing | None = None) -> DataFrame:
    """Add the value that each of ``cols`` (new name -> column) has in the row before, by ``t`` and then ``tie``."""
    part, by, slicing = _parts(df, t, keys, slicing)
    w = Window.partitionBy(*by).orderBy(t, *tie)
    own = part.withColumns({new: F.lag(c).over(w) for new, c in cols.items()})
    if slicing.single:
        return own.select(*df.columns, *cols)
    own = own.withColumn("__row", F.row_number().over(w))
    last = part.groupBy(*by).agg(*[F.max_by(F.struct(F.col(c).alias("x")), F.struct(t, *tie)).alias(f"__last_{new}") for new, c in cols.items()])
    before = Window.partitionBy(*keys).orderBy("__slice")
    out = _joined(own, last.select(*by, *[F.lag(f"__last_{new}").over(before).alias(f"__last_{new}") for new in cols]), by)
    return out.withColumns({new: F.when(F.col("__row") == 1, F.col(f"__last_{new}")["x"]).otherwise(F.col(new)) for new in cols}).select(*df.columns, *cols)


def with_running_sum(df: DataFrame, t: str, value: Column, name: str, keys: Sequence[str] = (), tie: Sequence[str | Column] = (), slicing: Slicing | None = None) -> DataFrame:
    """Add the running sum of ``value`` by ``t`` and then ``tie``, the own row included."""
    part, by, slicing = _parts(df.withColumn("__add", value), t, keys, slicing)
    own = part.withColumn(name, F.sum("__add").over(Window.partitionBy(*by).orderBy(t, *tie).rowsBetween(Window.unboundedPreceding, 0)))
    if slicing.single:
        return own.select(*df.columns, name)
    totals = part.groupBy(*by).agg(F.sum("__add").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(own, totals.select(*by, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before")), by)
    return out.withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def with_position(df: DataFrame, t: str, name: str, keys: Sequence[str] = (), tie: Sequence[str] = (), slicing: Slicing | None = None) -> DataFrame:
    """Add each row's position, from 0, by ``t``."""
    return with_running_sum(df, t, F.lit(1).cast("long"), name, keys, tie, slicing).withColumn(name, F.col(name) - 1)


def with_shifted(df: DataFrame, t: str, value: str, name: str, steps: int, keys: Sequence[str] = (), tie: Sequence[str] = (), slicing: Slicing | None = None) -> DataFrame:
    """Add the value ``steps`` rows before (after, if negative), by positions that are joined."""
    rows = with_position(df, t, "__place", keys, tie, slicing)
    other = rows.select(*keys, (F.col("__place") + steps).alias("__place"), F.col(value).alias(name))
    return rows.join(other, [*keys, "__place"], "left").select(*df.columns, name)


def with_known_neighbours(df: DataFrame, t: str, value: str, keys: Sequence[str] = (), slicing: Slicing | None = None) -> DataFrame:
    """Add the nearest not-null (t, v) at or before (``__prev``) and at or after (``__next``) each row."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    part, by, slicing = _parts(df.withColumn("__point", point), t, keys, slicing)
    back = Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(t).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = part.withColumn("__prev", F.last("__point", True).over(back)).withColumn("__next", F.last("__point", True).over(ahead))
    if not slicing.single:
        ends = part.groupBy(*by).agg(F.max("__point").alias("__l"), F.min("__point").alias("__f"))
        w = Window.partitionBy(*keys).orderBy("__slice")
        carry = ends.select(
            *by,
            F.last("__l", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__pc"),
            F.first("__f", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__nc"),
        )
        out = _joined(out, carry, by).withColumn("__prev", F.coalesce("__prev", "__pc")).withColumn("__next", F.coalesce("__next", "__nc"))
    return out.select(*df.columns, "__prev", "__next")


def trailing(df: DataFrame, t: str, width, aggregates: dict[str, Column], keys: Sequence[str] = (), slicing: Slicing | None = None) -> DataFrame:
    """Aggregates over the trailing range (t - width, t] of integer ``t``; a row also goes to the later slices that its range reaches into."""
    slicing = slicing or Slicing.of(df, t)
    reach = int(width) - 1
    w = Window.partitionBy(*keys, "__slice").orderBy(t).rangeBetween(-reach, 0)
    first, last = slicing.of_value(F.col(t)), slicing.of_value(F.col(t) + F.lit(reach))
    rows = df.withColumn("__slice", F.lit(0)).withColumn("__own", F.lit(True)) if slicing.single else df.withColumn("__first", first).withColumn("__slice", F.explode(F.sequence("__first", last))).withColumn("__own", F.col("__slice") == F.col("__first"))
    return rows.withColumns({n: a.over(w) for n, a in aggregates.items()}).where("__own").select(*df.columns, *aggregates)
