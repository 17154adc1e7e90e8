"""Gap-based chunking: rows with the number of their gap-free chunk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import SeriesSet, is_time
from ..plans import ordering
from ..runtime import write_once
from ..timeargs import parse_time

#: A gap is a step of more than so many sample periods.
GAP_PERIODS = 1.5


def chunk_data(
    data,
    fs_dict: Mapping[str, float] | None = None,
    chunk_range_margin: float | str | None = None,
    min_chunk_dur: float | str | None = None,
    max_chunk_dur: float | str | None = None,
    sub_chunk_overlap: float | str = 0,
    copy: bool = True,
    verbose: bool = False,
    *,
    index: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """keys, chunk_id, series, index, value: all rows of chunks of over two samples.

    Chunks of different series whose ranges agree within the margin share an
    id.  A gap right before the last sample does not split it off.  Chunks over
    ``max_chunk_dur`` are cut into sub-chunks with both ends inclusive.
    Durations are seconds or strings with a unit; a dict of DataFrames gives
    all columns of a frame the sampling rate of its key.
    """
    if fs_dict is None and chunk_range_margin is None:
        raise ValueError("give sampling rates or a margin")
    rates = dict(fs_dict or {})
    if isinstance(data, Mapping) and not isinstance(data, SeriesSet):
        sets = {k: SeriesSet.of(v, index, keys) for k, v in data.items()}
        rates = {n: rates[k] for k, s in sets.items() for n in s if k in rates}
        data = list(sets.values())
        if len({n for s in sets.values() for n in s}) < sum(map(len, sets.values())):
            raise AssertionError("series names must be unique")
    series = SeriesSet.of(data, index, keys)
    one = next(iter(series.values()))
    if not all(is_time(s.kind) for s in series.values()):
        raise NotImplementedError("chunking needs a time index")
    margin = _micros(chunk_range_margin) if chunk_range_margin is not None else int(2e6 / min(rates.values()))
    shortest, longest = _micros(min_chunk_dur), _micros(max_chunk_dur)
    half = (_micros(sub_chunk_overlap) or 0) // 2
    parts = []
    for order, s in enumerate(series.values()):
        samples = s.numbered().withColumn("__raw", F.col("v"))
        slicing = ordering.Slicing.of(samples, "t")
        rows = ordering.with_previous(samples, "t", {"__p": "t"}, keys, slicing=slicing)
        # The longest step is asked for only if there is no rate, since it needs the rows in order.
        known = s.name in rates
        facts = [F.max("t").alias("__last"), F.count(F.lit(1)).alias("__all"), *([] if known else [F.max(F.col("t") - F.col("__p")).alias("__step")])]
        steps = (samples if known else rows).groupBy(*keys).agg(*facts)
        if keys:
            rows = rows.join(steps, list(keys))
        else:
            rows = rows.withColumns({c: F.lit(x) for c, x in steps.first().asDict().items()})
        period = F.lit(1e6 / rates[s.name]) if known else F.col("__step").cast("double")
        gap = (F.col("t") - F.col("__p") > GAP_PERIODS * period) & (F.col("t") < F.col("__last"))
        rows = rows.where("__all >= 2").withColumn("__period", period)
        # Of equal times the one with the gap before it comes first, so all of them are in its run.
        rows = rows.withColumn("__gap", F.coalesce(gap.cast("long"), F.lit(0)))
        rows = ordering.with_running_sum(rows, "t", F.col("__gap"), "__run", keys, tie=[F.desc("__gap")], slicing=slicing)
        rows = write_once(rows.select(*keys, "t", "__raw", "__period", "__run"), "chunk-rows")  # read for ranges and for the result
        meta = rows.groupBy(*keys, "__run").agg(F.min("t").alias("b"), F.max("t").alias("e"), F.count(F.lit(1)).alias("n"), F.first("__period").alias("period"))
        whole_s = F.floor(F.col("n") * F.col("period") / 1e6)
        meta = meta.where("n > 2")
        if shortest is not None:
            meta = meta.where(whole_s >= shortest / 1e6)
        if longest is not None:
            cuts = F.when(whole_s > longest / 1e6, F.sequence(F.lit(0).cast("long"), F.floor((F.col("e") - F.col("b") - 1) / longest))).otherwise(F.array(F.lit(-1).cast("long")))
            meta = meta.select("*", F.explode(cuts).alias("k"))
            sub = F.col("k") >= 0
            lo = F.when(sub, F.greatest(F.col("b"), F.col("b") + F.col("k") * longest - half)).otherwise(F.col("b"))
            hi = F.when(sub, F.least(F.col("e"), F.col("b") + (F.col("k") + 1) * longest + half)).otherwise(F.col("e"))
            meta = meta.select(*keys, "__run", lo.alias("b"), hi.alias("e"))
        meta = meta.select(*keys, F.lit(order).alias("order"), F.lit(s.name).alias("series"), "__run", "b", "e")
        parts.append((s, rows, meta))
    numbered = _matched([m for _, _, m in parts], margin, keys)
    out = None
    for s, rows, _ in parts:
        own = numbered.where(F.col("series") == s.name)
        got = rows.join(own.select(*keys, "__run", "b", "e", "chunk_id"), [*keys, "__run"]).where("t between b and e")
        got = got.select(*keys, "chunk_id", F.lit(s.name).alias("series"), F.timestamp_micros("t").cast(one.kind).alias(one.index), F.col("__raw").alias("value"))
        out = got if out is None else out.unionByName(got)
    return out


def _micros(x) -> int | None:
    return None if x is None else parse_time(x) if isinstance(x, str | pd.Timedelta) else int(x * 1_000_000)


def _matched(tables: list[DataFrame], margin: int, keys: Sequence[str]) -> DataFrame:
    """Number chunk ranges: each joins the first known range within the margin, in the order of series and time.

    ``tables`` has the ranges of one series each.  A series' ranges are joined
    with those known before by their starts, rounded to the margin, and the
    neighbours of that; the ones that match none are new.
    """
    cell, known, done = max(margin, 1), None, []
    order = Window.partitionBy(*keys, "series", "__run", "b", "e").orderBy("other")
    for meta in tables:
        near = meta.withColumn("__at", F.floor(F.col("b") / cell))
        if known is None:
            met = near.withColumn("other", F.lit(None).cast("long"))
        else:
            cells = known.select(*keys, F.col("b").alias("x"), F.col("e").alias("y"), F.col("chunk_id").alias("other"), F.explode(F.array(*[F.floor(F.col("b") / cell) + k for k in (-1, 0, 1)])).alias("__at"))
            pairs = near.join(cells, [*keys, "__at"]).where((F.abs(F.col("x") - F.col("b")) <= margin) & (F.abs(F.col("y") - F.col("e")) <= margin))
            first = pairs.withColumn("__k", F.row_number().over(order)).where("__k = 1").select(*keys, "series", "__run", "b", "e", "other")
            met = near.join(first, [*keys, "series", "__run", "b", "e"], "left")
        met = write_once(met.drop("__at"), "chunk-ranges")
        new = met.where("other is null").drop("other")
        # Ranges of one series grow in both ends, so two that are alike lie next to each other.
        slicing = ordering.Slicing.of(new, "b")
        placed = ordering.with_position(new, "b", "chunk_id", keys, tie=["e"], slicing=slicing)
        placed = ordering.with_previous(placed, "b", {"x": "b", "y": "e"}, keys, tie=["e"], slicing=slicing)
        placed = placed.withColumn("alike", F.coalesce((F.col("b") - F.col("x") <= margin) & (F.abs(F.col("e") - F.col("y")) <= margin), F.lit(False))).drop("x", "y")
        if known is not None and keys:
            ids = known.groupBy(*keys).agg((F.max("chunk_id") + 1).alias("__from"))
            placed = placed.join(ids, list(keys), "left").withColumn("chunk_id", F.col("chunk_id") + F.coalesce("__from", F.lit(0))).drop("__from")
        elif known is not None:
            placed = placed.withColumn("chunk_id", F.col("chunk_id") + F.lit(known.count()))  # numbers so far have no gaps
        placed = write_once(placed, "chunk-new")
        joined = met.where("other is not null").withColumnRenamed("other", "chunk_id")
        twice = not placed.where("alike").isEmpty() or known is not None and not joined.groupBy(*keys, "chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if twice:
            raise ValueError(f"series {met.first()['series']} is twice in one range")
        placed = placed.drop("alike")
        done.append(placed.unionByName(joined.select(*placed.columns)))
        fresh = placed.select(*keys, "b", "e", "chunk_id")
        known = fresh if known is None else known.unionByName(fresh)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
