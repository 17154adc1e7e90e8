"""Feature collections: windows, segments, groups and runs, evaluated as fused aggregations."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import metrics, timeargs
from ..functions import native
from ..model import FeatureDescriptor, Grouped, MultipleFeatureDescriptors, Series, SeriesSet, flatten, index_number, index_value, is_time, name_of
from ..plans import grid, ordering
from ..runtime import ship_package, write_once

#: Samples that a group of consecutive windows holds for Python functions, about (one window at least).
BLOCK_ROWS = 1 << 17
#: Bytes of segments from the driver whose join is broadcast, at most; more are joined as a table.
BROADCAST_BYTES = 16 << 20
#: Copies of a sample in overlapping windows from which on samples are aggregated to panes first, and samples of a pane that make it worth it.
PANE_COPIES, PANE_ROWS = 3, 2


def quoted(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


class FeatureCollection:
    """A registry of feature descriptors keyed by (series, window)."""

    def __init__(self, feature_descriptors=None):
        self._by_key: dict[tuple, list[FeatureDescriptor]] = {}
        self.add(feature_descriptors or [])

    # -- registry ---------------------------------------------------------

    def add(self, features) -> None:
        for f in flatten([features]):
            if isinstance(f, FeatureCollection):
                for d in f.descriptors():
                    self._add(d)
            elif isinstance(f, MultipleFeatureDescriptors):
                for d in f.feature_descriptions:
                    self._add(d)
            elif isinstance(f, FeatureDescriptor):
                self._add(f)
            else:
                raise TypeError(f"cannot add a {type(f).__name__}")
        if len({d.kind for d in self.descriptors()} - {None}) > 1:
            warnings.warn("both time and sample windows are in one collection", RuntimeWarning, stacklevel=2)

    def _add(self, d: FeatureDescriptor) -> None:
        known = self._by_key.setdefault((d.series_name, timeargs.parse(d.window), d.kind), [])
        taken = {o for k in known for o in k.function.output_names}
        if taken & set(d.function.output_names):
            raise AssertionError(f"output names {taken & set(d.function.output_names)} are already used for {d.prefix} and this window")
        known.append(d)

    def descriptors(self) -> list[FeatureDescriptor]:
        return [d for ds in self._by_key.values() for d in ds]

    def get_required_series(self) -> list[str]:
        return list(dict.fromkeys(s for d in self.descriptors() for s in d.series_name))

    def get_nb_output_features(self) -> int:
        return sum(d.get_nb_output_features() for d in self.descriptors())

    def _get_nb_output_features_without_window(self) -> int:
        return len({(d.prefix, o) for d in self.descriptors() for o in d.function.output_names})

    def reduce(self, feat_cols_to_keep: Sequence[str]) -> FeatureCollection:
        """A collection of the descriptors that make any of the columns."""
        manual = [c.endswith("w=manual") for c in feat_cols_to_keep]
        if any(manual) and not all(manual):
            raise AssertionError("either all or no columns are of segments")
        made = {c: d for d in self.descriptors() for c in d.columns("manual" if any(manual) else timeargs.label(d.window))}
        unknown = set(feat_cols_to_keep) - set(made)
        if unknown:
            raise AssertionError(f"no feature makes {sorted(unknown)}")
        keep = {id(made[c]) for c in feat_cols_to_keep}
        return FeatureCollection([d for d in self.descriptors() if id(d) in keep])

    def serialize(self, file_path) -> None:
        with open(file_path, "wb") as f:
            cloudpickle.dump(self, f)

    def __repr__(self) -> str:
        # The layout is a fixed format.
        out = []
        for series in sorted({k[0] for k in self._by_key}):
            out.append("|".join(series) + ": (")
            for (s, _, kind), ds in self._by_key.items():
                if s == series:
                    show = timeargs.short if kind == timeargs.TIME else str
                    win = "None" if ds[0].window is None else timeargs.label(ds[0].window)
                    out.append(f"\n\twin: {win:<6}: [")
                    for d in ds:
                        w = d.function
                        strides = [show(x) for x in d.strides] or None
                        out.append(f"\n\t\tFeatureDescriptor - func: FuncWrapper({w.native or name_of(w.func)}, {list(w.output_names)}, {w.kwargs})    stride: {strides},")
                    out.append("\n\t]")
            out.append("\n)\n")
        return "".join(out)

    # -- calculation ------------------------------------------------------

    def calculate(
        self,
        data,
        stride=None,
        segment_start_idxs=None,
        segment_end_idxs=None,
        return_df: bool = False,
        window_idx: str = "end",
        include_final_window: bool = False,
        group_by_all: str | None = None,
        group_by_consecutive: str | None = None,
        bound_method: str = "inner",
        approve_sparsity: bool = False,
        show_progress: bool = False,
        logging_file_path: str | None = None,
        n_jobs: int | None = None,
        *,
        index: str | None = None,
        keys: Sequence[str] = (),
        segments: DataFrame | None = None,
        checks: bool = True,
        ordered: bool = False,
    ):
        """Feature columns by window, segment, group or run.

        ``index`` names the index column (the first time column otherwise) and
        ``keys`` optional entity columns, which every plan is partitioned by.
        ``segments`` is a table of segments of any size with columns ``start``
        and ``end`` (one of them, if the features have windows) and optionally
        ``segment``, a number that names each.  ``return_df`` gives one wide
        DataFrame, else one per fused group; ``ordered`` sorts them by their
        index.  ``show_progress`` and ``n_jobs`` are accepted and left to Spark.

        Warnings that need the data (gaps unless ``approve_sparsity``, segments
        out of range, rows without a group) cost a job each; ``checks=False``
        leaves them out.  ``logging_file_path`` runs each feature by itself to
        measure it, so it costs as much again.
        """
        if n_jobs is not None and not isinstance(n_jobs, int):
            raise AssertionError("n_jobs must be an integer")
        if group_by_all and group_by_consecutive:
            raise AssertionError("group_by_all and group_by_consecutive exclude each other")
        if logging_file_path:
            rest = {"stride": stride, "segment_start_idxs": segment_start_idxs, "segment_end_idxs": segment_end_idxs, "return_df": True, "window_idx": window_idx, "include_final_window": include_final_window, "group_by_all": group_by_all, "group_by_consecutive": group_by_consecutive, "bound_method": bound_method, "approve_sparsity": True, "index": index, "keys": keys, "segments": segments, "checks": False}
            took = []
            for d in self.descriptors():
                began = time.perf_counter()
                FeatureCollection(d).calculate(data, **rest).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            metrics.log_group(logging_file_path, self.descriptors(), stride, took)
        if isinstance(data, Grouped):
            if group_by_all or group_by_consecutive:
                raise AssertionError("a grouped table cannot be grouped again")
            out = self._grouped(SeriesSet.of(data.df, index, data.by), list(data.by), data.df)
            return out if return_df else [out]
        if window_idx not in ("begin", "middle", "end"):
            raise ValueError(f"window_idx must be begin, middle or end, not {window_idx!r}")
        series = SeriesSet.of(data, index, keys)
        column = group_by_all or group_by_consecutive
        if column:
            self._warn_ignored(stride, segment_start_idxs, segment_end_idxs, window_idx, include_final_window)
            if column in self.get_required_series():
                raise AssertionError("the grouping column is itself a required series")
            self._one_window_each()
            table = self._aligned(series, [*self.get_required_series(), column])
            if checks and not table.where(~_known(table, column)).isEmpty():
                warnings.warn(f"rows without a value in the grouping column {column} are ignored", RuntimeWarning, stacklevel=2)
            out = self._grouped(series, [*keys, column], table) if group_by_all else self._runs(series, table, column, keys)
            return out if return_df else [out]
        starts, ends = segment_start_idxs, segment_end_idxs
        if isinstance(starts, DataFrame) or isinstance(ends, DataFrame):
            if segments is not None or (starts is not None and ends is not None):
                raise TypeError("give starts and ends that are tables as one table of segments")
            one = starts if starts is not None else ends
            segments, starts, ends = one.select(F.col(f"`{one.columns[-1]}`").alias("start" if starts is not None else "end")), None, None
        given = {"start": starts is not None or segments is not None and "start" in segments.columns, "end": ends is not None or segments is not None and "end" in segments.columns}
        if segments is not None and (not any(given.values()) or starts is not None or ends is not None):
            raise ValueError("segments is a table with start, end or both, and goes without other segments")
        if stride is not None and any(given.values()):
            raise ValueError("a stride goes without segments")
        if all(given.values()):
            self._one_window_each()
        elif any(d.window is None for d in self.descriptors()):
            raise AssertionError("every feature needs a window unless both segment starts and ends are given")
        elif not any(given.values()) and stride is None and any(not d.strides for d in self.descriptors()):
            raise AssertionError("no stride and no segments given")
        required = {n: series[n] for n in self.get_required_series()}
        if len({is_time(s.kind) for s in required.values()}) > 1 or len({s.kind.simpleString() for s in required.values() if is_time(s.kind)}) > 1:
            raise AssertionError("all series must have one kind of index")
        first = next(iter(required.values()))
        if not is_time(first.kind) and any(d.kind == timeargs.TIME for d in self.descriptors()):
            raise ValueError("time windows need a time index")
        if any(given.values()):
            table, narrow = _segment_table(first, segments, starts, ends, keys, all(given.values()))
            parts = self._segments(required, table, narrow, all(given.values()), window_idx, keys, checks)
            by = [*keys, "segment", first.index]
        else:
            parts = self._strided(required, stride, window_idx, include_final_window, bound_method, checks and not approve_sparsity, keys)
            by = [*keys, first.index]
        sort = lambda df: df.orderBy(*quoted(by)) if ordered else df
        return sort(merge(parts, by)) if return_df else [sort(p) for p in parts]

    def _warn_ignored(self, stride, starts, ends, window_idx, final) -> None:
        for name, given in (("stride", stride is not None), ("segment_start_idxs", starts is not None), ("segment_end_idxs", ends is not None), ("window_idx", window_idx != "end"), ("include_final_window", final)):
            if given:
                warnings.warn(f"{name} is ignored when grouping", UserWarning, stacklevel=3)

    def _one_window_each(self) -> None:
        seen: dict[tuple, object] = {}
        for d in self.descriptors():
            for o in d.function.output_names:
                if seen.setdefault((d.series_name, o), d.window) != d.window:
                    raise AssertionError(f"{d.prefix}__{o} has several windows")

    def _fused(self, stride) -> dict[tuple, list[FeatureDescriptor]]:
        """Descriptors that share series, window and strides, split into native ones and Python ones."""
        override = sorted({timeargs.parse(s) for s in flatten([stride])}) if stride is not None else None
        out: dict[tuple, list[FeatureDescriptor]] = {}
        for d in self.descriptors():
            out.setdefault((d.series_name, d.window, tuple(override or d.strides), d.function.native is not None), []).append(d)
        return out

    # -- strided windows --------------------------------------------------

    def _strided(self, required, stride, window_idx, final, bound_method, check, keys) -> list[DataFrame]:
        first = next(iter(required.values()))
        by_position = is_time(first.kind) and any(d.kind == timeargs.SEQUENCE for d in self.descriptors())
        bounds = bounds_of(required, bound_method, keys)
        places = None
        if by_position:
            required, places = _positions(required, bounds, keys)
            bounds = bounds_of(required, "inner", keys)
        parts, sparse = [], []
        spark = first.df.sparkSession
        for (names, window, strides, _), ds in self._fused(stride).items():
            w, label = timeargs.parse(window), timeargs.label(window)
            if by_position and (not isinstance(w, int) or not all(isinstance(s, int) for s in strides)):
                raise TypeError("sample windows and strides are integers")
            if keys:
                windows = grid.keyed_grid(bounds.table, keys, w, strides, final)
            else:
                windows = grid.grid(spark, bounds.low, bounds.high, w, strides, final) if bounds.low is not None else spark.range(0).select(F.col("id").alias("s"))
            windows = windows.withColumn("e", F.col("s") + F.lit(w))
            placing = Strides(required, keys, bounds, w, strides, final)
            if check:
                sparse += [windows.join(_count(placing, n, [*keys, "s"]), [*keys, "s"], "left").agg(F.lit(n).alias("name"), (F.max(F.coalesce("n", F.lit(0))) - F.min(F.coalesce("n", F.lit(0)))).alias("gap")) for n in dict.fromkeys(names)]
            got = self._evaluate(ds, names, placing, windows, [*keys, "s"], label, is_time(first.kind) and not by_position)
            got = got.withColumn("__idx", grid.output_index(F.col("s"), F.col("e"), window_idx))
            if by_position:
                # A position past the last sample has no index: null.
                got = got.withColumn("__place", F.floor("__idx").cast("long")).drop("__idx").join(places, [*keys, "__place"], "left").withColumnRenamed("__when", "__idx")
            cols = [c for d in ds for c in d.columns(label)]
            parts.append(got.select(*keys, index_value(F.col("__idx"), first.kind).alias(first.index), *quoted(cols)))
        if sparse:
            for name in sorted({r["name"] for r in fold(DataFrame.unionAll, sparse).collect() if r["gap"]}):
                warnings.warn(f"there are gaps in the sequence of the series {name}", RuntimeWarning, stacklevel=3)
        return parts

    # -- evaluation -------------------------------------------------------

    def _evaluate(self, ds, names, placing, windows, by, label, time_index) -> DataFrame:
        """Left join of ``windows`` with the fused aggregates of the samples that ``placing`` gives them."""
        if not ds[0].function.native:
            return self._evaluate_python(ds, names, placing, windows, by, label, time_index)
        groups: dict[tuple, list[FeatureDescriptor]] = {}
        for d in ds:
            f = d.function
            kind = "apart" if f.native in native.APART else "one" if len(names) == 1 else "paired"
            # What a robust function masks is not there to be paired.
            groups.setdefault((kind, kind == "paired" and not f.kwargs.get("passthrough_nans", True)), []).append(d)
        out = windows
        for (kind, masked), own in groups.items():
            if kind == "one" and placing.panes() and all(native.has_parts(d.function.native, d.function.kwargs) for d in own):
                table = self._from_panes(own, names[0], placing, by, label, time_index)
            elif kind == "apart":
                table = self._apart(own, names, placing, by, label)
            else:
                table = self._whole(own, names, placing, by, label, time_index, masked)
            out = out.join(table, by, "left")
            empties = [x for d in own for x in zip(d.columns(label), native.empty_values(d.function.native, d.function.kwargs, len(d.columns(label))), strict=True)]
            out = out.withColumns({c: F.when(F.col("__n").isNull(), F.lit(e)).otherwise(F.col(f"`{c}`")) for c, e in empties}).drop("__n")
        return out

    @staticmethod
    def _whole(ds, names, placing, by, label, time_index, masked) -> DataFrame:
        """Aggregates over the samples themselves; those of several series are paired by position in the window."""
        if len(names) == 1:
            samples, values = placing.samples(names[0]), [F.col("v")]
        else:
            samples, values = placing.paired(names, by, masked), [F.col(f"v{i}") for i in range(len(names))]
        aggs = []
        for d in ds:
            cols = d.columns(label)
            built = native.build(d.function.native, values, F.col("t"), native.PROPAGATE, time_index, d.function.kwargs)
            if len(built) != len(cols):
                raise AssertionError(f"{d.function.native} has {len(built)} outputs, not {len(cols)}")
            aggs += [x.alias(c) for x, c in zip(built, cols, strict=True)]
        return samples.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("__n"))

    @staticmethod
    def _apart(ds, names, placing, by, label) -> DataFrame:
        """Each series aggregated by itself; the tables of windows are put together."""
        sides = []
        for i, n in enumerate(names):
            v, aggs = F.col("v"), []
            for k, d in enumerate(ds):
                masked = v if d.function.kwargs.get("passthrough_nans", True) else F.when(~F.isnan(native.number(v)), v)
                aggs += [native.APART[d.function.native][1](masked).alias(f"__{k}_{i}"), F.count(masked).alias(f"__n{k}_{i}")]
            sides.append(placing.samples(n).groupBy(*by).agg(*aggs))
        table = fold(lambda a, b: a.join(b, by, "full"), sides)
        cols = []
        for k, d in enumerate(ds):
            got = native.APART[d.function.native][2]([F.col(f"__{k}_{i}") for i in range(len(names))])
            least, error = d.function.kwargs.get("min_nb_samples", 0), d.function.kwargs.get("error_val", native.NAN)
            enough = fold(lambda a, b: a & b, [F.coalesce(f"__n{k}_{i}", F.lit(0)) >= least for i in range(len(names))])
            cols += [F.when(enough, x).otherwise(F.lit(error)).alias(c) if least else x.alias(c) for x, c in zip(got, d.columns(label), strict=True)]
        return table.select(*by, *cols, F.lit(1).alias("__n"))

    @staticmethod
    def _from_panes(ds, name, placing, by, label, time_index) -> DataFrame:
        """Samples are aggregated to panes once, and windows from their panes."""
        needed = list(dict.fromkeys(["rows", *(p for d in ds for p in native.parts_of(d.function.native, d.function.kwargs))]))
        panes = placing.pane_table(name, [native.PARTS[p][0](F.col("v"), F.col("t")).alias(f"__{p}") for p in needed])
        merged = panes.groupBy(*by).agg(*[native.PARTS[p][1](f"__{p}").alias(f"__{p}") for p in needed])
        m = {p: F.col(f"__{p}") for p in needed}
        return merged.select(*by, *[native.from_parts(d.function.native, m, time_index, d.function.kwargs).alias(d.columns(label)[0]) for d in ds], F.col("__rows").alias("__n"))

    def _evaluate_python(self, ds, names, placing, windows, by, label, time_index) -> DataFrame:
        ship_package(windows.sparkSession)
        placed = {n: placing.samples(n) for n in dict.fromkeys(names)}
        if any(d.function.vectorized for d in ds):
            placing.check_equal(windows, list(placed), by)
        kinds = {n: placed[n].schema["v"].dataType for n in placed}
        blank = lambda n: F.lit(None).cast(kinds[n])
        rows = [windows.select(*by, F.lit(-1).alias("__which"), F.lit(None).cast(placed[names[0]].schema["t"].dataType).alias("t"), *[blank(n).alias(f"v{i}") for i, n in enumerate(placed)])]
        for j, n in enumerate(placed):
            rows.append(placed[n].select(*by, F.lit(j).alias("__which"), "t", *[F.col("v").alias(f"v{i}") if i == j else blank(m).alias(f"v{i}") for i, m in enumerate(placed)]))
        table = placing.with_block(fold(DataFrame.unionAll, rows))
        order, outputs = {n: j for j, n in enumerate(placed)}, [c for d in ds for c in d.columns(label)]
        schema = T.StructType([*[windows.schema[b] for b in by], *[T.StructField(c, T.DoubleType()) for c in outputs]])
        outer, inner = by[:-1], by[-1]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([inner, "t"], kind="stable")
            keys_, inputs = [], []
            for key, win in pdf.groupby(inner, sort=True):
                keys_.append((*(win[o].iloc[0] for o in outer), key))
                inputs.append([_as_input(win[win["__which"] == order[n]], order[n]) for n in names])
            cols: list = []
            for d in ds:
                cols += _call(d.function, inputs, names, time_index)
            out = pd.DataFrame(keys_, columns=by)
            return out.assign(**dict(zip(outputs, cols, strict=True)))[[*by, *outputs]]

        got = table.groupBy(*outer, "__block").applyInPandas(run, schema)
        return windows.join(got, by, "left")

    # -- segments ---------------------------------------------------------

    def _segments(self, required, table, narrow, manual, window_idx, keys, check) -> list[DataFrame]:
        first = next(iter(required.values()))
        if check:
            bounds = bounds_of(required, "outer", ())
            outside = [(F.col(c) < F.lit(bounds.low)) | (F.col(c) > F.lit(bounds.high)) for c in ("s", "e") if c in table.columns]
            if bounds.low is not None and not table.where(fold(lambda a, b: a | b, outside)).isEmpty():
                warnings.warn("some segments lie outside of the bounds of the data", RuntimeWarning, stacklevel=3)
        parts = []
        by = [*keys, "segment"]
        for (names, window, _, _), ds in self._fused(None).items():
            w, label = (None, "manual") if manual else (timeargs.parse(window), timeargs.label(window))
            own = table if manual else table.withColumn("e", F.col("s") + F.lit(w)) if "s" in table.columns else table.withColumn("s", F.col("e") - F.lit(w))
            placing = Cuts(required, keys, own, narrow)
            if keys and not set(keys) <= set(own.columns):
                # Segments for all entities: the result has a row for each of both.
                own = first.df.select(*keys).distinct().crossJoin(own)
            got = self._evaluate(ds, names, placing, own, by, label, is_time(first.kind))
            cols = [c for d in ds for c in d.columns(label)]
            idx = grid.output_index(F.col("s"), F.col("e"), window_idx)
            parts.append(got.select(*by, index_value(idx, first.kind).alias(first.index), *quoted(cols)))
        return parts

    # -- groups -----------------------------------------------------------

    @staticmethod
    def _aligned(series: SeriesSet, names: Sequence[str]) -> DataFrame:
        """The named series as columns of one table, aligned on the index."""
        chosen = [series[n] for n in dict.fromkeys(names)]
        one = chosen[0]
        if all(s.df is one.df and s.index == one.index for s in chosen):
            return one.df.select(*one.keys, one.index, *[F.col(s.value).alias(s.name) for s in chosen])
        return outer_merge(chosen)

    def _grouped(self, series: SeriesSet, by: list[str], table: DataFrame) -> DataFrame:
        """One row per value of the group columns; NaN is skipped as in labelled series."""
        for c in by:
            table = table.where(_known(table, c))
        one = series[self.get_required_series()[0]]
        t = index_number(table, one.index) if one.index in table.columns else F.lit(0)
        aggs, python = [], []
        for d in self.descriptors():
            if not d.function.native:
                python.append(d)
                continue
            values = [F.col(f"`{n}`") for n in d.series_name]
            if d.function.native in native.APART:
                _, part, combine, _ = native.APART[d.function.native]
                built = combine([part(native.kept(v, native.SKIP)) for v in values])
            else:
                built = native.build(d.function.native, values, t, native.SKIP, is_time(one.kind), d.function.kwargs)
            if d.function.native == "len" and not all(s.df is one.df for s in series.values()):
                built = [F.count(values[0])]
            aggs += [x.alias(c) for x, c in zip(built, d.columns("manual"), strict=True)]
        out = table.groupBy(*by).agg(*aggs) if aggs else table.select(*by).distinct()
        if python:
            ship_package(table.sparkSession)
            outputs = [c for d in python for c in d.columns("manual")]
            schema = T.StructType([*[table.schema[b] for b in by], *[T.StructField(c, T.DoubleType()) for c in outputs]])

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                cols: list = []
                for d in python:
                    got = d.function.func(*[pdf[n].dropna() for n in d.series_name], **d.function.kwargs)
                    cols += list(got) if isinstance(got, tuple | list) else [got]
                return pd.DataFrame([[*pdf[by].iloc[0], *cols]], columns=[*by, *outputs])

            out = out.join(table.groupBy(*by).applyInPandas(run, schema), by)
        return out

    def _runs(self, series: SeriesSet, table: DataFrame, column: str, keys) -> DataFrame:
        """One row per run of equal values; rows between two runs' starts belong to the first of them, rows of one index to one run."""
        if column in ("start", "end"):
            raise AssertionError("the group column may not be named start or end")
        one = series[self.get_required_series()[0]]
        rows = table.withColumn("__t", index_number(table, one.index))
        slicing = ordering.Slicing.of(rows, "__t")
        marks = ordering.with_previous(rows.where(_known(table, column)).select(*keys, "__t", F.col(column).alias("__value")), "__t", {"__before": "__value"}, keys, tie=["__value"], slicing=slicing)
        starts = marks.select(*keys, "__t", (~F.col("__value").eqNullSafe(F.col("__before"))).cast("long").alias("__new"))
        # All rows take the run that began last: those without a value, too.
        times = rows.select(*keys, "__t", F.lit(0).cast("long").alias("__new")).unionByName(starts).groupBy(*keys, "__t").agg(F.max("__new").alias("__new"))
        runs = ordering.with_running_sum(times, "__t", F.col("__new"), "__run", keys, slicing=slicing).where("__run > 0").select(*keys, "__t", "__run")
        every = rows.join(runs, [*keys, "__t"])
        ends = every.where(_known(table, column)).groupBy(*keys, "__run").agg(F.min("__t").alias("__s"), F.max("__t").alias("__e"), F.min(f"`{column}`").alias(column))
        by, python, got = [*keys, "__run"], [d for d in self.descriptors() if not d.function.native], ends
        if len(python) < len(self.descriptors()):
            aggs = []
            for d in self.descriptors():
                if d.function.native:
                    values = [F.col(f"`{n}`") for n in d.series_name]
                    if d.function.native in native.APART:
                        built = native.APART[d.function.native][2]([native.APART[d.function.native][1](v) for v in values])
                    else:
                        built = native.build(d.function.native, values, F.col("__t"), native.PROPAGATE, is_time(one.kind), d.function.kwargs)
                    aggs += [x.alias(c) for x, c in zip(built, d.columns("manual"), strict=True)]
            got = got.join(every.groupBy(*by).agg(*aggs), by)
        if python:
            if any(d.function.vectorized for d in python):
                raise AssertionError("runs differ in length, so a vectorized function cannot take them")
            placing = Runs(every, series, by, slicing)
            tables: dict[tuple, list[FeatureDescriptor]] = {}
            for d in python:
                tables.setdefault(d.series_name, []).append(d)
            for names, ds in tables.items():
                part = self._evaluate_python(ds, names, placing, ends.select(*by), by, "manual", is_time(one.kind))
                got = got.join(part, by)
        cols = [c for d in self.descriptors() for c in d.columns("manual")]
        return got.select(*keys, *quoted(cols), column, index_value(F.col("__s"), one.kind).alias("__start"), index_value(F.col("__e"), one.kind).alias("__end"))


# -- samples and their windows ------------------------------------------------


@dataclass
class Bounds:
    """Common bounds: low, high and the samples of each series, or a table of t0 and t1 by key."""

    low: object = None
    high: object = None
    counts: dict | None = None
    table: DataFrame | None = None


def blocked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with a number, in __block, of consecutive windows that hold about ``BLOCK_ROWS`` rows; the sizes are counted."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    summed = ordering.with_running_sum(sizes, by[-1], F.col("__size"), "__sum", by[:-1])
    return rows.join(summed.select(*by, F.floor((F.col("__sum") - 1) / BLOCK_ROWS).alias("__block")), by)


class Placing:
    """How the samples of series come to windows: rows of keys, window, t and v."""

    def __init__(self, required: dict[str, Series], keys: Sequence[str]):
        self.required, self.keys = required, list(keys)

    def place(self, samples: DataFrame) -> DataFrame:
        """Samples with columns keys and t, once for each of their windows."""
        raise NotImplementedError

    def panes(self) -> bool:
        return False

    def samples(self, name: str) -> DataFrame:
        return self.place(self.required[name].numbered())

    def paired(self, names: Sequence[str], by: list[str], masked: bool) -> DataFrame:
        """t, v0, v1 and so on: values of the series at the same position in the window, as far as all of them go.

        Columns of one table have the same positions in the same rows.  Samples
        of one index count in the order of their values.
        """
        many = [self.required[n] for n in names]
        one = many[0]
        if not masked and all(s.df is one.df and s.index == one.index for s in many):
            return self.place(one.df.select(*one.keys, index_number(one.df, one.index).alias("t"), *[F.col(f"`{s.value}`").alias(f"v{i}") for i, s in enumerate(many)]))
        sides = []
        for i, s in enumerate(many):
            rows = s.numbered()
            rows = self.place(rows.where(~F.isnan(native.number(F.col("v")))) if masked else rows)
            place = F.row_number().over(Window.partitionBy(*by).orderBy("t", "v"))
            sides.append(rows.select(*by, place.alias("__place"), *(["t"] if i == 0 else []), F.col("v").alias(f"v{i}")))
        return fold(lambda a, b: a.join(b, [*by, "__place"]), sides)

    def with_block(self, rows: DataFrame) -> DataFrame:
        """Rows with the number of their group of windows, in __block."""
        raise NotImplementedError

    def check_equal(self, windows: DataFrame, names: list[str], by: list[str]) -> None:
        """Windows of vectorized functions hold equal numbers of samples, and their first samples lie at equal steps."""
        for n in names:
            samples = self.required[n].numbered()
            slicing = ordering.Slicing.of(samples, "t")
            placed = self.place(ordering.with_position(samples, "t", "__place", self.keys, slicing=slicing).select(*self.keys, "t", F.col("__place").alias("v")))
            each = windows.join(placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first")), by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), "first")
            steps = ordering.with_previous(each, by[-1], {"before": "first"}, self.keys).withColumn("step", F.col("first") - F.col("before"))
            sizes = steps.agg(F.min("n"), F.max("n"), F.min("step"), F.max("step")).first()
            if sizes[0] != sizes[1] or sizes[2] != sizes[3]:
                raise AssertionError("a vectorized function needs windows of equal size and step")


class Strides(Placing):
    """Windows of a grid."""

    def __init__(self, required, keys, bounds: Bounds, window, strides, final: bool):
        super().__init__(required, keys)
        self.bounds, self.window, self.strides, self.final = bounds, window, strides, final
        self.t0, self.t1 = (F.col("t0"), F.col("t1")) if keys else (F.lit(bounds.low), F.lit(bounds.high))
        self.copies = sum(window / s for s in strides)

    def bounded(self, samples: DataFrame) -> DataFrame:
        if self.keys:
            return samples.join(self.bounds.table, self.keys).where(F.col("t").between(F.col("t0"), F.col("t1")))
        return samples.limit(0) if self.bounds.low is None else samples.where(F.col("t").between(self.t0, self.t1))

    def starts(self, t: Column) -> Column:
        return F.explode(grid.starts_of(t, self.t0, self.t1, self.window, self.strides, self.final)).alias("s")

    def place(self, samples: DataFrame) -> DataFrame:
        rows = self.bounded(samples)
        return rows.select(*self.keys, self.starts(F.col("t")), *[c for c in samples.columns if c not in self.keys])

    def panes(self) -> bool:
        """Whether windows are unions of whole panes that save copies."""
        if not all(isinstance(x, int) for x in (self.window, *self.strides)) or self.copies < PANE_COPIES or self.bounds.low is None and not self.keys:
            return False
        if self.keys:
            return True
        span = max(self.bounds.high - self.bounds.low, 1)
        return isinstance(span, int) and min(self.bounds.counts.values()) * self.pane_size() >= PANE_ROWS * span

    def pane_size(self) -> int:
        return math.gcd(self.window, *self.strides)

    def pane_table(self, name: str, aggs: list[Column]) -> DataFrame:
        """Aggregates of panes, once for each window that they are part of."""
        size, rows = F.lit(self.pane_size()), self.bounded(self.required[name].numbered())
        pane = (F.col("t") - self.t0).cast("long")
        ends = ["t0", "t1"] if self.keys else []
        made = rows.withColumn("pane", F.floor(pane / size)).groupBy(*self.keys, *ends, "pane").agg(*aggs)
        begin = self.t0 + F.col("pane") * size
        return made.withColumn("__from", begin).select(*self.keys, self.starts(F.col("__from")), *[F.col(c) for c in made.columns if c not in (*self.keys, *ends, "pane")])

    def with_block(self, rows: DataFrame) -> DataFrame:
        if self.keys:
            return blocked(rows, [*self.keys, "s"])
        span = max(float((self.bounds.high or 0) - (self.bounds.low or 0)), 1e-9)
        density = sum(self.bounds.counts.values()) * max(self.copies, 1.0) / span  # rows for each unit of the index
        return rows.withColumn("__block", F.floor((F.col("s") - F.lit(self.bounds.low)) * F.lit(density / BLOCK_ROWS)))


class Cuts(Placing):
    """Segments from a table with columns segment, s and e."""

    def __init__(self, required, keys, table: DataFrame, narrow: bool):
        super().__init__(required, keys)
        self.narrow, self.number = narrow, table.schema["s"].dataType
        self.own = [*keys] if set(keys) <= set(table.columns) else []
        width, self.number_of = table.agg(F.avg(F.col("e") - F.col("s")), F.count(F.lit(1))).first()
        self.width = max(float(width or 0), 1.0 if isinstance(self.number, T.IntegralType) else 1e-9)
        # A segment of average width lies in two buckets at most, so there are about twice as many rows as segments.
        cells = F.sequence(F.floor(F.col("s") / self.width).cast("long"), F.floor(F.col("e") / self.width).cast("long"))
        self.cells = table.where("s < e").select(*self.own, "segment", "s", "e", F.explode(cells).alias("bucket"))

    def place(self, samples: DataFrame) -> DataFrame:
        rows = samples.withColumn("bucket", F.floor(F.col("t") / self.width).cast("long"))
        met = rows.join(F.broadcast(self.cells) if self.narrow else self.cells, [*self.own, "bucket"])
        return met.where((F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))).select(*samples.columns, "segment")

    def with_block(self, rows: DataFrame) -> DataFrame:
        return blocked(rows, [*self.keys, "segment"])


class Runs(Placing):
    """Rows of an aligned table that know their run; a series has no sample where it is null."""

    def __init__(self, table: DataFrame, series: SeriesSet, by: list[str], slicing: ordering.Slicing):
        super().__init__({}, by[:-1])
        self.table, self.by = table, by

    def samples(self, name: str) -> DataFrame:
        return self.table.where(F.col(f"`{name}`").isNotNull()).select(*self.by, F.col("__t").alias("t"), F.col(f"`{name}`").alias("v"))

    def with_block(self, rows: DataFrame) -> DataFrame:
        return blocked(rows, self.by)


def _count(placing: Strides, name: str, by: list[str]) -> DataFrame:
    """Samples of each window that has any."""
    if placing.panes():
        return placing.pane_table(name, [F.count(F.lit(1)).alias("__rows")]).groupBy(*by).agg(F.sum("__rows").alias("n"))
    return placing.samples(name).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _known(table: DataFrame, column: str) -> Column:
    """Whether a group column has a value."""
    known = F.col(f"`{column}`").isNotNull()
    return known & ~F.isnan(f"`{column}`") if isinstance(table.schema[column].dataType, T.FloatType | T.DoubleType) else known


def _as_input(rows: pd.DataFrame, which: int) -> pd.Series:
    return pd.Series(rows[f"v{which}"].to_numpy(), index=rows["t"].to_numpy())


def _call(wrapper, inputs: list[list[pd.Series]], names, time_index: bool) -> list:
    """Output columns of one function for a block of windows."""
    n_out, kwargs = len(wrapper.output_names), wrapper.kwargs

    def arg(s: pd.Series, name: str):
        a = s.to_numpy().copy()
        a.flags.writeable = False  # a function may not change what others see
        if wrapper.input_type is pd.Series:
            index = pd.to_datetime(s.index, unit="us") if time_index else s.index
            return pd.Series(a, index=index, name=name, copy=False)
        return (s.index.to_numpy(), a) if wrapper.input_type is tuple else a

    if wrapper.vectorized:
        stacks = []
        for j in range(len(names)):
            sizes = {len(w[j]) for w in inputs}
            if len(sizes) > 1:
                raise AssertionError("a vectorized function needs windows of equal size")
            stacks.append(np.stack([w[j].to_numpy() for w in inputs]))
            stacks[-1].flags.writeable = False
        got = wrapper.func(*stacks, **kwargs)
        return list(got) if isinstance(got, tuple | list) else [got]
    rows = []
    for w in inputs:
        got = wrapper.func(*[arg(s, n) for s, n in zip(w, names, strict=True)], **kwargs)
        got = list(got) if isinstance(got, tuple | list | np.ndarray) and np.ndim(got) else [got]
        if len(got) != n_out:
            raise AssertionError(f"expected {n_out} outputs, got {len(got)}")
        rows.append([float(x) if x is not None else np.nan for x in got])
    return list(map(list, zip(*rows, strict=True)))


def bounds_of(required: dict[str, Series], method: str, keys) -> Bounds:
    """Common bounds of the series; series of one table and index are read once."""
    pick = {"inner": (max, min), "inner-outer": (max, max), "outer": (min, max)}.get(method)
    if pick is None:
        raise ValueError(f"bound_method must be inner, inner-outer or outer, not {method!r}")
    sources = {(id(s.df), s.index): s for s in required.values()}
    ends = [s.numbered().groupBy(*keys).agg(F.lit(i).alias("source"), F.min("t").alias("low"), F.max("t").alias("high"), F.count("t").alias("n")) for i, s in enumerate(sources.values())]
    both = fold(DataFrame.unionByName, ends)
    if keys:
        t0, t1 = ({max: F.max, min: F.min}[p](c) for p, c in zip(pick, ("low", "high"), strict=True))
        return Bounds(table=both.groupBy(*keys).agg(t0.alias("t0"), t1.alias("t1")))
    rows = {r["source"]: r for r in both.collect()}
    counts = {n: rows[list(sources).index((id(s.df), s.index))]["n"] for n, s in required.items()}
    if any(r["low"] is None for r in rows.values()):
        return Bounds(counts=counts)
    return Bounds(pick[0](r["low"] for r in rows.values()), pick[1](r["high"] for r in rows.values()), counts)


def _positions(required, bounds, keys):
    """Series indexed by sample position within the bounds, and the first one's index at each position."""
    out, places = {}, None
    inside = Strides(required, keys, bounds, 1, (1,), False)
    for name, s in required.items():
        df = inside.bounded(s.numbered()).select(*keys, "t", "v")
        at = ordering.with_position(df, "t", "place", keys)
        out[name] = Series(name, at.select(*keys, "place", F.col("v").alias(name)), "place", name, tuple(keys))
        if places is None:
            places = at.select(*keys, F.col("place").alias("__place"), F.col("t").alias("__when"))
    return out, places


def _segment_values(values, one: Series) -> list | None:
    """Segment ends from a list, array or pandas object, as index numbers."""
    if values is None:
        return None
    values = np.asarray(values.squeeze() if isinstance(values, pd.DataFrame) else values).reshape(-1)
    if is_time(one.kind):
        return [pd.Timestamp(v).value // 1000 for v in values]
    return [v.item() if hasattr(v, "item") else v for v in values]


def _segment_table(one: Series, segments: DataFrame | None, starts, ends, keys, manual: bool) -> tuple[DataFrame, bool]:
    """segment, s and e (those that are given; keys, too, if the table has them) as index numbers, and whether that is small enough to broadcast."""
    if segments is not None:
        cols = {c: a for c, a in (("start", "s"), ("end", "e")) if c in segments.columns}
        for c in cols:
            if is_time(one.kind) != is_time(segments.schema[c].dataType):
                raise AssertionError("segments and series must have one kind of index")
        own = [k for k in keys if k in segments.columns]
        number = F.col("segment") if "segment" in segments.columns else F.monotonically_increasing_id().alias("segment")
        table = segments.select(*own, number, *[index_number(segments, c).alias(a) for c, a in cols.items()])
        table = write_once(table.where(F.col(list(cols.values())[0]).isNotNull()), "segments")
        if manual and not table.where("s > e or e is null").isEmpty():
            raise AssertionError("each segment must start at or before its end")
        return table, False
    starts, ends = _segment_values(starts, one), _segment_values(ends, one)
    if manual and (len(starts) != len(ends) or any(a > b for a, b in zip(starts, ends, strict=True))):
        raise AssertionError("segment starts and ends must be as many, each start at or before its end")
    given = {a: x for a, x in (("s", starts), ("e", ends)) if x is not None}
    number = "double" if any(isinstance(x, float) for v in given.values() for x in v) else "long"
    rows = [tuple(float(x) if number == "double" else x for x in v) for v in zip(*given.values(), strict=True)]
    spark = one.df.sparkSession
    table = spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], ", ".join(["segment long", *(f"{a} {number}" for a in given)]))
    return table, 64 * len(rows) <= BROADCAST_BYTES


def merge(parts: list[DataFrame], by: Sequence[str]) -> DataFrame:
    """Outer merge of feature tables on ``by``: one union and one aggregation, columns sorted."""
    if len(parts) == 1:
        out = parts[0]
    else:
        out = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        cols = [c for c in out.columns if c not in by]
        out = out.groupBy(*by).agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in cols])
    return out.select(*by, *quoted(sorted(c for c in out.columns if c not in by)))


def join_on_index(features: DataFrame, other: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Features with the columns of another table (labels, a target) at the same index; ``how`` is inner or left."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    clash = (set(features.columns) & set(other.columns)) - set(by)
    if clash:
        raise AssertionError(f"columns {sorted(clash)} are in both tables")
    return features.join(other, list(by), how)


def concat_rows(tables: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The rows of all tables, columns by name; with ``by`` only one row of each index, from the first table that has it."""
    out = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)])
    if not by:
        return out.drop("__table")
    rest = [c for c in out.columns if c not in (*by, "__table")]
    kept = out.groupBy(*by).agg(F.min_by(F.struct(*quoted(rest)), "__table").alias("__row")) if rest else out.select(*by).distinct()
    return kept.select(*by, *[F.col("__row")[c].alias(c) for c in rest])


def outer_merge(series: Sequence[Series]) -> DataFrame:
    """Full outer merge of series on their index, as a join: where several rows of two tables have one index, all pairs of them.

    Series of one table, or made of its rows, go together row by row.
    """
    one = series[0]
    return merge_rows(series)[0].select(*one.keys, one.index, *quoted(s.name for s in series))


def merge_rows(series: Sequence[Series]) -> tuple[DataFrame, Series]:
    """The outer merge, and the first series in it; that has numbers of rows if all are made of one table's."""
    one, sides = series[0], {}
    for s in series:
        sides.setdefault(id(s.source) if s.row else (id(s.df), s.index), []).append(s)
    tables = [_rows_together(own, one) for own in sides.values()]
    if len(tables) == 1:
        return tables[0], replace(one, df=tables[0], value=one.name)
    # Each side's rows of an index are gathered, then each row of one side meets each of the others.
    packed = [F.struct(*quoted(s.name for s in own)).alias(f"__side{i}") for i, own in enumerate(sides.values())]
    kinds = [t.select(p).schema[0].dataType for t, p in zip(tables, packed, strict=True)]
    alone = lambda i: F.when(F.col(f"`{one.index}`").isNull(), F.lit(i)).alias("__alone")  # noqa: E731  no index equals none
    wide = [t.select(*one.keys, one.index, alone(i), *[packed[j] if i == j else F.lit(None).cast(kinds[j]).alias(f"__side{j}") for j in range(len(tables))]) for i, t in enumerate(tables)]
    names = [f"__side{i}" for i in range(len(tables))]
    out = fold(DataFrame.unionByName, wide).groupBy(*one.keys, one.index, "__alone").agg(*[F.collect_list(n).alias(n) for n in names])
    for n in names:
        out = out.withColumn(n, F.explode_outer(n))
    values = [F.col(f"__side{i}")[s.name].alias(s.name) for i, own in enumerate(sides.values()) for s in own]
    out = out.select(*one.keys, one.index, *values)
    return out, replace(one, df=out, value=one.name, row=None, source=None)


def _rows_together(own: Sequence[Series], one: Series) -> DataFrame:
    """Series of one table as columns named by them; those that have lost rows are null there."""
    first = own[0]
    ids = lambda s: [*one.keys, F.col(f"`{s.index}`").alias(one.index), *([s.row] if s.row else [])]
    if all(s.df is first.df and s.index == first.index for s in own):
        return first.df.select(*ids(first), *[F.col(f"`{s.value}`").alias(s.name) for s in own])
    kinds = {s.name: T.StructType([T.StructField("v", s.df.schema[s.value].dataType)]) for s in own}
    wide = [s.df.select(*ids(s), *[(F.struct(F.col(f"`{s.value}`").alias("v")) if s is o else F.lit(None)).cast(kinds[o.name]).alias(o.name) for o in own]) for s in own]
    by = [*one.keys, one.index, first.row]
    rows = fold(DataFrame.unionByName, wide).groupBy(*by).agg(*[F.first(F.col(f"`{s.name}`"), ignorenulls=True).alias(s.name) for s in own])
    return rows.select(*by, *[F.col(f"`{s.name}`")["v"].alias(s.name) for s in own])
