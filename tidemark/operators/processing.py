"""Series processing: steps over a set of series.

A step's function gets Columns (``elementwise``), Series handles (``on_series``)
or, for anything else, one pandas Series per input for each entity
(``SeriesProcessor`` with a plain callable), which then runs as grouped pandas.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import metrics
from ..model import Series, SeriesSet, index_number, is_time, name_of, to_tuple, with_rows
from ..plans import ordering
from ..runtime import fresh_name, ship_package, write_once
from .collection import merge_rows, outer_merge


#: Rows that a pandas step hands back at once.
OUT_ROWS = 1 << 17


class ProcessingError(Exception):
    """A step failed; the message names it."""


def elementwise(func: Callable[..., Column]) -> Callable:
    """Mark a function of Columns to a Column (one value per row)."""
    func.tidemark_kind = "column"
    return func


def on_series(func: Callable[..., object]) -> Callable:
    """Mark a function of Series handles to a Series or a list of them."""
    func.tidemark_kind = "series"
    return func


def dataframe_func(func: Callable[[DataFrame], DataFrame]) -> Callable:
    """A function of one DataFrame, the outer merge of the inputs on the index; its value columns are the outputs."""

    @functools.wraps(func)
    def run(*series: Series, **kwargs) -> list[Series]:
        out = func(outer_merge(series), **kwargs)
        one = series[0]
        return [Series(c, out, one.index, c, one.keys) for c in out.columns if c != one.index and c not in one.keys]

    return on_series(run)


class SeriesProcessor:
    """A function applied to each tuple of series names.

    A plain callable gets pandas Series.  The names it gives its outputs decide
    what is replaced or added; they show when it runs, so it runs at once and
    its output is written, unless ``output_names`` declares them.
    """

    def __init__(self, function: Callable, series_names, **kwargs):
        names = series_names if isinstance(series_names, list) else [series_names]
        self.function, self.kwargs = function, kwargs
        self.series_names = [to_tuple(n) for n in names]
        if len({len(n) for n in self.series_names}) > 1:
            raise AssertionError("all tuples of series names must have one length")
        self.name = name_of(function)

    def get_required_series(self) -> list[str]:
        return list(dict.fromkeys(n for names in self.series_names for n in names))

    def __call__(self, series: SeriesSet) -> dict[str, Series]:
        out: dict[str, Series] = {}
        for names in self.series_names:
            made = self._apply([series[n] for n in names])
            if set(made) & set(out):
                raise AssertionError(f"outputs {set(made) & set(out)} are made twice")
            out |= made
        return out

    def _apply(self, inputs: list[Series]) -> dict[str, Series]:
        kind, one = getattr(self.function, "tidemark_kind", "pandas"), inputs[0]
        if kind == "column":
            if all(s.df is one.df for s in inputs):
                at, cols = one, [F.col(f"`{s.value}`") for s in inputs]
            else:
                at, cols = merge_rows(inputs)[1], [F.col(f"`{s.name}`") for s in inputs]
            got = self.function(*cols, **self.kwargs)
            named = got if isinstance(got, dict) else {one.name if len(inputs) == 1 else self._out_name(): got}
            df = at.df.select(*at.own, *[c.alias(n) for n, c in named.items()])
            return {n: replace(at, name=n, df=df, value=n) for n in named}
        if kind == "series":
            got = self.function(*inputs, **self.kwargs)
            got = got if isinstance(got, list) else [got]
            if not all(isinstance(s, Series) for s in got) or len({s.name for s in got}) < len(got):
                raise TypeError("a processor returns a Series or a list of Series with unique names")
            return {s.name: s for s in got}
        return self._pandas(inputs)

    def _out_name(self) -> str:
        raise TypeError("a function of several inputs must name its output: return {name: Column}")

    def _pandas(self, inputs: list[Series]) -> dict[str, Series]:
        """One call per entity; without entity columns the whole series is one group, so give keys (or chunk) large ones."""
        one = inputs[0]
        ship_package(one.df.sparkSession)
        declared = self.kwargs.get("output_names")
        kwargs = {k: v for k, v in self.kwargs.items() if k != "output_names"}
        table, at = merge_rows(inputs)
        known, row = at.row, at.row or fresh_name(table, "__row_of_index")
        schema = T.StructType([*[table.schema[k] for k in one.keys], table.schema[one.index], T.StructField(row, T.IntegerType()), T.StructField("__name", T.StringType()), T.StructField("__value", T.DoubleType())])
        function, index, keys, names, step = self.function, one.index, list(one.keys), [s.name for s in inputs], self.name

        def counted(s: pd.Series) -> np.ndarray:
            return s.groupby(level=0, dropna=False).cumcount().to_numpy() + 1

        def rows_of(s: pd.Series, args: list[pd.Series], rows: list[np.ndarray]) -> np.ndarray:
            """Numbers of the rows that an output is made of: an input's if it has its index, else as they come."""
            of_input = next((r for a, r in zip(args, rows, strict=True) if s.index.equals(a.index)), None)
            return counted(s) if of_input is None else of_input

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(batches, ignore_index=True).sort_values([index, known] if known else index, kind="stable")
            entity = {k: pdf[k].iloc[0] for k in keys}
            args = [pdf.set_index(index)[n].dropna() for n in names]
            rows = [pdf[known].to_numpy()[pdf[n].notna().to_numpy()] if known else counted(a) for n, a in zip(names, args, strict=True)]
            try:
                made = named_series(function(*args, **kwargs), args)
            except Exception as e:
                raise RuntimeError(f"error while processing function {step}: {e}") from e
            unknown = {s.name for s in made} - set(declared or [s.name for s in made])
            if unknown or len({s.name for s in made}) < len(made):
                raise RuntimeError(f"error while processing function {step}: outputs {sorted(s.name for s in made)} are not distinct or not declared")
            del pdf
            for s in made:
                numbers = rows_of(s, args, rows)
                for k in range(0, len(s), OUT_ROWS):
                    part = s.iloc[k : k + OUT_ROWS]
                    yield pd.DataFrame({**entity, index: part.index, row: numbers[k : k + OUT_ROWS], "__name": s.name, "__value": pd.to_numeric(part.to_numpy()).astype(float)})

        got = table.groupBy(*keys).applyInPandas(run, schema)
        if declared is None:
            got = write_once(got, "processed")
        outputs = declared or [r[0] for r in got.select("__name").distinct().orderBy("__name").collect()]
        source = at.source if known else got
        return {n: Series(n, got.where(F.col("__name") == n).select(*keys, index, row, F.col("__value").alias(n)), index, n, one.keys, row, source) for n in outputs}


def named_series(got, inputs: list[pd.Series]) -> list[pd.Series]:
    """The output contract: frame, named series, unnamed series or array of one input, or list of named series."""
    if isinstance(got, pd.DataFrame):
        return [got[c].rename(str(c)) for c in got.columns]
    if isinstance(got, pd.Series):
        if got.name is None and len(inputs) > 1:
            raise TypeError("a series from several inputs needs a name")
        return [got.rename(str(got.name) if got.name is not None else inputs[0].name)]
    if isinstance(got, np.ndarray):
        if len(inputs) > 1 or len(got) != len(inputs[0]):
            raise TypeError("an array must have the length of the one input")
        return [pd.Series(got, index=inputs[0].index, name=inputs[0].name)]
    if isinstance(got, list) and all(isinstance(s, pd.Series) and s.name is not None for s in got):
        return [s.rename(str(s.name)) for s in got]
    raise TypeError(f"a processor cannot return {type(got).__name__}")


class SeriesPipeline:
    """Steps in order; each sees what those before replaced or added."""

    def __init__(self, processors: Sequence = ()):
        self.steps: list[SeriesProcessor] = []
        for p in processors:
            self.append(p)

    def append(self, processor) -> None:
        self.insert(len(self.steps), processor)

    def insert(self, idx: int, processor) -> None:
        if not isinstance(processor, SeriesProcessor | SeriesPipeline):
            raise TypeError(f"cannot add a {type(processor).__name__}")
        self.steps[idx:idx] = processor.steps if isinstance(processor, SeriesPipeline) else [processor]

    def get_required_series(self) -> list[str]:
        return list(dict.fromkeys(n for s in self.steps for n in s.get_required_series()))

    def process(self, data, return_df: bool = False, return_all_series: bool = True, drop_keys: Sequence[str] = (), copy: bool = False, logging_file_path: str | None = None, *, index: str | None = None, keys: Sequence[str] = ()):
        """A SeriesSet, or one outer-merged DataFrame; without ``return_all_series`` only what steps have made."""
        now = dict(SeriesSet.of(data, index, keys))
        for s in now.values():
            if not is_time(s.kind) and not s.df.isEmpty():
                raise AssertionError(f"series {s.name} needs a time index")
        now = {s.name: s for s in with_rows(now.values())}
        made, logs = [], []
        for step in self.steps:
            began = time.perf_counter()
            try:
                out = step(SeriesSet(now.values()))
            except Exception as e:
                raise ProcessingError(f"error while processing function {step.name}: {e}") from e
            now |= {s.name: s for s in with_rows(out.values())}
            made += out
            logs.append((step, time.perf_counter() - began))
        if logging_file_path:
            logger = metrics.logging.getLogger("tidemark.processing")
            metrics.add_logging_handler(logger, logging_file_path)
            for step, took in logs:
                logger.info(f"[{step.name}] on {[' '.join(n) for n in step.series_names]} finished in [{took} seconds]!")
            metrics.delete_logging_handlers(logger)
        keep = [n for n in now if (return_all_series or n in made) and n not in set(drop_keys)]
        series = SeriesSet(now[n] for n in keep)
        return outer_merge(list(series.values())) if return_df else series

    def serialize(self, file_path) -> None:
        with open(file_path, "wb") as f:
            cloudpickle.dump(self, f)

    def __repr__(self) -> str:
        return "[\n" + "\n".join(f"\t{s.name}: {s.series_names}" for s in self.steps) + "\n]"


# -- native transforms ------------------------------------------------------


@elementwise
def absolute(v: Column) -> Column:
    return F.abs(v)


@elementwise
def clip(v: Column, low=None, high=None) -> Column:
    out = v if low is None else F.greatest(v, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


@elementwise
def threshold(v: Column, least) -> Column:
    """Values under ``least`` become null."""
    return F.when(v >= F.lit(least), v)


@elementwise
def shift_by(v: Column, offset) -> Column:
    return v + F.lit(offset)


@elementwise
def to_numeric(v: Column) -> Column:
    return v.try_cast("double")


@elementwise
def magnitude(*vs: Column, name: str = "magnitude") -> dict[str, Column]:
    return {name: F.sqrt(reduce(lambda a, b: a + b, [v * v for v in vs]))}


@elementwise
def combine(*vs: Column, name: str, signs: Sequence[int] = ()) -> dict[str, Column]:
    return {name: reduce(lambda a, b: a + b, [F.lit(k) * v for k, v in zip(signs or [1] * len(vs), vs, strict=True)])}


def _with(s: Series, df: DataFrame, value: Column, name: str | None = None) -> Series:
    n = name or s.name
    return replace(s, name=n, df=df.select(*s.own, value.alias(n)), value=n)


@on_series
def drop_na(s: Series) -> Series:
    v = F.col(f"`{s.name}`")
    return replace(s, df=s.df.select(*s.own, F.col(f"`{s.value}`").alias(s.name)).where(v.isNotNull() & ~F.isnan(v.cast("double"))), value=s.name)


def _numbered(s: Series) -> DataFrame:
    return s.df.select(*s.own, F.col(f"`{s.value}`").alias("__v"), index_number(s.df, s.index).alias("__t"))


def _scalars(s: Series, **aggs: Column) -> DataFrame:
    """The rows with aggregates of their whole series (one row per key) beside them."""
    df = _numbered(s)
    table = df.groupBy(*s.keys).agg(*[a.alias(n) for n, a in aggs.items()])
    if s.keys:
        return df.join(table, list(s.keys))
    row = table.first()  # constants in the plan
    return df.withColumns({n: F.lit(row[n]) for n in aggs})


@on_series
def zscore(s: Series) -> Series:
    v = F.col("__v")
    return _with(s, _scalars(s, m=F.avg(v), sd=F.stddev_pop(v)), F.try_divide(v - F.col("m"), F.col("sd")))


@on_series
def quantile_clip(s: Series, low: float = 0.01, high: float = 0.99) -> Series:
    v = F.col("__v")
    return _with(s, _scalars(s, lo=F.percentile(v, F.lit(low)), hi=F.percentile(v, F.lit(high))), F.least(F.greatest(v, F.col("lo")), F.col("hi")))


@on_series
def detrend(s: Series) -> Series:
    """Minus the least-squares line over the index."""
    v, t = F.col("__v"), F.col("__t")
    df = _scalars(s, a=F.regr_slope(v, t), mt=F.avg(t), mv=F.avg(v))
    return _with(s, df, v - F.col("mv") - F.coalesce("a", F.lit(0.0)) * (t - F.col("mt")))


@on_series
def difference(s: Series, absolute_value: bool = False) -> Series:
    df = ordering.with_previous(_numbered(s), "__t", {"__p": "__v"}, s.keys, tie=["__v"])
    d = F.col("__v") - F.col("__p")
    return _with(s, df, F.abs(d) if absolute_value else d)


@on_series
def shift_rows(s: Series, steps: int = 1, name: str | None = None) -> Series:
    """The value ``steps`` rows before (after, if negative); null where there is none."""
    return _with(s, ordering.with_shifted(_numbered(s), "__t", "__v", "__s", steps, s.keys, tie=["__v"]), F.col("__s"), name)


@on_series
def interpolate(s: Series) -> Series:
    """Linear in row order terms of the index; outside of known values null at the start, the last value at the end."""
    df = _numbered(s).withColumn("__v", F.when(~F.isnan(F.col("__v").cast("double")), F.col("__v")))
    df = ordering.with_known_neighbours(df, "__t", "__v", s.keys)
    p, n, t = F.col("__prev"), F.col("__next"), F.col("__t")
    line = p["v"] + (n["v"] - p["v"]) * F.try_divide(t - p["t"], n["t"] - p["t"])
    return _with(s, df, F.coalesce("__v", line, F.when(n.isNull(), p["v"])))


#: Positions of a slice.
SLICE = 4096


def _frame(s: Series, before: int, after: int) -> DataFrame:
    """Rows with the array of their neighbours' values by position; slices of positions borrow rows at their edges."""
    df = ordering.with_position(_numbered(s), "__t", "__n", s.keys, tie=["__v"])
    cut = max(SLICE, before, after)  # so that a neighbourhood reaches the next slice at most
    own = df.withColumn("__part", F.floor(F.col("__n") / cut)).withColumn("__own", F.lit(True))
    edge = lambda to: own.where((F.floor((F.col("__n") + to) / cut)) != F.col("__part")).withColumn("__part", F.floor((F.col("__n") + to) / cut)).withColumn("__own", F.lit(False))
    rows = own
    for step in (after, -before):
        if step:
            rows = rows.union(edge(step))
    from pyspark.sql import Window

    w = Window.partitionBy(*s.keys, "__part").orderBy("__n").rowsBetween(-before, after)
    return rows.withColumn("__near", F.collect_list("__v").over(w)).where("__own")


@on_series
def median_filter(s: Series, size: int = 5) -> Series:
    """Centred running median; at the edges over the values that are there."""
    df = _frame(s, size // 2, size // 2)
    a, n = F.array_sort("__near"), F.size("__near")
    return _with(s, df, (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor(n / 2).cast("int") + 1)) / 2)


@on_series
def fir(s: Series, taps: Sequence[float]) -> Series:
    """Centred filter with constant taps (odd in number); rows without a full neighbourhood keep their value."""
    half = len(taps) // 2
    df = _frame(s, half, half)
    got = F.aggregate(F.zip_with("__near", F.array(*map(F.lit, map(float, taps))), lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    return _with(s, df, F.when(F.size("__near") == len(taps), got).otherwise(F.col("__v").cast("double")))


def savgol_taps(size: int, order: int) -> list[float]:
    """Taps of the Savitzky-Golay smoother at a window's centre."""
    x = np.arange(size) - size // 2
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0].tolist()


@on_series
def rolling_mean(s: Series, window: str) -> Series:
    """Mean over the trailing time range (t - window, t]."""
    from ..timeargs import parse_time

    df = ordering.trailing(_numbered(s), "__t", parse_time(window), {"__m": F.avg("__v")}, s.keys)
    return _with(s, df, F.col("__m"))


def process_chunks(chunks: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, by: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """A pandas function per chunk; a chunk that fails prints its traceback and yields no rows."""
    ship_package(chunks.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return function(pdf)
        except Exception:
            import traceback

            traceback.print_exc()
            return pd.DataFrame({f.name: [] for f in schema.fields})

    return chunks.groupBy(*by).applyInPandas(run, schema)
