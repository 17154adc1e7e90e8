"""Series and descriptors."""

from __future__ import annotations

import functools
import itertools
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import timeargs
from .runtime import fresh_name

EPOCH = "1970-01-01"


def to_tuple(x) -> tuple:
    return tuple(x) if isinstance(x, list | tuple) else (x,)


def flatten(nested) -> list:
    return [y for x in nested for y in (flatten(x) if isinstance(x, list | tuple) else [x])]


def index_number(df: DataFrame, index: str) -> Column:
    """The index as microseconds (time) or as it is (number)."""
    kind = df.schema[index].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.unix_micros(F.col(index).cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return F.col(index).cast("long")
    if isinstance(kind, T.FractionalType):
        return F.col(index).cast("double")
    raise TypeError(f"index {index} is {kind.simpleString()}, neither time nor number")


def index_value(number: Column, kind: T.DataType) -> Column:
    """The inverse of ``index_number``."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        back = F.timestamp_micros(number.cast("long"))
        return back.cast(kind) if not isinstance(kind, T.DateType) else back
    return number


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType)


@dataclass(frozen=True)
class Series:
    """One named value column with its index, and entity columns if there are any.

    ``row`` numbers the rows of one index, and ``source`` is the table whose rows
    they are: what was made of one row goes together, however many rows have
    its index.
    """

    name: str
    df: DataFrame
    index: str
    value: str
    keys: tuple[str, ...] = ()
    row: str | None = None
    source: object = field(default=None, compare=False)

    @property
    def own(self) -> list[str]:
        """The columns that tell rows apart."""
        return [*self.keys, self.index, *([self.row] if self.row else [])]

    @property
    def kind(self) -> T.DataType:
        return self.df.schema[self.index].dataType

    def numbered(self) -> DataFrame:
        """keys, t (index as number) and v."""
        return self.df.select(*self.keys, index_number(self.df, self.index).alias("t"), F.col(self.value).alias("v"))


def with_rows(series: Iterable[Series]) -> list[Series]:
    """Series whose rows have numbers; those of one table share them.

    Rows of one index are numbered by their content, so that rows with one
    number differ in nothing wherever the table is computed again.
    """
    made, out = {}, []
    for s in series:
        at = (id(s.df), s.index, s.keys)
        if not s.row and at not in made:
            content = [f.name for f in s.df.schema.fields if f.name not in (*s.keys, s.index) and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
            row = fresh_name(s.df, "__row_of_index")
            order = Window.partitionBy(*s.keys, s.index).orderBy(*[F.col(f"`{c}`") for c in content] or [F.lit(0)])
            made[at] = s.df.withColumn(row, F.row_number().over(order)), row
        out.append(s if s.row else replace(s, df=made[at][0], row=made[at][1], source=made[at][0]))
    return out


@dataclass(frozen=True)
class Grouped:
    """A table to be grouped by columns (the counterpart of a group-by object)."""

    df: DataFrame
    by: tuple[str, ...]


class SeriesSet(Mapping):
    """Series by name."""

    def __init__(self, series: Iterable[Series]):
        self._by_name: dict[str, Series] = {s.name: s for s in series}

    def __getitem__(self, name: str) -> Series:
        return self._by_name[name]

    def __iter__(self):
        return iter(self._by_name)

    def __len__(self) -> int:
        return len(self._by_name)

    @classmethod
    def of(cls, data, index: str | None = None, keys: Sequence[str] = (), spark: SparkSession | None = None) -> SeriesSet:
        """From a DataFrame (Spark or pandas), a pandas Series, a Series, a SeriesSet, or a list of those."""
        if isinstance(data, SeriesSet):
            return data
        out: list[Series] = []
        for item in data if isinstance(data, list | tuple) else [data]:
            if isinstance(item, SeriesSet):
                out += item.values()
            elif isinstance(item, Series):
                out.append(item)
            elif isinstance(item, pd.Series | pd.DataFrame):
                frame = item.to_frame() if isinstance(item, pd.Series) else item
                if not frame.index.is_monotonic_increasing:
                    warnings.warn(f"the index of {list(frame.columns)} is not monotonic increasing; the order of rows does not count", RuntimeWarning, stacklevel=2)
                name = frame.index.name or "index"
                session = spark or SparkSession.active()
                df = session.createDataFrame(frame.rename_axis(name).reset_index())
                out += [Series(str(c), df, name, str(c)) for c in frame.columns]
            elif isinstance(item, DataFrame):
                at = index or first_index(item, keys)
                out += [Series(c, item, at, c, tuple(keys)) for c in item.columns if c != at and c not in keys]
            else:
                raise AssertionError(f"data must be series or data frames, not {type(item).__name__}")
        return cls(out)

    @classmethod
    def of_long(cls, df: DataFrame, index: str, value: str, kind: str, names: Sequence[str], keys: Sequence[str] = ()) -> SeriesSet:
        """From a long table: one series for each of the named kinds."""
        return cls(Series(n, df.where(F.col(kind) == n).select(*keys, index, F.col(value).alias(n)), index, n, tuple(keys)) for n in names)


def first_index(df: DataFrame, keys: Sequence[str]) -> str:
    """The first time column, else the first column."""
    free = [f for f in df.schema.fields if f.name not in keys]
    return next((f.name for f in free if is_time(f.dataType)), free[0].name)


def name_of(func) -> str:
    """A callable's name: its own, that of what a partial wraps, or its class."""
    if isinstance(func, functools.partial):
        return name_of(func.func)
    return getattr(func, "__name__", None) or type(func).__name__


class FuncWrapper:
    """A feature function with output names and how it wants its input.

    ``func`` is a native function's name, a numpy function that has a native
    counterpart, or any Python callable, which then runs on Arrow batches.
    """

    def __init__(self, func: str | Callable, output_names: str | list[str] | None = None, input_type=np.ndarray, vectorized: bool = False, **kwargs):
        if output_names is not None and not (isinstance(output_names, str) or isinstance(output_names, list) and all(isinstance(o, str) for o in output_names)):
            raise TypeError("output_names must be a string or a list of strings")
        if input_type not in (np.ndarray, np.array, pd.Series, tuple):
            raise TypeError("input_type must be np.ndarray, pd.Series or tuple (index, values)")
        if vectorized and input_type is pd.Series:
            raise AssertionError("a vectorized function takes arrays")
        from .functions.native import native_name

        self.func, self.kwargs, self.vectorized = func, kwargs, vectorized
        self.input_type = np.ndarray if input_type is np.array else input_type
        self.native = None if vectorized or self.input_type is not np.ndarray else native_name(func)
        default = self.native or name_of(func)
        if isinstance(func, str) and not self.native:
            raise ValueError(f"no native function {func!r}")
        from .functions.native import default_outputs

        self.output_names = tuple([output_names] if isinstance(output_names, str) else output_names or (default_outputs(self.native, kwargs) if self.native else [default]))
        if any("__" in o for o in self.output_names):
            raise AssertionError("output names may not contain '__'")

    def __call__(self, *series):
        return self.func(*series, **self.kwargs)


@dataclass(frozen=True)
class FeatureDescriptor:
    """A function over one or several series, a window and strides."""

    function: object
    series_name: object
    window: object = None
    stride: object = None
    strides: tuple = field(init=False, default=())

    def __post_init__(self):
        func = self.function
        if not (callable(func) or isinstance(func, str | FuncWrapper)):
            raise TypeError("function must be callable, a native name or a FuncWrapper")
        object.__setattr__(self, "function", func if isinstance(func, FuncWrapper) else FuncWrapper(func))
        object.__setattr__(self, "series_name", to_tuple(self.series_name))
        strides = sorted({timeargs.parse(s) for s in flatten([self.stride]) if s is not None})
        if self.window is None and strides:
            raise AssertionError("a stride needs a window")
        kinds = {timeargs.kind_of(x) for x in [self.window, *flatten([self.stride])]} - {None}
        if len(kinds) > 1:
            raise TypeError("window and stride must both be times or both be numbers")
        object.__setattr__(self, "strides", tuple(strides))
        for name in self.series_name:
            if "|" in name or "__" in name:
                raise AssertionError(f"series name {name!r} may not contain '|' or '__'")

    @property
    def kind(self) -> str | None:
        return timeargs.kind_of(self.window)

    def get_required_series(self) -> list[str]:
        return list(dict.fromkeys(self.series_name))

    def get_nb_output_features(self) -> int:
        return len(self.function.output_names)

    @property
    def prefix(self) -> str:
        return "|".join(self.series_name)

    def columns(self, window: str) -> list[str]:
        return [f"{self.prefix}__{o}__w={window}" for o in self.function.output_names]


class MultipleFeatureDescriptors:
    """All combinations of functions, series and windows; strides are shared, not multiplied."""

    def __init__(self, functions, series_names, windows=None, strides=None):
        functions, series_names, windows = (x if isinstance(x, list) else [x] for x in (functions, series_names, windows))
        self.feature_descriptions = [FeatureDescriptor(f, s, w, strides) for f, s, w in itertools.product(functions, series_names, windows)]
