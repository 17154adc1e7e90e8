"""Structured Streaming forms of the window, gap and run operators (an extension: batches are the reference behaviour)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hopping(stream: DataFrame, index: str, window: str, stride: str, aggregates: Sequence[Column], keys: Sequence[str] = (), late: str = "10 minutes", start: str = "0 seconds") -> DataFrame:
    """Aggregates per hopping window; a stream has no first sample, so the grid's anchor ``start`` is fixed."""
    grouped = stream.withWatermark(index, late).groupBy(F.window(index, window, stride, start), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in grouped.columns if c != "window"])


def gap_sessions(stream: DataFrame, index: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates per gap-free chunk of each key."""
    grouped = stream.withWatermark(index, late).groupBy(F.session_window(index, gap), *keys).agg(*aggregates)
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in grouped.columns if c != "session_window"])


def consecutive_runs(stream: DataFrame, index: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Closed runs of equal values per key (start, end, n); rows must come in index order within a key."""
    key_type = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    when = stream.schema[index].dataType.simpleString()

    def step(key, frames, state: GroupState):
        run = list(state.get) if state.exists else None
        closed = []
        for pdf in frames:
            for t, v in pdf.sort_values(index)[[index, value]].dropna().itertuples(index=False):
                if run is None or run[0] != str(v):
                    if run is not None:
                        closed.append((*key, run[0], run[1], run[2], run[3]))
                    run = [str(v), t, t, 0]
                run[2], run[3] = t, run[3] + 1
        if run is not None:
            state.update(tuple(run))
        yield pd.DataFrame(closed, columns=[*keys, value, "start", "end", "n"])

    schema = f"{key_type}, {value} string, start {when}, end {when}, n long"
    return stream.groupBy(*keys).applyInPandasWithState(step, schema, f"v string, s {when}, e {when}, n long", "append", GroupStateTimeout.NoTimeout)
