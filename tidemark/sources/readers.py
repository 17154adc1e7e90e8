"""Sources and sinks."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..model import Series, SeriesSet


def load_dataset(spark: SparkSession, folder: str, names: str | Sequence[str], index: str = "timestamp") -> list[DataFrame]:
    """Parquet tables of a folder by (lower-cased) name, index column first."""
    out = []
    for n in [names] if isinstance(names, str) else names:
        df = spark.read.parquet(f"{folder.rstrip('/')}/{n.lower()}.parquet")
        out.append(df.select(index, *[c for c in df.columns if c != index]) if index in df.columns else df)
    return out


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ";", null: str = "?") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, nullValue=null, header=True)


#: Fields of a signal's header in the European Data Format and their sizes (fixed values).
EDF_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
EDF_NOTES = "EDF Annotations"


def edf_header(raw: bytes) -> dict:
    """Start, records, seconds of a record, bytes of the header and the signals of an EDF file."""
    text = lambda a, n: raw[a : a + n].decode("latin-1").strip()
    day, month, year = map(int, text(168, 8).split("."))
    hour, minute, second = map(int, text(176, 8).split("."))
    out = {"start": dt.datetime(year + (1900 if year >= 85 else 2000), month, day, hour, minute, second), "bytes": int(text(184, 8)), "records": int(text(236, 8)), "seconds": float(text(244, 8)), "signals": []}
    n, at = int(text(252, 4)), 256
    columns = {}
    for name, size in EDF_FIELDS:
        columns[name] = [text(at + k * size, size) for k in range(n)]
        at += n * size
    out["signals"] = [{name: columns[name][k] for name, _ in EDF_FIELDS} for k in range(n)]
    return out


def _edf_records(raw: bytes) -> tuple[dict, np.ndarray, list[int]]:
    head = edf_header(raw)
    edges = np.cumsum([0, *(int(s["samples"]) for s in head["signals"])]).tolist()
    body = np.frombuffer(raw, "<i2", offset=head["bytes"], count=(len(raw) - head["bytes"]) // 2)
    return head, body[: len(body) // max(edges[-1], 1) * max(edges[-1], 1)].reshape(-1, max(edges[-1], 1)), edges


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """file, signal, ts and value of all samples of EDF files; one task reads one file and gives out a signal at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                head, records, edges = _edf_records(raw.as_py())
                start = int(head["start"].replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
                for k, s in enumerate(head["signals"]):
                    if s["label"] == EDF_NOTES:
                        continue
                    digital = records[:, edges[k] : edges[k + 1]].ravel()
                    low, high, least, most = (float(s[c]) for c in ("low", "high", "digital_low", "digital_high"))
                    value = (digital - least) * ((high - low) / (most - least)) + low
                    us = start + np.round(np.arange(len(value)) * (head["seconds"] * 1e6 / int(s["samples"]))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(value)), pa.array([s["label"]] * len(value)), pa.array(us, pa.timestamp("us")), pa.array(value)], ["file", "signal", "ts", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, signal string, ts timestamp_ntz, value double")


def read_edf_annotations(spark: SparkSession, path: str) -> DataFrame:
    """file, ts, seconds (null if not given) and description of all annotations of EDF+ files."""
    note = re.compile(rb"([+-][0-9.]+)(?:\x15([0-9.]+))?\x14([^\x00]*)\x14\x00")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                head, records, edges = _edf_records(raw.as_py())
                rows = []
                for k, s in enumerate(head["signals"]):
                    if s["label"] == EDF_NOTES:
                        for record in records[:, edges[k] : edges[k + 1]]:
                            for m in note.finditer(record.tobytes()):
                                when = head["start"] + dt.timedelta(seconds=float(m[1]))
                                rows += [(name, when, float(m[2]) if m[2] else None, t.decode("utf-8")) for t in m[3].split(b"\x14") if t]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                kinds = [pa.string(), pa.timestamp("us"), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "ts", "seconds", "description"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, ts timestamp_ntz, seconds double, description string")


def to_series_list(data, index: str | None = None, keys: Sequence[str] = ()) -> list[Series]:
    """Series of tables or of a list of tables."""
    try:
        return list(SeriesSet.of(data, index, keys).values())
    except AssertionError as e:
        raise TypeError(str(e)) from e


def long_to_series(df: DataFrame, time_col: str, value_col: str, kind_col: str, names: Sequence[str] | None = None) -> SeriesSet:
    """One series per kind of a long table; without ``names`` the kinds are looked up."""
    if names is None:
        names = [r[0] for r in df.select(kind_col).distinct().orderBy(kind_col).collect()]
    return SeriesSet.of_long(df, time_col, value_col, kind_col, names)


def load_config(path):
    """A serialized collection or pipeline."""
    with open(path, "rb") as f:
        return cloudpickle.pickle.load(f)
