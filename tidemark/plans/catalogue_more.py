"""More registered queries: sources and sinks, several series, Python functions, contracts and helpers."""

from __future__ import annotations

import datetime as dt
import logging
import tempfile
import warnings
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import metrics, timeargs
from ..api import FeatureCollection, FeatureDescriptor, FuncWrapper, MultipleFeatureDescriptors, Series, SeriesPipeline, SeriesProcessor, SeriesSet, chunk_data, concat_rows, join_on_index, make_robust, outer_merge, process_chunks
from ..functions import adapters, spectral
from ..model import flatten, name_of, to_tuple
from ..operators import processing as P
from ..sources import readers
from .catalogue import BASIC, BASIC_NAMES, CHUNK_FS, RUNS_SQL, H, events, grid_sql, hop_sql, kinds, kinds_of_rows, query, renamed, table


def one(func, series, window, stride=None) -> FeatureCollection:
    return FeatureCollection(FeatureDescriptor(func, series, window, stride))


def facts(spark: SparkSession, rows: list[tuple[str, object]]) -> DataFrame:
    """Checks and what came out, as a table."""
    return spark.createDataFrame([(a, str(b)) for a, b in rows], "fact string, outcome string")


def facts_sql(rows: list[tuple[str, object]]) -> str:
    quoted = ["('{}', '{}')".format(*(str(x).replace("'", "''") for x in row)) for row in rows]
    return f"SELECT fact, outcome FROM (VALUES {', '.join(quoted)}) v(fact, outcome)"


def raised(call) -> str:
    """The name of the exception that a call raises."""
    try:
        call()
    except Exception as e:
        return type(e).__name__
    return "none"


def warned(call) -> str:
    """The categories of the warnings that a call gives, without repeats."""
    with warnings.catch_warnings(record=True) as got:
        warnings.simplefilter("always")
        call()
    return ",".join(sorted({w.category.__name__ for w in got if w.category in (RuntimeWarning, UserWarning)})) or "none"


def seconds(spark: SparkSession, n: int, name: str = "v", step: int = 1, skip: tuple = ()) -> DataFrame:
    """``n`` samples every ``step`` seconds from 2024-01-01 on, with their numbers as values."""
    rows = spark.range(n).where(~F.col("id").isin(list(skip))) if skip else spark.range(n)
    return rows.select(F.timestamp_seconds(1704067200 + F.col("id") * step).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias(name))


# -- sources and sinks --------------------------------------------------------


@query("SELECT count(*) AS n, min(ts) AS first_ts, round(sum(value), 4) AS total FROM events")
def load_dataset(spark, d):
    df = readers.load_dataset(spark, d, "Events", index="ts")[0]
    assert df.columns[0] == "ts"
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT (i * 10 + 10)::BIGINT AS place, (100 * i + 45)::DOUBLE AS total FROM range(0, 9) r(i)")
def pandas_series_source(spark, d):
    series = pd.Series(np.arange(100.0), index=pd.RangeIndex(100, name="place"), name="v")
    out = one("sum", "v", 10, 10).calculate(series, return_df=True)
    return renamed(out, place="place", total="v__sum__w=10")


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def long_to_series(spark, d):
    series = readers.long_to_series(table(spark, d, "events"), "ts", "value", "event_type")
    assert len(readers.to_series_list([s.df for s in series.values()])) == 5
    parts = [series[k].df.select(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("click", "error")]
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query(hop_sql(BASIC, 3 * H, [3 * H]))
def config_round_trip(spark, d):
    """A collection that was written, read and reduced gives what it gave."""
    folder = Path(tempfile.mkdtemp(prefix="tidemark-config-"))
    FeatureCollection(MultipleFeatureDescriptors(["len", "sum", "mean", "std", "max"], "value", "3h", "3h")).serialize(folder / "fc.bin")
    fc = readers.load_config(folder / "fc.bin").reduce([f"value__{v}__w=3h" for v in BASIC_NAMES.values()])
    return renamed(fc.calculate(events(spark, d), return_df=True), ts="ts", **{k: f"value__{v}__w=3h" for k, v in BASIC_NAMES.items()})


@query("SELECT ts, round(abs(value - 50), 6) AS value FROM events")
def pipeline_round_trip(spark, d):
    folder = Path(tempfile.mkdtemp(prefix="tidemark-config-"))
    SeriesPipeline([SeriesProcessor(P.shift_by, "value", offset=-50.0), SeriesProcessor(P.absolute, "value")]).serialize(folder / "p.bin")
    return readers.load_config(folder / "p.bin").process(events(spark, d), return_df=True).select("ts", F.round("value", 6).alias("value"))


@query("SELECT * FROM (VALUES (1, 2.5::FLOAT, 'a'), (2, NULL, 'b'), (3, -1.25::FLOAT, NULL)) v(k, x, s)")
def csv_with_marks(spark, d):
    path = Path(tempfile.mkdtemp(prefix="tidemark-csv-")) / "table.csv"
    path.write_text("k;x;s\n1;2.5;a\n2;?;b\n3;-1.25;?\n")
    rows = readers.read_csv(spark, str(path), "k int, x float, s string").collect()  # three rows; the file is the driver's
    return spark.createDataFrame(rows, "k int, x float, s string")


def edf_file(path: Path, signals: dict[str, tuple[float, float, np.ndarray]], records: int, notes: list[bytes] = ()) -> None:
    """A small European Data Format file of one-second records: label -> (low, high, 16-bit samples)."""
    field = lambda x, n: str(x).ljust(n).encode("ascii")
    columns = [(label, low, high, -32768, 32767, samples.reshape(records, -1)) for label, (low, high, samples) in signals.items()]
    if notes:
        block = np.frombuffer(b"".join(n.ljust(64, b"\0") for n in notes), "<i2").reshape(records, -1)
        columns.append((readers.EDF_NOTES, -1, 1, -32768, 32767, block))
    n = len(columns)
    head = field(0, 8) + field("X", 80) + field("X", 80) + b"03.01.24" + b"04.05.06" + field(256 * (n + 1), 8) + field("", 44) + field(records, 8) + field(1, 8) + field(n, 4)
    for values, size in (([c[0] for c in columns], 16), ([""] * n, 80), (["uV"] * n, 8), *(([c[k] for c in columns], 8) for k in (1, 2, 3, 4)), ([""] * n, 80), ([c[5].shape[1] for c in columns], 8), ([""] * n, 32)):
        head += b"".join(field(v, size) for v in values)
    path.write_bytes(head + b"".join(c[5][r].astype("<i2").tobytes() for r in range(records) for c in columns))


@query("SELECT 'EEG' AS signal, TIMESTAMP '2024-01-03 04:05:06' + to_milliseconds(i * 10) AS ts, round((i + 32768) * 200.0 / 65535 - 100, 6) AS value FROM range(0, 300) r(i) UNION ALL SELECT 'EOG', TIMESTAMP '2024-01-03 04:05:06' + to_milliseconds(i * 100), round((-i + 32768) * 10.0 / 65535 - 5, 6) FROM range(0, 30) r(i)")
def edf_signals(spark, d):
    path = Path(tempfile.mkdtemp(prefix="tidemark-edf-")) / "night.edf"
    edf_file(path, {"EEG": (-100, 100, np.arange(300)), "EOG": (-5, 5, -np.arange(30))}, 3)
    rows = readers.read_edf(spark, str(path)).toPandas()  # the file is the driver's
    return spark.createDataFrame(rows[["signal", "ts", "value"]]).select("signal", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value", 6).alias("value"))


@query("SELECT * FROM (VALUES (TIMESTAMP '2024-01-03 04:05:06', 30.0::DOUBLE, 'Sleep stage W'), (TIMESTAMP '2024-01-03 04:05:36.5', 60.0, 'Sleep stage 1'), (TIMESTAMP '2024-01-03 04:06:06', NULL, 'Lights off')) v(ts, seconds, description)")
def edf_annotations(spark, d):
    path = Path(tempfile.mkdtemp(prefix="tidemark-edf-")) / "stages.edf"
    notes = [b"+0\x14\x14\0+0\x1530\x14Sleep stage W\x14\0", b"+1\x14\x14\0+30.5\x1560\x14Sleep stage 1\x14\0", b"+2\x14\x14\0+60\x14Lights off\x14\0"]
    edf_file(path, {"EEG": (-100, 100, np.arange(300))}, 3, notes)
    rows = [tuple(r)[1:] for r in readers.read_edf_annotations(spark, str(path)).collect()]
    return spark.createDataFrame(rows, "ts timestamp_ntz, seconds double, description string")


# -- logs ---------------------------------------------------------------------

LOGGED = [("mean", "a", "10s", "['5s']", 0.25), ("mean", "a", "10s", "['5s']", 0.75), ("std", "a", "10s", "['5s']", 2.0), ("mean", "b", "1m", "['5s']", 1.0)]
LOGGED_SQL = "l AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{s}', '{w}', '{x.replace(chr(39), chr(39) * 2)}', {t})" for f, s, w, x, t in LOGGED) + ") v(function, series_names, \"window\", stride, duration)), s AS (SELECT *, round(100 * duration / (SELECT sum(duration) FROM l), 2) AS duration_pct FROM l)"


def feature_log() -> Path:
    """A log of known durations, in the format of the feature log."""
    path = Path(tempfile.mkdtemp(prefix="tidemark-log-")) / "features.log"
    logger = logging.getLogger("tidemark.catalogue")
    metrics.add_logging_handler(logger, path)
    for f, s, w, stride, took in LOGGED:
        logger.info(f"[{f}] on ['{s}'] with window-stride [{w}, {stride}] with output ['{f}'] finished in [{took} seconds]!")
    metrics.delete_logging_handlers(logger)
    return path


def kept_rows(spark, df: DataFrame) -> DataFrame:
    """The rows of a table read from a file of the driver's own."""
    return spark.createDataFrame(df.collect(), df.schema)


@query(f"WITH {LOGGED_SQL} SELECT function, series_names, \"window\", stride, function AS output_names, duration, duration_pct FROM s")
def feature_logs(spark, d):
    path = feature_log()
    assert len(metrics.logging_file_to_df(path)) == len(LOGGED)
    return kept_rows(spark, metrics.get_feature_logs(spark, path).drop("log_time"))


STATS = "round(sum(duration), 6) AS sum_duration, round(avg(duration), 6) AS mean_duration, round(stddev_samp(duration), 6) AS std_duration, count(*) AS n, round(sum(duration_pct), 4) AS sum_pct, round(avg(duration_pct), 4) AS mean_pct"


def ranked(spark, df: DataFrame) -> DataFrame:
    """Rounded statistics with the place of each row."""
    rows = df.collect()
    back = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("place", T.IntegerType()), *df.schema.fields]))
    return back.select("place", *[F.round(c, 4 if c.endswith("pct") else 6).alias(c) if t == "double" else F.col(c) for c, t in back.dtypes if c != "place"])


@query(f"WITH {LOGGED_SQL}, a AS (SELECT function, \"window\", stride, {STATS} FROM s GROUP BY 1, 2, 3) SELECT (row_number() OVER (ORDER BY mean_duration DESC) - 1)::INT AS place, * FROM a")
def function_stats(spark, d):
    return ranked(spark, metrics.get_function_stats(spark, feature_log()))


@query(f"WITH {LOGGED_SQL}, a AS (SELECT series_names, \"window\", stride, {STATS} FROM s GROUP BY 1, 2, 3) SELECT (row_number() OVER (ORDER BY sum_duration DESC) - 1)::INT AS place, * FROM a")
def series_stats(spark, d):
    return ranked(spark, metrics.get_series_names_stats(spark, feature_log()))


@query("SELECT * FROM (VALUES ('[''len'']', 'value', '6h', TRUE), ('[''spread'']', 'value', '6h', TRUE)) v(output, series_names, \"window\", timed)")
def execution_log(spark, d):
    """What a run writes: a line for each feature with a time of its own."""
    path = Path(tempfile.mkdtemp(prefix="tidemark-log-")) / "run.log"
    fc = FeatureCollection([FeatureDescriptor("len", "value", "6h", "6h"), FeatureDescriptor(FuncWrapper(lambda x: float(np.ptp(x)) if len(x) else 0.0, "spread"), "value", "6h", "6h")])
    fc.calculate(events(spark, d), return_df=True, logging_file_path=str(path), checks=False)
    logs = metrics.get_feature_logs(spark, path).collect()
    assert len({r.duration for r in logs}) == len(logs)
    return spark.createDataFrame([(f"['{r.output_names}']", r.series_names, r.window, r.duration > 0) for r in logs], "output string, series_names string, window string, timed boolean")


@query("SELECT * FROM (VALUES ('absolute', 'value', TRUE), ('clip', 'value', TRUE)) v(function, series_names, timed)")
def processor_log(spark, d):
    path = Path(tempfile.mkdtemp(prefix="tidemark-log-")) / "steps.log"
    SeriesPipeline([SeriesProcessor(P.absolute, "value"), SeriesProcessor(P.clip, "value", high=1.0)]).process(events(spark, d), logging_file_path=str(path))
    logs = metrics.get_processor_logs(spark, path).collect()
    return spark.createDataFrame([(r.function, r.series_names, r.duration >= 0) for r in logs], "function string, series_names string, timed boolean")


# -- windows ------------------------------------------------------------------


@query(hop_sql(BASIC, 2 * H, [3 * H, 4 * H]))
def stride_override(spark, d):
    fc = FeatureCollection(MultipleFeatureDescriptors(list(BASIC_NAMES.values()), "value", "2h", "1h"))
    out = fc.calculate(events(spark, d), stride=["3h", "4h"], return_df=True, approve_sparsity=True)
    return renamed(out, ts="ts", **{k: f"value__{v}__w=2h" for k, v in BASIC_NAMES.items()})


@query(hop_sql("count(e.value) AS n, round(sum(e.value), 4) AS total, round(stddev_pop(e.value), 6) AS sd", 24 * H, [H // 4]))
def panes_of_long_windows(spark, d):
    """Windows that overlap 96 times, made from panes."""
    out = FeatureCollection(MultipleFeatureDescriptors(["len", "sum", "std"], "value", "1D", "15min")).calculate(events(spark, d), return_df=True, approve_sparsity=True)
    return renamed(out, ts="ts", n="value__len__w=1D", total="value__sum__w=1D", sd="value__std__w=1D").withColumn("total", F.round("total", 4))


PANE_FUNCTIONS = {"least": "min", "most": "max", "begin_value": "first", "end_value": "last", "energy": "abs_energy", "area": "abs_area", "rms": "rms", "variance": "var", "reach": "ptp", "span": "time_span", "known": "count"}
PANE_SQL = "round(min(value), 6) AS least, round(max(value), 6) AS most, round(arg_min(value, e.ts), 6) AS begin_value, round(arg_max(value, e.ts), 6) AS end_value, round(sum(value * value), 4) AS energy, round(sum(abs(value)), 4) AS area, round(sqrt(avg(value * value)), 6) AS rms, round(var_pop(value), 6) AS variance, round(max(value) - min(value), 6) AS reach, round((max(epoch_us(e.ts)) - min(epoch_us(e.ts))) / 1e6, 6) AS span, count(value) AS known"


@query(hop_sql(PANE_SQL, 48 * H, [2 * H, 3 * H]))
def panes_of_many_functions(spark, d):
    fc = FeatureCollection(MultipleFeatureDescriptors(list(PANE_FUNCTIONS.values()), "value", "2D", ["2h", "3h"]))
    out = renamed(fc.calculate(events(spark, d), return_df=True, approve_sparsity=True), ts="ts", **{k: f"value__{v}__w=2D" for k, v in PANE_FUNCTIONS.items()})
    return out.withColumns({c: F.round(c, 4) for c in ("energy", "area")})


@query(
    f"WITH k AS (SELECT user_id % 3 AS entity, epoch_us(ts) AS t, CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE ELSE value END AS v FROM events), b AS (SELECT entity, min(t) t0, max(t) t1 FROM k GROUP BY 1), g AS (SELECT entity, t0 + i*{H} AS ws FROM b, range(0, (t1-t0-{12 * H})//{H} + 1) r(i)) "
    f"SELECT g.entity, make_timestamp(ws + {12 * H}) AS ts, CASE WHEN count(v) >= 20 THEN round(coalesce(sum(CASE WHEN NOT isnan(v) THEN v END), 0), 4) ELSE -1 END AS total, CASE WHEN count(v) = 0 OR bool_or(isnan(v)) THEN 'nan'::DOUBLE ELSE round(max(v), 6) END AS most FROM g LEFT JOIN k ON k.entity = g.entity AND t >= ws AND t < ws + {12 * H} GROUP BY g.entity, ws"
)
def panes_by_key(spark, d):
    df = table(spark, d, "events").select((F.col("user_id") % 3).alias("entity"), "ts", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("v"))
    fc = FeatureCollection([FeatureDescriptor(make_robust("nansum", min_nb_samples=20, error_val=-1.0), "v", "12h", "1h"), FeatureDescriptor("max", "v", "12h", "1h")])
    out = fc.calculate(df, return_df=True, index="ts", keys=["entity"], approve_sparsity=True)
    return renamed(out, entity="entity", ts="ts", total="v__nansum__w=12h", most="v__max__w=12h").withColumn("total", F.round("total", 4))


@query("WITH p AS (SELECT user_id % 3 AS entity, ts, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts) - 1 AS k FROM events), g AS (SELECT entity, i*30 AS ws FROM (SELECT entity, max(k) m FROM p GROUP BY 1), range(0, CASE WHEN m-50 < 0 THEN 0 ELSE (m-50)//30 + 1 END) r(i)) SELECT g.entity, (SELECT ts FROM p q WHERE q.entity = g.entity AND q.k = ws) AS ts, round(sum(value), 6) AS total, count(*) AS n FROM g JOIN p ON p.entity = g.entity AND k >= ws AND k < ws + 50 GROUP BY g.entity, ws")
def sample_windows_by_key(spark, d):
    df = table(spark, d, "events").select((F.col("user_id") % 3).alias("entity"), "ts", "value")
    out = FeatureCollection(MultipleFeatureDescriptors(["sum", "len"], "value", 50, 30)).calculate(df, return_df=True, index="ts", keys=["entity"], window_idx="begin", approve_sparsity=True)
    return renamed(out, entity="entity", ts="ts", total="value__sum__w=50", n="value__len__w=50")


@query(
    "WITH x AS (SELECT max(lo) lo, min(hi) hi FROM (SELECT min(ts) lo, max(ts) hi FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type)), p AS (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS k FROM events, x WHERE event_type IN ('click', 'view') AND ts BETWEEN lo AND hi), "
    "m AS (SELECT max(lo) lo, min(hi) hi FROM (SELECT min(k) lo, max(k) hi FROM p GROUP BY event_type)), g AS (SELECT lo + i*25 AS ws FROM m, range(0, CASE WHEN hi-lo-50 < 0 THEN 0 ELSE (hi-lo-50)//25 + 1 END) r(i)) "
    "SELECT (SELECT ts FROM p q WHERE q.event_type = 'click' AND q.k = ws) AS ts, round(sum(value), 6) AS total FROM g JOIN p ON k >= ws AND k < ws + 50 GROUP BY ws"
)
def sample_windows_of_two_series(spark, d):
    out = one("sum_2", ("click", "view"), 50, 25).calculate(kinds(spark, d, "click", "view"), return_df=True, window_idx="begin", approve_sparsity=True)
    return renamed(out, ts="ts", total="click|view__sum_2__w=50")


SEGMENT_ROWS = "SELECT event_id AS segment, ts AS a, ts + INTERVAL 5 HOUR AS b FROM events WHERE event_id % 50 = 0"


@query(f"SELECT i.segment, b AS ts, count(e.value) AS n, round(coalesce(sum(e.value), 0), 6) AS total FROM ({SEGMENT_ROWS}) i LEFT JOIN events e ON e.ts >= a AND e.ts < b GROUP BY i.segment, b")
def segments_of_a_table(spark, d):
    cuts = table(spark, d, "events").where("event_id % 50 = 0").select(F.col("event_id").alias("segment"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 5 HOURS")).alias("end"))
    out = FeatureCollection(MultipleFeatureDescriptors(["len", "sum"], "value")).calculate(events(spark, d), return_df=True, segments=cuts, checks=False)
    return renamed(out, segment="segment", ts="ts", n="value__len__w=manual", total="value__sum__w=manual")


@query("WITH e AS (SELECT user_id % 4 AS entity, * FROM events) SELECT i.entity, i.event_id AS segment, i.ts, round(coalesce(max(e.value), 'nan'::DOUBLE), 6) AS most FROM (SELECT * FROM e WHERE event_id % 40 = 0) i LEFT JOIN e ON e.entity = i.entity AND e.ts >= i.ts - INTERVAL 3 HOUR AND e.ts < i.ts GROUP BY 1, 2, 3")
def segment_ends_by_key(spark, d):
    df = table(spark, d, "events").withColumn("entity", F.col("user_id") % 4)
    cuts = df.where("event_id % 40 = 0").select("entity", F.col("event_id").alias("segment"), F.col("ts").alias("end"))
    out = one("max", "value", "3h").calculate(df.select("entity", "ts", "value"), return_df=True, index="ts", keys=["entity"], segments=cuts, checks=False)
    return renamed(out, entity="entity", segment="segment", ts="ts", most="value__max__w=3h")


@query("SELECT 0 AS n_rows, 'ts,value__sum__w=9000D' AS columns")
def zero_windows(spark, d):
    out = one("sum", "value", "9000D", "1D").calculate(events(spark, d), return_df=True, approve_sparsity=True)
    return spark.createDataFrame([(out.count(), ",".join(out.columns))], "n_rows int, columns string")


@query("SELECT 'ts,value__max__w=1D,value__max__w=6h,value__min__w=1D,value__min__w=6h,value|user__sum_2__w=6h' AS columns, TRUE AS sorted_parts, TRUE AS ordered")
def sorted_columns(spark, d):
    df = table(spark, d, "events").select("ts", "value", F.col("user_id").cast("double").alias("user"))
    fc = FeatureCollection([FeatureDescriptor("sum_2", ("value", "user"), "6h", "6h"), *MultipleFeatureDescriptors(["min", "max"], "value", ["6h", "1D"], "6h").feature_descriptions])
    out = fc.calculate(df, return_df=True, index="ts", checks=False)
    parts = fc.calculate(df, index="ts", checks=False)
    rows = [r.ts for r in fc.calculate(df, return_df=True, index="ts", checks=False, ordered=True).collect()]
    return spark.createDataFrame([(",".join(out.columns), len(parts) == 3, rows == sorted(rows))], "columns string, sorted_parts boolean, ordered boolean")


@query(hop_sql("CASE WHEN count(*) FILTER (event_type != 'error') >= 10 THEN round(max(e.value) FILTER (event_type != 'error'), 6) ELSE -1 END AS most, CASE WHEN count(*) FILTER (event_type != 'error') >= 10 THEN round(median(e.value) FILTER (event_type != 'error'), 6) ELSE -1 END AS middle", H, [H]))
def robust_without_nan(spark, d):
    df = table(spark, d, "events").select("ts", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("value"))
    middle = make_robust(FuncWrapper(lambda x: float(np.median(x)), "middle"), min_nb_samples=10, error_val=-1.0, passthrough_nans=False)
    fc = FeatureCollection([FeatureDescriptor(make_robust("max", min_nb_samples=10, error_val=-1.0, passthrough_nans=False), "value", "1h", "1h"), FeatureDescriptor(middle, "value", "1h", "1h")])
    return renamed(fc.calculate(df, return_df=True, approve_sparsity=True), ts="ts", most="value__max__w=1h", middle="value__middle__w=1h")


# -- functions of several series ---------------------------------------------

TWO = "(SELECT min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type)"
ASYNC = f"WITH {grid_sql(12 * H, [6 * H], 'max(lo)', 'min(hi)', source=TWO)}, w AS (SELECT we, event_type, value, row_number() OVER (PARTITION BY we, event_type ORDER BY ts) AS k FROM g JOIN events ON epoch_us(ts) >= ws AND epoch_us(ts) < we AND epoch_us(ts) BETWEEN (SELECT t0 FROM b) AND (SELECT t1 FROM b) WHERE event_type IN ('click', 'error')), x AS (SELECT * FROM w WHERE event_type = 'click'), y AS (SELECT * FROM w WHERE event_type = 'error')"


@query(f"{ASYNC} SELECT make_timestamp(g.we) AS ts, round(coalesce((SELECT sum(value) FROM w WHERE w.we = g.we), 0), 6) AS total, round(coalesce((SELECT sum(x.value * y.value) FROM x JOIN y USING (we, k) WHERE x.we = g.we), 0), 4) AS dot, coalesce((SELECT CASE WHEN count(*) > 1 THEN round(corr(x.value, y.value), 6) END FROM x JOIN y USING (we, k) WHERE x.we = g.we), 'nan'::DOUBLE) AS r, coalesce((SELECT round(avg(abs(x.value - y.value)), 6) FROM x JOIN y USING (we, k) WHERE x.we = g.we), 'nan'::DOUBLE) AS apart FROM g")
def two_series_async(spark, d):
    """Series without a common index: sums of each, and values paired by position."""
    fc = FeatureCollection(MultipleFeatureDescriptors(["sum_2", "dot", "corr", "abs_mean_diff"], [("click", "error")], "12h", "6h"))
    out = fc.calculate(kinds(spark, d, "click", "error"), return_df=True, approve_sparsity=True)
    name = "click|error__{}__w=12h".format
    return renamed(out, ts="ts", total=name("sum_2"), dot=name("dot"), r=name("corr"), apart=name("abs_mean_diff")).withColumn("dot", F.round("dot", 4))


@query(f"{ASYNC} SELECT make_timestamp(g.we) AS ts, (SELECT count(*) FROM x WHERE x.we = g.we)::DOUBLE AS clicks, (SELECT count(*) FROM y WHERE y.we = g.we)::DOUBLE AS errors, round(coalesce((SELECT max(value) FROM x WHERE x.we = g.we), 0) - coalesce((SELECT max(value) FROM y WHERE y.we = g.we), 0), 6) AS lead FROM g")
def many_to_many(spark, d):
    """A Python function of two asynchronous series with three outputs."""

    def compared(a, b):
        return len(a), len(b), (a.max() if len(a) else 0.0) - (b.max() if len(b) else 0.0)

    out = one(FuncWrapper(compared, ["clicks", "errors", "lead"]), ("click", "error"), "12h", "6h").calculate(kinds(spark, d, "click", "error"), return_df=True, approve_sparsity=True)
    return renamed(out, ts="ts", **{n: f"click|error__{n}__w=12h" for n in ("clicks", "errors", "lead")})


@query(hop_sql("round(coalesce(sum(e.value), 0) + coalesce(sum((e.user_id % 7)::DOUBLE), 0), 4) AS total, round(avg(abs(e.value - e.user_id % 7)), 6) AS apart", 24 * H, [12 * H]))
def two_series_of_one_table(spark, d):
    df = table(spark, d, "events").select("ts", "value", (F.col("user_id") % 7).cast("double").alias("user"))
    fc = FeatureCollection(MultipleFeatureDescriptors(["sum_2", "abs_mean_diff"], [("value", "user")], "1D", "12h"))
    return renamed(fc.calculate(df, return_df=True, index="ts", approve_sparsity=True), ts="ts", total="value|user__sum_2__w=1D", apart="value|user__abs_mean_diff__w=1D").withColumn("total", F.round("total", 4))


@query("WITH c AS (SELECT * FROM events WHERE event_type = 'click'), k AS (SELECT ts, (user_id % 3) AS kind FROM events WHERE event_id % 2 = 0), m AS (SELECT kind, c.value FROM k LEFT JOIN c ON c.ts = k.ts) SELECT kind, count(value) AS n, round(coalesce(sum(value), 0), 6) AS total FROM m GROUP BY kind")
def group_by_of_two_tables(spark, d):
    """The group column and the series have indexes of their own; they are aligned first."""
    kind = table(spark, d, "events").where("event_id % 2 = 0").select("ts", (F.col("user_id") % 3).alias("kind"))
    series = SeriesSet([*kinds(spark, d, "click").values(), Series("kind", kind, "ts", "kind")])
    out = FeatureCollection(MultipleFeatureDescriptors(["len", "sum"], "click")).calculate(series, return_df=True, group_by_all="kind", checks=False)
    return renamed(out, kind="kind", n="click__len__w=manual", total="click__sum__w=manual")


RUNS_OF_KIND = (
    "WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind FROM events), a AS (SELECT *, lag(kind) OVER (ORDER BY ts) IS DISTINCT FROM kind AS fresh FROM e WHERE kind IS NOT NULL), "
    "m AS (SELECT e.ts, e.value, e.kind, sum(coalesce(a.fresh, FALSE)::INT) OVER (ORDER BY e.ts) AS run FROM e LEFT JOIN a ON e.ts = a.ts) "
)


@query(RUNS_OF_KIND + "SELECT min(kind) AS kind, min(ts) FILTER (kind IS NOT NULL) AS run_start, round(max(value) - min(value), 6) AS spread, round(sum(value), 6) AS total FROM m WHERE run > 0 GROUP BY run")
def python_runs(spark, d):
    """Runs of equal values with a Python function beside a native one."""
    fc = FeatureCollection([FeatureDescriptor(FuncWrapper(lambda x: float(x.max() - x.min()), "spread"), "value"), FeatureDescriptor("sum", "counted")])
    out = fc.calculate(kinds_of_rows(spark, d), return_df=True, group_by_consecutive="kind", index="ts", checks=False)
    return renamed(out, kind="kind", run_start="__start", spread="value__spread__w=manual", total="counted__sum__w=manual")


@query("WITH w AS (SELECT g.ws, value FROM (SELECT (SELECT min(event_id) FROM events) + i * 40 AS ws FROM range(0, ((SELECT max(event_id) - min(event_id) FROM events) - 100) // 40 + 1) r(i)) g JOIN events ON event_id >= ws AND event_id < ws + 100) SELECT ws AS event_id, round(avg(value), 6) AS average, round(max(value) - min(value), 6) AS spread FROM w GROUP BY ws")
def vectorised_functions(spark, d):
    fc = FeatureCollection([FeatureDescriptor(FuncWrapper(np.mean, "average", vectorized=True, axis=1), "value", 100, 40), FeatureDescriptor(FuncWrapper(lambda x: x.max(axis=1) - x.min(axis=1), "spread", vectorized=True), "value", 100, 40)])
    out = fc.calculate(table(spark, d, "events").select("event_id", "value"), return_df=True, index="event_id", window_idx="begin")
    return renamed(out, event_id="event_id", average="value__average__w=100", spread="value__spread__w=100")


@query("SELECT user_id % 5 AS entity, round(avg(value) + 1, 6) AS shifted, count(*)::DOUBLE AS n FROM events GROUP BY 1")
def python_groups(spark, d):
    df = table(spark, d, "events").select("ts", "value", (F.col("user_id") % 5).alias("entity"))
    fc = FeatureCollection(FeatureDescriptor(FuncWrapper(lambda x: (float(x.mean()) + 1, len(x)), ["shifted", "n"]), "value"))
    return renamed(fc.calculate(df, return_df=True, group_by_all="entity", index="ts"), entity="entity", shifted="value__shifted__w=manual", n="value__n__w=manual")


@query(f"WITH {grid_sql(12 * H, [12 * H])} SELECT make_timestamp(we) AS ts, round(coalesce((max(epoch_us(e.ts)) - min(epoch_us(e.ts))) / 1e6, 0), 6) AS span, count(e.ts)::DOUBLE AS n FROM g LEFT JOIN events e ON epoch_us(e.ts) >= ws AND epoch_us(e.ts) < we GROUP BY we")
def python_with_index(spark, d):
    """Functions that want a series, or index and values, get the index with them."""

    def span(s):
        return (s.index[-1] - s.index[0]).total_seconds() if len(s) else 0.0

    fc = FeatureCollection([FeatureDescriptor(FuncWrapper(span, "span", input_type=pd.Series), "value", "12h", "12h"), FeatureDescriptor(FuncWrapper(lambda x: len(x[0]), "n", input_type=tuple), "value", "12h", "12h")])
    return renamed(fc.calculate(events(spark, d), return_df=True, approve_sparsity=True), ts="ts", span="value__span__w=12h", n="value__n__w=12h")


# -- native functions ---------------------------------------------------------

ORDERED = f"WITH {grid_sql(12 * H, [12 * H])}, m AS (SELECT we, e.ts, value AS v, row_number() OVER (PARTITION BY we ORDER BY e.ts) - 1 AS k, count(e.ts) OVER (PARTITION BY we) AS n, lag(value) OVER (PARTITION BY we ORDER BY e.ts) AS p, lead(value) OVER (PARTITION BY we ORDER BY e.ts) AS q, epoch_us(e.ts) - lag(epoch_us(e.ts)) OVER (PARTITION BY we ORDER BY e.ts) AS dt, avg(value) OVER (PARTITION BY we) AS mean, sum(abs(value)) OVER (PARTITION BY we) AS mass, sum(abs(value)) OVER (PARTITION BY we ORDER BY e.ts ROWS UNBOUNDED PRECEDING) AS passed FROM g JOIN events e ON epoch_us(e.ts) >= ws AND epoch_us(e.ts) < we)"


def ordered_query(name: str, functions: dict[str, object], sql: dict[str, str], series: str = "value"):
    """Functions of the values in order, over tumbling windows of half a day that are never empty."""

    def run(spark, d):
        fc = FeatureCollection([FeatureDescriptor(f if isinstance(f, FuncWrapper) else FuncWrapper(f, n), series, "12h", "12h") for n, f in functions.items()])
        out = fc.calculate(events(spark, d), return_df=True, approve_sparsity=True)
        return renamed(out, 5, ts="ts", **{n: f"value__{n}__w=12h" for n in functions})

    run.__name__ = name
    query(f"{ORDERED} SELECT make_timestamp(we) AS ts, {', '.join(f'round({x}, 5) AS {n}' if not x.startswith('=') else f'{x[1:]} AS {n}' for n, x in sql.items())} FROM m GROUP BY we")(run)


ordered_query(
    "slopes_and_ends",
    {"slope": "slope", "relative": "relative_slope", "mean_diff": "mean_diff", "first": "first", "last": "last", "least_gap": "min_time_diff", "auc": "auc"},
    {"slope": "regr_slope(v, k)", "relative": "CASE WHEN arg_min(v, k) = 0 THEN 0 ELSE (arg_max(v, k) - arg_min(v, k)) / arg_min(v, k) END", "mean_diff": "avg(v - p)", "first": "arg_min(v, k)", "last": "arg_max(v, k)", "least_gap": "min(dt) / 1e6", "auc": "sum((v + p) / 2 * dt / 1e6)"},
)
ordered_query(
    "change_statistics",
    {"cid_ce": "cid_ce", "changes": "sum_abs_diff", "larger": "variance_larger_than_std", "crossings": "zero_cross", "unique_values": "n_unique", "iqr": "iqr"},
    {"cid_ce": "sqrt(sum((v - p) * (v - p)))", "changes": "sum(abs(v - p))", "larger": "=(var_pop(v) > stddev_pop(v))::DOUBLE", "crossings": "=(count(*) FILTER (sign(v) <> sign(p)))::INT", "unique_values": "=count(DISTINCT v)", "iqr": "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"},
)
ordered_query(
    "order_statistics",
    {"autocorrelation": FuncWrapper("autocorrelation", "autocorrelation", lag=1), "peaks": FuncWrapper("peaks", "peaks", n=1), "half_mass": FuncWrapper("index_mass_quantile", "half_mass", q=0.5)},
    {"autocorrelation": "sum((v - mean) * (p - mean)) / (count(*) - 1) / var_pop(v)", "peaks": "=(count(*) FILTER (v > p AND v > q))::INT", "half_mass": "(min(k) FILTER (passed >= 0.5 * mass) + 1) / max(n)"},
)


@query(f"WITH {grid_sql(12 * H, [12 * H])}, r AS (SELECT we, round(value / 10) AS v FROM g JOIN events e ON epoch_us(e.ts) >= ws AND epoch_us(e.ts) < we), s AS (SELECT we, v, count(*) AS c, sum(count(*)) OVER (PARTITION BY we) AS n, count(*) OVER (PARTITION BY we) AS k FROM r GROUP BY we, v), h AS (SELECT we, CASE WHEN v < 2 THEN 0 WHEN v < 4 THEN 1 WHEN v < 6 THEN 2 ELSE 3 END AS bin, v FROM r WHERE v BETWEEN 0 AND 8) SELECT make_timestamp(we) AS ts, round(CASE WHEN max(k) > 1 THEN -sum(c / n * log2(c / n)) / log2(max(k)) ELSE 0 END, 6) AS entropy, (SELECT count(*) FROM h WHERE h.we = s.we AND bin = 0) AS b0, (SELECT count(*) FROM h WHERE h.we = s.we AND bin = 1) AS b1, (SELECT count(*) FROM h WHERE h.we = s.we AND bin = 2) AS b2, (SELECT count(*) FROM h WHERE h.we = s.we AND bin = 3) AS b3 FROM s GROUP BY we")
def entropy_and_histogram(spark, d):
    df = table(spark, d, "events").select("ts", F.round(F.col("value") / 10).alias("v"))
    fc = FeatureCollection([FeatureDescriptor("value_entropy", "v", "12h", "12h"), FeatureDescriptor(FuncWrapper("histogram", bins=4, low=0.0, high=8.0), "v", "12h", "12h")])
    return renamed(fc.calculate(df, return_df=True, approve_sparsity=True), ts="ts", entropy="v__value_entropy__w=12h", **{f"b{k}": f"v__histogram_{k}__w=12h" for k in range(4)})


@query(f"WITH {grid_sql(24 * H, [24 * H])}, r AS (SELECT we, value AS v, min(value) OVER (PARTITION BY we) AS lo, max(value) OVER (PARTITION BY we) AS hi, count(*) OVER (PARTITION BY we) AS n FROM g JOIN events e ON epoch_us(e.ts) >= ws AND epoch_us(e.ts) < we), s AS (SELECT we, least(floor((v - lo) / (hi - lo) * 10), 9) AS bin, count(*) / max(n) AS p FROM r GROUP BY 1, 2) SELECT make_timestamp(we) AS ts, round(-sum(p * ln(p)), 6) AS entropy FROM s GROUP BY we")
def binned_entropy(spark, d):
    out = one("binned_entropy", "value", "1D", "1D").calculate(events(spark, d), return_df=True, approve_sparsity=True)
    return renamed(out, ts="ts", entropy="value__binned_entropy__w=1D")


@query(hop_sql("hour(max(e.ts)) AS hour_of, minute(max(e.ts)) AS minute_of, (dayofweek(max(e.ts)) + 6) % 7 AS day_of", 12 * H, [12 * H]).replace("AS day_of", "::INT AS day_of").replace("hour(max(e.ts)) AS", "hour(max(e.ts))::INT AS").replace("minute(max(e.ts)) AS", "minute(max(e.ts))::INT AS"))
def calendar_of_last(spark, d):
    df = table(spark, d, "events").select("ts", F.col("ts").alias("seen"))
    fc = FeatureCollection(MultipleFeatureDescriptors(["hour_of_last", "minute_of_last", "weekday_of_last"], "seen", "12h", "12h"))
    out = fc.calculate(df, return_df=True, index="ts", approve_sparsity=True)
    out = renamed(out, ts="ts", hour_of="seen__hour_of_last__w=12h", minute_of="seen__minute_of_last__w=12h", day_of="seen__weekday_of_last__w=12h")
    return out.withColumns({c: F.col(c).cast("int") for c in ("hour_of", "minute_of", "day_of")})


@query(f"WITH {grid_sql(24 * H, [24 * H])}, m AS (SELECT we, value AS v, (epoch_us(e.ts) - min(epoch_us(e.ts)) OVER (PARTITION BY we)) / 3.6e9 AS x FROM g JOIN events e ON epoch_us(e.ts) >= ws AND epoch_us(e.ts) < we) SELECT make_timestamp(we) AS ts, round(regr_slope(v, x), 3) AS slope, round(regr_intercept(v, x), 2) AS intercept FROM m GROUP BY we")
def trend_from_first_sample(spark, d):
    out = one("trend", "value", "1D", "1D").calculate(events(spark, d), return_df=True, approve_sparsity=True)
    out = renamed(out, ts="ts", slope="value__slope__w=1D", intercept="value__intercept__w=1D")
    return out.withColumns({"slope": F.round("slope", 3), "intercept": F.round("intercept", 2)})


@query("SELECT ((i + 1) * 64)::BIGINT AS k, 8.0 AS main, round((8 * 3 + 20 * 1) / 4.0, 4) AS centre, round(9 / 10.0, 4) AS low_band FROM range(0, 7) r(i)")
def spectral_functions(spark, d):
    """Two waves of known frequency and height, sampled 64 times a second."""
    t = F.col("id") / 64.0
    df = spark.range(512).select(F.col("id").alias("k"), (3 * F.sin(2 * np.pi * 8 * t) + F.sin(2 * np.pi * 20 * t)).alias("v"))
    made = [FuncWrapper(spectral.fundamental_frequency, "main", fs=64.0), FuncWrapper(spectral.spectral_centroid, "centre", fs=64.0), FuncWrapper(spectral.band_power, "low_band", low=1.0, high=10.0, fs=64.0)]
    out = FeatureCollection([FeatureDescriptor(f, "v", 64, 64) for f in made]).calculate(df, return_df=True, index="k")
    return renamed(out, 4, k="k", main="v__main__w=64", centre="v__centre__w=64", low_band="v__low_band__w=64")


# -- adapters -----------------------------------------------------------------


def bins(x):
    return np.stack([(x < 50).sum(axis=1), (x >= 50).sum(axis=1)], axis=1)


bins.bins = 2


class Calculators:
    """Functions in the shapes that feature packages have."""

    @staticmethod
    def calc_max(x):
        return float(x.max()) if len(x) else -1.0

    @staticmethod
    def ecdf(x, d=2):
        return tuple(float(k) for k in np.sort(x)[:d])

    @staticmethod
    def quantiles(x, percentile="[0.5]"):
        return tuple(float(np.quantile(x, q)) for q in (0.25, 0.75))

    @staticmethod
    def abs_energy(x):
        return float((np.asarray(x) ** 2).sum())

    @staticmethod
    def large(x, t=0):
        return int((np.asarray(x) > t).sum())

    @staticmethod
    def lags(x, param):
        return [(f"lag_{p['lag']}", float(np.asarray(x)[p["lag"]])) for p in param]


Calculators.lags.fctype = "combiner"


def all_features(values):
    return {"names": ["n", "top"], "values": [len(values), max(values)]}


def adapted(spark, d, wrappers, names: dict[str, str]) -> DataFrame:
    out = FeatureCollection([FeatureDescriptor(w, "value", "1D", "1D") for w in wrappers]).calculate(events(spark, d), return_df=True, approve_sparsity=True)
    return renamed(out, 5, ts="ts", **{k: f"value__{v}__w=1D" for k, v in names.items()})


@query(hop_sql("count(*) FILTER (value < 50)::DOUBLE AS low, count(*) FILTER (value >= 50)::DOUBLE AS high, round(avg(value), 5) AS average", 24 * H, [24 * H]))
def adapter_of_stacked_functions(spark, d):
    wrappers = [adapters.seglearn_wrapper(bins), *adapters.seglearn_feature_dict_wrapper({"average": lambda x: x.mean(axis=1)})]
    return adapted(spark, d, wrappers, {"low": "bins_bin1", "high": "bins_bin2", "average": "average"})


@query(hop_sql("round(max(value), 5) AS most, round(min(value), 5) AS least, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.75), 5) AS q75", 24 * H, [24 * H]))
def adapter_of_configured_functions(spark, d):
    config = {"statistical": {"Max": {"function": "x.calc_max", "n_features": 1, "parameters": "", "use": "yes"}, "Skipped": {"function": "x.calc_max", "n_features": 1, "use": "no"}}, "other": {"ECDF": {"function": "x.ecdf", "n_features": "d", "parameters": {"d": 2}}, "Q": {"function": "x.quantiles", "n_features": "percentile", "parameters": {"percentile": "[0.25, 0.75]"}}}}
    wrappers = adapters.tsfel_feature_dict_wrapper(config, Calculators)
    return adapted(spark, d, wrappers, {"most": "calc_max", "least": "ecdf_1", "q25": "quantiles_percentile=0.25", "q75": "quantiles_percentile=0.75"})


@query(hop_sql("round(sum(value * value), 4) AS energy, count(*) FILTER (value > 50)::DOUBLE AS over50, round(list(value ORDER BY e.ts)[2], 5) AS second, round(list(value ORDER BY e.ts)[4], 5) AS fourth", 24 * H, [24 * H]))
def adapter_of_settings(spark, d):
    wrappers = adapters.tsfresh_settings_wrapper({"abs_energy": None, "large": [{"t": 50}], "lags": [{"lag": 1}, {"lag": 3}]}, Calculators)
    out = adapted(spark, d, wrappers, {"energy": "abs_energy", "over50": "large_{'t': 50}", "second": "lags_{'lag': 1}", "fourth": "lags_{'lag': 3}"})
    return out.withColumn("energy", F.round("energy", 4))


@query(hop_sql("count(*)::DOUBLE AS n, round(max(value), 5) AS top", 24 * H, [24 * H]))
def adapter_of_one_call(spark, d):
    return adapted(spark, d, [adapters.catch22_wrapper(all_features)], {"n": "n", "top": "top"})


# -- joins, sets, shifts ------------------------------------------------------


@query("WITH f AS (SELECT date_trunc('day', ts) AS day, sum(value) AS total FROM events GROUP BY 1) SELECT day, round(total, 4) AS total, dayofmonth(day) AS label FROM f WHERE dayofmonth(day) % 2 = 0")
def join_labels(spark, d):
    days = events(spark, d).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))
    labels = days.select("day", F.dayofmonth("day").cast("long").alias("label")).where("label % 2 = 0")
    return join_on_index(days, labels, ["day"])


@query("WITH f AS (SELECT date_trunc('day', ts) AS day, sum(value) AS total FROM events GROUP BY 1) SELECT day, round(total, 4) AS total, CASE WHEN dayofmonth(day) % 2 = 0 THEN dayofmonth(day) END AS label FROM f")
def join_target(spark, d):
    days = events(spark, d).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))
    target = days.select("day", F.dayofmonth("day").cast("long").alias("label")).where("label % 2 = 0")
    return join_on_index(days, target, ["day"], "left")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'first' ELSE 'second' END AS origin FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0")
def concatenate_rows(spark, d):
    df = table(spark, d, "events").select("event_id")
    return concat_rows([df.where("event_id % 3 = 0").withColumn("origin", F.lit("first")), df.where("event_id % 2 = 0").withColumn("origin", F.lit("second"))], ["event_id"])


@query("SELECT ts, round(lag(value, 2) OVER (ORDER BY ts), 6) AS before, round(lead(value, 1) OVER (ORDER BY ts), 6) AS after FROM events")
def process_shift_rows(spark, d):
    pipe = SeriesPipeline([SeriesProcessor(P.shift_rows, "value", steps=2, name="before"), SeriesProcessor(P.shift_rows, "value", steps=-1, name="after")])
    out = pipe.process(events(spark, d), return_df=True, return_all_series=False)
    return out.select("ts", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("SELECT user_id % 4 AS entity, ts, round(value - lag(value) OVER (PARTITION BY user_id % 4 ORDER BY ts), 6) AS value FROM events")
def process_difference_by_key(spark, d):
    df = table(spark, d, "events").select((F.col("user_id") % 4).alias("entity"), "ts", "value")
    out = SeriesPipeline([SeriesProcessor(P.difference, "value")]).process(df, return_df=True, index="ts", keys=["entity"])
    return out.select("entity", "ts", F.round("value", 6).alias("value"))


# -- processors ---------------------------------------------------------------


def pandas_steps(spark, d, *steps, names: list[str], **kwargs) -> DataFrame:
    out = SeriesPipeline(steps).process(events(spark, d), return_df=True, **kwargs)
    assert sorted(c for c in out.columns if c != "ts") == sorted(names), out.columns
    return out.select("ts", *[F.round(n, 6).alias(n) for n in names])


@query("SELECT ts, round(value, 6) AS value, round(value * 2, 6) AS doubled FROM events")
def process_named_series(spark, d):
    """A series of a new name is added, the input stays."""
    return pandas_steps(spark, d, SeriesProcessor(lambda s: (s * 2).rename("doubled"), "value"), names=["value", "doubled"])


@query("SELECT ts, round(value + 1, 6) AS value FROM events")
def process_unnamed_series(spark, d):
    return pandas_steps(spark, d, SeriesProcessor(lambda s: pd.Series(s.to_numpy() + 1, index=s.index), "value"), names=["value"])


@query("SELECT ts, round(value * 3, 6) AS value FROM events")
def process_array(spark, d):
    return pandas_steps(spark, d, SeriesProcessor(lambda s: s.to_numpy() * 3, "value"), names=["value"])


@query("SELECT ts, round(value, 6) AS value, round(-value, 6) AS minus, round(value / 2, 6) AS half FROM events")
def process_series_list(spark, d):
    return pandas_steps(spark, d, SeriesProcessor(lambda s: [(-s).rename("minus"), (s / 2).rename("half")], "value"), names=["value", "minus", "half"])


@query("SELECT ts, round(value * 10, 6) AS value, round(value + 5, 6) AS more FROM events")
def process_frame(spark, d):
    """A frame replaces the columns it names and adds the others."""
    return pandas_steps(spark, d, SeriesProcessor(lambda s: pd.DataFrame({"value": s * 10, "more": s + 5}), "value"), names=["value", "more"])


@query("SELECT user_id % 4 AS entity, ts, round(value - avg(value) OVER (PARTITION BY user_id % 4), 5) AS centred FROM events")
def process_pandas_by_key(spark, d):
    df = table(spark, d, "events").select((F.col("user_id") % 4).alias("entity"), "ts", "value")
    pipe = SeriesPipeline([SeriesProcessor(lambda s: (s - s.mean()).rename("centred"), "value", output_names=["centred"])])
    out = pipe.process(df, return_df=True, return_all_series=False, index="ts", keys=["entity"])
    return out.select("entity", "ts", F.round("centred", 5).alias("centred"))


@query("SELECT ts, round((abs(value - 50) + 1) * 2, 6) AS value FROM events")
def nested_pipelines(spark, d):
    """Pipelines within pipelines, steps appended and inserted."""
    pipe = SeriesPipeline([SeriesPipeline([SeriesProcessor(P.absolute, "value")])])
    pipe.insert(0, SeriesProcessor(P.shift_by, "value", offset=-50.0))
    pipe.append(SeriesPipeline([SeriesProcessor(P.shift_by, "value", offset=1.0), SeriesProcessor(lambda s: s * 2, "value", output_names=["value"])]))
    assert [s.name for s in pipe.steps][:3] == ["shift_by", "absolute", "shift_by"]
    return pandas_steps(spark, d, pipe, names=["value"])


@query("SELECT ts, round(try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE value::VARCHAR END AS DOUBLE), 6) AS value FROM events")
def process_to_numeric(spark, d):
    df = table(spark, d, "events").select("ts", F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("value").cast("string")).alias("value"))
    return SeriesPipeline([SeriesProcessor(P.to_numeric, "value")]).process(df, return_df=True, index="ts").select("ts", F.round("value", 6).alias("value"))


@query("SELECT ts, round(CASE WHEN count(*) OVER w = 5 THEN -3.0/35*first_value(value) OVER w + 12.0/35*nth_value(value, 2) OVER w + 17.0/35*nth_value(value, 3) OVER w + 12.0/35*nth_value(value, 4) OVER w - 3.0/35*last_value(value) OVER w ELSE value END, 6) AS value FROM events WINDOW w AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def process_smooth(spark, d):
    pipe = SeriesPipeline([SeriesProcessor(P.fir, "value", taps=P.savgol_taps(5, 2))])
    return pipe.process(events(spark, d), return_df=True).select("ts", F.round("value", 6).alias("value"))


# -- chunks -------------------------------------------------------------------


@query("SELECT * FROM (VALUES (0::BIGINT, 'a', 40::BIGINT), (0, 'b', 79), (1, 'a', 60), (2, 'b', 118)) v(chunk_id, series, n)")
def chunks_of_two_series(spark, d):
    """Ranges within the margin share an id, by the series that came first; others are new."""
    a = seconds(spark, 110, "a", skip=tuple(range(40, 50)))
    b = seconds(spark, 240, "b").select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("b") / 2)).alias("ts"), "b").where("not (b between 79 and 121)")
    out = chunk_data([a, b], {"a": 1, "b": 2}, chunk_range_margin=2)
    return out.groupBy("chunk_id", "series").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'a', 100::BIGINT), (0, 'b', 100), (1, 'c', 50)) v(chunk_id, series, n)")
def chunks_of_a_dict(spark, d):
    """A dict of frames gives all columns of a frame its rate; the margin is two periods of the slowest."""
    both = seconds(spark, 100, "a").withColumn("b", -F.col("a"))
    out = chunk_data({"fast": both, "slow": seconds(spark, 50, "c", 10)}, {"fast": 1, "slow": 0.1})
    return out.groupBy("chunk_id", "series").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS chunk_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def chunks_without_rate(spark, d):
    """Without a rate the longest step is the period, so nothing is a gap."""
    out = chunk_data(events(spark, d), chunk_range_margin="1s", copy=False)
    return out.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "WITH p AS (SELECT user_id % 3 AS entity, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS step, max(epoch_us(ts)) OVER (PARTITION BY user_id % 3) AS z FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts)), r AS (SELECT *, sum(CASE WHEN step > 900000000 AND t < z THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t) AS run FROM p), m AS (SELECT entity, run, min(t) AS b, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 2) SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY b) - 1 AS chunk_id, n FROM m"
)
def chunks_by_key(spark, d):
    df = table(spark, d, "events").select((F.col("user_id") % 3).alias("entity"), "ts", "value")
    out = chunk_data(df, {"value": 1 / 600}, chunk_range_margin=1e-6, index="ts", keys=["entity"])
    return out.groupBy("entity", "chunk_id").agg(F.count(F.lit(1)).alias("n"))


@query(RUNS_SQL + ", c AS (SELECT *, row_number() OVER (ORDER BY b) - 1 AS chunk_id FROM m) SELECT chunk_id, n FROM c WHERE chunk_id <> 7")
def failing_chunks(spark, d):
    """A chunk whose function fails prints its trace and gives no rows."""
    chunks = chunk_data(events(spark, d), {"value": CHUNK_FS}, chunk_range_margin=1e-6)
    schema = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("n", T.LongType())])

    def sized(pdf):
        if pdf.chunk_id.iloc[0] == 7:
            raise ValueError("planned")
        return pd.DataFrame({"chunk_id": [pdf.chunk_id.iloc[0]], "n": [len(pdf)]})

    return process_chunks(chunks, sized, schema)


# -- registry, contracts, helpers --------------------------------------------

REGISTRY = [
    ("required", "['a', 'b']"),
    ("outputs", 8),
    ("outputs without window", 4),
    ("reduced", 1),
    ("reduced columns", "['a__sum__w=4']"),
    ("after union", 9),
    ("strides sorted", "(2, 6)"),
    ("pairs", 2),
    ("columns", "['a|b__dot__w=4']"),
    ("repr", "a|b: (\n\twin: 4     : [\n\t\tFeatureDescriptor - func: FuncWrapper(dot, ['dot'], {})    stride: ['2'],\n\t]\n)\n"),
    ("name of a function", "mean"),
    ("name of a partial", "mean"),
    ("name of an object", "Named"),
    ("call of a wrapper", 6.0),
    ("default outputs", "('quantile_0.1', 'quantile_0.9')"),
]


@query(facts_sql(REGISTRY))
def registry(spark, d):
    import functools

    class Named:
        def __call__(self, x):
            return 0.0

    fc = FeatureCollection(MultipleFeatureDescriptors(["sum", "max"], ["a", "b"], [4, 8], 2))
    small = fc.reduce(["a__sum__w=4"])
    both = FeatureCollection([fc, FeatureDescriptor("min", "a", 4, 2)])
    return facts(
        spark,
        [
            ("required", sorted(fc.get_required_series())),
            ("outputs", fc.get_nb_output_features()),
            ("outputs without window", fc._get_nb_output_features_without_window()),
            ("reduced", small.get_nb_output_features()),
            ("reduced columns", [c for x in small.descriptors() for c in x.columns("4")]),
            ("after union", both.get_nb_output_features()),
            ("strides sorted", FeatureDescriptor("sum", "a", 4, [6, 2, 6]).strides),
            ("pairs", len(MultipleFeatureDescriptors("dot", [("a", "b"), ("b", "c")], 4, [2, 3]).feature_descriptions)),
            ("columns", FeatureDescriptor("dot", ("a", "b"), 4, 2).columns("4")),
            ("repr", repr(FeatureCollection(FeatureDescriptor("dot", ("a", "b"), 4, 2)))),
            ("name of a function", name_of(np.mean)),
            ("name of a partial", name_of(functools.partial(np.mean, axis=0))),
            ("name of an object", name_of(Named())),
            ("call of a wrapper", FuncWrapper(lambda x, k: float(sum(x) * k), "s", k=2)([1, 2])),
            ("default outputs", FuncWrapper("quantile", q=[0.1, 0.9]).output_names),
        ],
    )


ERRORS = [
    ("data of no kind", "AssertionError"),
    ("no window", "AssertionError"),
    ("no stride", "AssertionError"),
    ("stride and segments", "ValueError"),
    ("several windows with segments", "AssertionError"),
    ("segments of unequal number", "AssertionError"),
    ("segments that end before they start", "AssertionError"),
    ("segments of a table that end before they start", "AssertionError"),
    ("unknown bounds", "ValueError"),
    ("unknown place", "ValueError"),
    ("time windows on numbers", "ValueError"),
    ("an output twice", "AssertionError"),
    ("a foreign descriptor", "TypeError"),
    ("a stride without window", "AssertionError"),
    ("mixed window and stride", "TypeError"),
    ("no function", "TypeError"),
    ("no unit", "ValueError"),
    ("a time of no kind", "TypeError"),
    ("names of no kind", "TypeError"),
    ("vectorised series", "AssertionError"),
    ("vectorised unequal windows", "AssertionError"),
    ("vectorised unequal steps", "AssertionError"),
    ("unknown column", "AssertionError"),
    ("both groupings", "AssertionError"),
    ("group is a series", "AssertionError"),
    ("group named start", "AssertionError"),
    ("jobs of no kind", "AssertionError"),
    ("foreign step", "TypeError"),
    ("missing series", "ProcessingError"),
    ("failing function", "ProcessingError"),
    ("output of no kind", "ProcessingError"),
    ("an output of two tuples", "ProcessingError"),
    ("tuples of unequal size", "AssertionError"),
    ("no time index", "AssertionError"),
    ("chunks without rate and margin", "ValueError"),
    ("chunks by number", "NotImplementedError"),
    ("chunks of equal names", "AssertionError"),
    ("writing to a window", "PythonException"),
    ("writing to a window's series", "PythonException"),
    ("writing to a stack of windows", "PythonException"),
    ("wrong number of outputs", "PythonException"),
]


@query(facts_sql(ERRORS))
def error_contract(spark, d):
    df = spark.range(20).select("id", F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    at = seconds(spark, 30)
    run = lambda f, data=df, **k: lambda: f.calculate(data, return_df=True, checks=False, **({"index": "id"} if data is df else {}) | k)
    total, bare = one("sum", "v", 4, 2), one("sum", "v", None)
    stacked = one(FuncWrapper(np.mean, "m", vectorized=True, axis=1), "v", 4, [2, 3])
    pipe = lambda f, names="v", **k: lambda: SeriesPipeline([SeriesProcessor(f, names, **k)]).process(at)
    cuts = spark.createDataFrame([(3, 1)], "start long, end long")

    def writes(x):
        x[0] = 1
        return 0.0

    def writes_series(x):
        x.iloc[0] = 1
        return 0.0

    def writes_stack(x):
        x[0, 0] = 1
        return x.sum(axis=1)

    calls = {
        "data of no kind": lambda: total.calculate("x"),
        "no window": run(bare),
        "no stride": run(one("sum", "v", 4)),
        "stride and segments": run(total, stride=2, segment_start_idxs=[1]),
        "several windows with segments": run(FeatureCollection(MultipleFeatureDescriptors("sum", "v", [4, 8], 2)), segment_start_idxs=[1], segment_end_idxs=[2]),
        "segments of unequal number": run(bare, segment_start_idxs=[1, 2], segment_end_idxs=[2]),
        "segments that end before they start": run(bare, segment_start_idxs=[3], segment_end_idxs=[2]),
        "segments of a table that end before they start": run(bare, segments=cuts),
        "unknown bounds": run(total, bound_method="middle"),
        "unknown place": run(total, window_idx="centre"),
        "time windows on numbers": run(one("sum", "v", "4s", "2s")),
        "an output twice": lambda: FeatureCollection([FeatureDescriptor("sum", "v", 4, 2), FeatureDescriptor("sum", "v", 4, 3)]),
        "a foreign descriptor": lambda: FeatureCollection("sum"),
        "a stride without window": lambda: FeatureDescriptor("sum", "v", None, 2),
        "mixed window and stride": lambda: FeatureDescriptor("sum", "v", "4s", 2),
        "no function": lambda: FeatureDescriptor(3, "v", 4, 2),
        "no unit": lambda: FeatureDescriptor("sum", "v", "4", "2"),
        "a time of no kind": lambda: timeargs.parse_time(3),
        "names of no kind": lambda: FuncWrapper(len, 3),
        "vectorised series": lambda: FuncWrapper(len, "n", input_type=pd.Series, vectorized=True),
        "vectorised unequal windows": run(one(FuncWrapper(np.mean, "m", vectorized=True, axis=1), "v", 6, 6), include_final_window=True),
        "vectorised unequal steps": run(stacked),
        "unknown column": lambda: total.reduce(["w__sum__w=4"]),
        "both groupings": run(bare, group_by_all="g", group_by_consecutive="g"),
        "group is a series": run(bare, group_by_all="v"),
        "group named start": run(bare, data=df.withColumnRenamed("g", "start"), group_by_consecutive="start", index="id"),
        "jobs of no kind": run(total, n_jobs="2"),
        "foreign step": lambda: SeriesPipeline(["x"]),
        "missing series": pipe(P.absolute, "w"),
        "failing function": pipe(lambda s: s / 0 if False else [][1]),
        "output of no kind": pipe(lambda s: "text"),
        "an output of two tuples": lambda: SeriesPipeline([SeriesProcessor(lambda a, b: (a + b).rename("c"), [("v", "w"), ("w", "v")])]).process(at.withColumn("w", F.col("v"))),
        "tuples of unequal size": lambda: SeriesProcessor(P.absolute, ["v", ("v", "w")]),
        "no time index": lambda: SeriesPipeline([SeriesProcessor(P.absolute, "v")]).process(df.select("id", "v"), index="id"),
        "chunks without rate and margin": lambda: chunk_data(at),
        "chunks by number": lambda: chunk_data(df.select("id", "v"), {"v": 1}, index="id"),
        "chunks of equal names": lambda: chunk_data({"a": at, "b": at}, {"a": 1, "b": 1}),
        "writing to a window": lambda: one(FuncWrapper(writes, "w"), "v", 4, 4).calculate(df, return_df=True, index="id", checks=False).count(),
        "writing to a window's series": lambda: one(FuncWrapper(writes_series, "w", input_type=pd.Series), "v", 4, 4).calculate(df, return_df=True, index="id", checks=False).count(),
        "writing to a stack of windows": lambda: one(FuncWrapper(writes_stack, "w", vectorized=True), "v", 4, 4).calculate(df, return_df=True, index="id", checks=False).count(),
        "wrong number of outputs": lambda: one(FuncWrapper(lambda x: (1.0, 2.0), "w"), "v", 4, 4).calculate(df, return_df=True, index="id", checks=False).count(),
    }
    return facts(spark, [(name, raised(calls[name])) for name, _ in ERRORS])


WARNINGS = [
    ("gaps", "RuntimeWarning"),
    ("gaps, approved", "none"),
    ("no gaps", "none"),
    ("segments out of range", "RuntimeWarning"),
    ("segments in range", "none"),
    ("rows without group", "RuntimeWarning"),
    ("unsorted pandas index", "RuntimeWarning"),
    ("both kinds of windows", "RuntimeWarning"),
    ("grouping with a stride", "UserWarning"),
    ("a log that exists", "RuntimeWarning"),
]


@query(facts_sql(WARNINGS))
def warning_contract(spark, d):
    df, gaps = seconds(spark, 60), seconds(spark, 60, skip=(20, 21, 22))
    fc, bare = one("sum", "v", "10s", "5s"), one("sum", "v", None)
    grouped = df.withColumn("g", F.when(F.col("v") > 3, "x"))
    path = str(Path(tempfile.mkdtemp(prefix="tidemark-log-")) / "x.log")
    Path(path).write_text("earlier\n")
    day = pd.Timestamp("2024-01-01")
    calls = {
        "gaps": lambda: fc.calculate(gaps),
        "gaps, approved": lambda: fc.calculate(gaps, approve_sparsity=True),
        "no gaps": lambda: fc.calculate(df),
        "segments out of range": lambda: one("sum", "v", "10s").calculate(df, segment_start_idxs=[day + pd.Timedelta("1h")]),
        "segments in range": lambda: one("sum", "v", "10s").calculate(df, segment_start_idxs=[day + pd.Timedelta("10s")]),
        "rows without group": lambda: bare.calculate(grouped, group_by_all="g"),
        "unsorted pandas index": lambda: SeriesSet.of(pd.Series([1.0, 2.0], index=pd.Index([2, 1], name="k"), name="v"), spark=spark),
        "both kinds of windows": lambda: FeatureCollection([FeatureDescriptor("sum", "v", "10s", "5s"), FeatureDescriptor("sum", "v", 10, 5)]),
        "grouping with a stride": lambda: bare.calculate(grouped.dropna(), group_by_all="g", stride="5s"),
        "a log that exists": lambda: metrics.add_logging_handler(logging.getLogger("tidemark.catalogue"), path),
    }
    return facts(spark, [(name, warned(calls[name])) for name, _ in WARNINGS])


HELPERS = [
    ("15 days", "15D"),
    ("90 minutes", "1h30m"),
    ("7500 ms", "7.5s"),
    ("30 ms", "0.03s"),
    ("below zero", "NEG_2h"),
    ("day and hours", "1D_2h"),
    ("timedelta", 90_000_000),
    ("number", 4),
    ("label of a number", "4"),
    ("kind of a time", "time"),
    ("kind of a number", "sequence"),
    ("tuple of a text", "('a',)"),
    ("flat", "[1, 2, 3, 4]"),
    ("no handlers left", 0),
]


@query(facts_sql(HELPERS))
def helpers(spark, d):
    logger = logging.getLogger("tidemark.catalogue.helpers")
    logger.addHandler(logging.NullHandler())
    metrics.delete_logging_handlers(logger)
    short = lambda text: timeargs.short(timeargs.parse_time(text))
    return facts(
        spark,
        [
            ("15 days", short("15 days")),
            ("90 minutes", short("90min")),
            ("7500 ms", short("7500ms")),
            ("30 ms", short("30ms")),
            ("below zero", short("-2h")),
            ("day and hours", short("26h")),
            ("timedelta", timeargs.parse(pd.Timedelta(dt.timedelta(seconds=90)))),
            ("number", timeargs.parse(4)),
            ("label of a number", timeargs.label(4)),
            ("kind of a time", timeargs.kind_of("4s")),
            ("kind of a number", timeargs.kind_of(2.5)),
            ("tuple of a text", to_tuple("a")),
            ("flat", flatten([1, [2, (3, [4])]])),
            ("no handlers left", len(logger.handlers)),
        ],
    )


@query("SELECT coalesce(a.ts, b.ts, c.ts) AS ts, a.value AS click, b.value AS error, c.value AS view FROM (SELECT * FROM events WHERE event_type = 'click') a FULL JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.ts = b.ts FULL JOIN (SELECT * FROM events WHERE event_type = 'view') c ON c.ts = coalesce(a.ts, b.ts)")
def outer_merge_of_three(spark, d):
    return outer_merge(list(kinds(spark, d, "click", "error", "view").values()))
