"""Execution logs: one line per feature function or processor, and tables over them."""

from __future__ import annotations

import logging
import warnings
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import timeargs

FORMAT = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"


def delete_logging_handlers(logger: logging.Logger) -> None:
    for h in list(logger.handlers):
        h.close()
        logger.removeHandler(h)


def add_logging_handler(logger: logging.Logger, path) -> None:
    """A file handler; an existing file is emptied, with a warning."""
    if Path(path).exists() and Path(path).stat().st_size:
        warnings.warn(f"log file {path} already exists and is emptied", RuntimeWarning, stacklevel=2)
    delete_logging_handlers(logger)
    handler = logging.FileHandler(path, mode="w")
    handler.setFormatter(logging.Formatter(FORMAT))
    logger.setLevel(logging.INFO)
    logger.addHandler(handler)


def log_group(path, descriptors, stride, seconds: list[float]) -> None:
    """Feature functions of one call with the time that each took by itself."""
    logger = logging.getLogger("tidemark.features")
    add_logging_handler(logger, path)
    for d, took in zip(descriptors, seconds, strict=True):
        window = "manual" if d.window is None else timeargs.label(d.window)
        strides = stride if stride is not None else d.stride
        logger.info(f"[{d.function.native or d.function.output_names[0]}] on {list(d.series_name)} with window-stride [{window}, {strides}] with output {list(d.function.output_names)} finished in [{took} seconds]!")
    delete_logging_handlers(logger)


def log_lines(spark: SparkSession, path) -> DataFrame:
    """Log lines as log_time, name, level, message."""
    parts = F.split("value", " - ", 4)
    return spark.read.text(str(path)).select(F.to_timestamp(parts[0], "yyyy-MM-dd HH:mm:ss,SSS").alias("log_time"), parts[1].alias("name"), parts[2].alias("level"), parts[3].alias("message"))


def _share(df: DataFrame) -> DataFrame:
    whole = df.agg(F.sum("duration")).first()[0] or 1.0
    return df.withColumn("duration_pct", F.round(100 * F.col("duration") / F.lit(whole), 2))


FEATURE = r"\[(.*?)\] on \[(.*?)\] with window-stride \[(.*?), (.*)\] with output \[(.*?)\] finished in \[(.*?) seconds\]!"
PROCESSOR = r"\[(.*?)\] on \[(.*?)\] finished in \[(.*?) seconds\]!"


def get_feature_logs(spark: SparkSession, path) -> DataFrame:
    """log_time, function, series_names, window, stride, output_names, duration, duration_pct."""
    m = lambda i: F.regexp_extract("message", FEATURE, i)
    lines = log_lines(spark, path).where(F.col("message").rlike(FEATURE))
    return _share(lines.select("log_time", m(1).alias("function"), F.replace(m(2), F.lit("'"), F.lit("")).alias("series_names"), m(3).alias("window"), m(4).alias("stride"), F.replace(m(5), F.lit("'"), F.lit("")).alias("output_names"), m(6).cast("double").alias("duration")))


def get_processor_logs(spark: SparkSession, path) -> DataFrame:
    m = lambda i: F.regexp_extract("message", PROCESSOR, i)
    lines = log_lines(spark, path).where(F.col("message").rlike(PROCESSOR))
    return _share(lines.select("log_time", m(1).alias("function"), F.replace(m(2), F.lit("'"), F.lit("")).alias("series_names"), m(3).cast("double").alias("duration")))


def _stats(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("duration").alias("sum_duration"), F.avg("duration").alias("mean_duration"), F.stddev("duration").alias("std_duration"), F.count(F.lit(1)).alias("n"), F.sum("duration_pct").alias("sum_pct"), F.avg("duration_pct").alias("mean_pct"))


def get_function_stats(spark: SparkSession, path) -> DataFrame:
    return _stats(get_feature_logs(spark, path), ["function", "window", "stride"]).orderBy(F.desc("mean_duration"))


def get_series_names_stats(spark: SparkSession, path) -> DataFrame:
    return _stats(get_feature_logs(spark, path), ["series_names", "window", "stride"]).orderBy(F.desc("sum_duration"))


def logging_file_to_df(path) -> pd.DataFrame:
    """A (small) log on the driver."""
    rows = [line.rstrip("\n").split(" - ", 3) for line in open(path)]
    out = pd.DataFrame(rows, columns=["log_time", "name", "log_level", "message"])
    return out.assign(log_time=pd.to_datetime(out.log_time, format="%Y-%m-%d %H:%M:%S,%f"))
