"""Scratch tables in the folder that the cluster shares, and small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, fresh_name, ship_package
from ..runtime import write_once as materialize

__all__ = ["discard", "fresh_name", "join_counted", "map_batches", "materialize", "numbered", "sized", "text_batches", "text_of"]


def numbered(df: DataFrame, scratch: str) -> tuple[DataFrame, str]:
    """``df`` written once with a row number, and the number's column name, which ``df`` does not use.

    Written, since numbers that depend on the place of a row must not change if
    a lost executor's work is done again.
    """
    row = fresh_name(df, "row_no")
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), scratch), row


#: Tables of more rows are not joined by broadcast.
BROADCAST_ROWS = 20_000


def sized(table: DataFrame, rows: int) -> DataFrame:
    """``table``, of at most ``rows`` rows, marked for a broadcast if these are few, else for a shuffled join.

    Unmarked, Spark takes the size of compressed files for the memory that a
    broadcast needs on the driver, which can be a small part of it.
    """
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


#: A key with more than one in so many rows is joined by broadcast; there are fewer such keys than this.
SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and in ``count`` how often ``rows`` has it.

    The few keys that many rows share would bring those to one task, so their
    rows of ``table`` go to all tasks instead; all others are shuffled.
    """
    limit = rows.count() // SHARE
    frequent = F.broadcast(table.where(F.col(count) > limit).drop(count))  # fewer than SHARE rows, as counts add up to all rows
    usual = rows.join(frequent.select(key), key, "left_anti").join(sized(table.where(F.col(count) <= limit).drop(count), table.count()), key)
    return rows.join(frequent, key).unionByName(usual)


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def text_batches(batches, size: int = 16 << 20):
    """Split Arrow batches so that a piece has about ``size`` bytes of buffers at most (one row at least)."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, int(rows * size / max(batch.nbytes, 1))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
