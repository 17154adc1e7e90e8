"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_of


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


#: Bytes of text that a sample holds, at most (beyond its first document).
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Callable[[], Column], limit: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``at`` (a fixed order), text and y (0 or 1) of ``limit`` documents and ``most_bytes`` bytes of whole texts at most.

    A hash of the ids chooses; the texts count in its order, and those beyond
    ``most_bytes`` stay out.  ``usable`` says which ids may be learned from.
    Rows without id or label are left out; a document with several labels has
    the larger one, an id with several texts the smallest of them.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    marks = marks.withColumnRenamed("id", id_col).where(usable()).groupBy(id_col).agg(F.max("y").alias("y"))
    chosen = marks.orderBy(F.xxhash64(id_col), id_col).limit(limit).withColumnRenamed(id_col, "sample_id")
    texts = docs.select(F.col(f"`{id_col}`").alias("sample_id"), text_of(text_col).alias("text"))
    # ``limit`` rows of two numbers: a fixed bound for the broadcast, and for the one task that adds up their sizes.
    found = texts.join(F.broadcast(chosen), "sample_id").groupBy("sample_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    order = Window.orderBy(F.xxhash64("sample_id"), "sample_id")
    sizes = found.select("sample_id", F.octet_length("text").alias("n"))
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    kept = sizes.select("sample_id", F.row_number().over(order).alias("at"), (before + F.col("n")).alias("total")).where((F.col("total") <= most_bytes) | (F.col("at") == 1))
    return found.join(F.broadcast(kept), "sample_id").select("at", "text", "y")
