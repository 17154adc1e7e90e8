"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition is a leaf: a run of its digests, sorted, with the best
row of each.  In a round, ``fan_in`` runs that lie next to each other exchange
their parts: each is cut into as many slices of digests as runs were merged so
far, and one task gets one slice of all of them, merges the sorted parts by
sort aggregation and writes the merged run.  So after each round a run covers
``fan_in`` times the partitions in as many slices, no task ever holds more than
about what a leaf holds, and a digest that a third of all rows share comes at
most ``fan_in`` times to a merge.  The winners travel down the same tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_name, materialize, numbered, text_of

#: Characters that do not count: space and U+0009 to U+000D.
IGNORED = " \t\n\x0b\x0c\r"
#: What makes texts equal.  The length and the second hash verify the digest at every merge.
KEY = ["digest", "norm_len", "norm_check"]


def normalised(text: Column) -> Column:
    """The text without ignored characters."""
    return F.translate(text, IGNORED, "")


def _digests(docs: DataFrame, id_col: str, text_col: str, row: str | None) -> DataFrame:
    """Narrow rows, written once: id, length, key, the leaf they are in and their number."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"), number.alias("row_no"), F.spark_partition_id().cast("long").alias("run"))
    rows = rows.select("doc_id", "row_no", "run", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "row_no", "run", "n_chars", F.unhex(F.sha2("norm", 256)).alias("digest"), F.length("norm").cast("long").alias("norm_len"), F.xxhash64("norm").alias("norm_check"))
    return materialize(rows, "dedup-digests", sort=KEY)


def _merge(runs: DataFrame, best: Column, n: Column, slices: int, name: str) -> DataFrame:
    """One round: each (run, slice) comes to one task as sorted parts and is written as one sorted run."""
    dealt = runs.withColumn("slice", F.pmod("norm_check", F.lit(slices))).repartition("run", "slice")
    merged = dealt.groupBy("run", "slice", *KEY).agg(F.min(best).alias("best"), F.sum(n).alias("n"))
    return materialize(merged, name, sort=["run", "slice", *KEY])


def decide(docs: DataFrame, id_col: str, text_col: str, fan_in: int = 16, row: str | None = None) -> DataFrame:
    """row_no, doc_id, keep_id, keep_row, group_size and digest of every row; ``row`` names a column of written row numbers."""
    if fan_in < 2:
        raise ValueError("a merge takes two runs or more")
    rows = _digests(docs, id_col, text_col, row)
    last = rows.agg(F.max("run")).first()[0]
    order = F.struct((-F.col("n_chars")).alias("order_chars"), F.col("doc_id").isNull().alias("order_null"), F.col("doc_id").alias("keep_id"), F.col("row_no").alias("keep_row"))
    levels, runs, slices = [_merge(rows, order, F.lit(1).cast("long"), 1, "dedup-runs-0")], (last or 0) + 1, 1
    while runs > 1:
        runs, slices = -(-runs // fan_in), slices * min(fan_in, runs)
        above = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in))
        levels.append(_merge(above, F.col("best"), F.col("n"), slices, f"dedup-runs-{len(levels)}"))
    # Digests that came once in all are decided; the others' winners go down.
    winners = levels[-1].where("n > 1").select(*KEY, "run", F.col("best").alias("win"), F.col("n").alias("group_size"))
    for below in reversed(levels[:-1]):
        child = below.select(*KEY, F.col("run").alias("child"), F.floor(F.col("run") / fan_in).alias("run"))
        winners = child.join(winners, [*KEY, "run"]).select(*KEY, F.col("child").alias("run"), "win", "group_size")
    return rows.join(winners, [*KEY, "run"], "left").select(
        "row_no",
        "doc_id",
        F.when(F.col("win").isNull(), F.col("doc_id")).otherwise(F.col("win.keep_id")).alias("keep_id"),
        F.coalesce("win.keep_row", "row_no").alias("keep_row"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "digest",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of texts equal after dropping ASCII white space, the row with the most code
    points stays, then the smallest id.  Null text counts as empty; a null id
    sorts after all others; of repeated rows with one id exactly one is kept.
    Ids of any type that can be ordered; empty input gives an empty result;
    other columns are ignored.
    """
    out = decide(docs, id_col, text_col, fan_in)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that stay: one of each group, the longest, then of the smallest id.

    Rows are told apart by a written number, so null ids, ids that repeat and
    columns of any name are no matter.  An empty table gives an empty result.
    """
    rows, row = numbered(docs, "dedup-rows")
    mark = fresh_name(rows, "stays")
    stay = decide(rows, id_col, text_col, row=row).where("row_no = keep_row").select(F.col("row_no").alias(mark))
    return rows.join(stay, F.col(f"`{row}`") == F.col(mark), "left_semi").drop(row)
