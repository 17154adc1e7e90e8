"""SimHash near-duplicates by a grid join over segment bit counts.

A 64-bit fingerprint maps to the bit counts of its 16 segments of four bits.
Flipping a bit moves one count by one, so fingerprints within Hamming distance
2 lie within Manhattan distance 2 in the grid of counts, and two such cells
share at least one cell at distance 1 or less from both.  Every distinct
fingerprint visits its own cell and the 32 next to it; fingerprints that meet
in a cell are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .shared import fresh_name, join_counted, map_batches, materialize, numbered, sized, text_batches, text_of

SEED = 42
SEGMENTS, WIDTH = 16, 4
MAX_DISTANCE = 2


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included (unsigned)."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    stops = ends[words - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, row: str | None = None) -> DataFrame:
    """doc_id, row_no and fp (the fingerprint as a signed long); null text is empty and has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            prints = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "row_no", "fp"])

    number = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), number.alias("row_no"), text_of(text_col).alias("text"))
    return map_batches(ids, run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, row_no long, fp long")


def cell_of(fp: Column) -> Column:
    """The grid cell: 16 counts of 0 to 4, each in a nibble of a long; the lower 15 are raised by 2 so that steps never borrow."""
    packed = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))).cast("long")
        packed = packed + (count + (2 if i < SEGMENTS - 1 else 0)) * F.lit(1 << (4 * i)).cast("long")
    return packed


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """All pairs a < b of the distinct values of ``fp`` that differ in 1 to ``max_distance`` (2 at most) bits.

    The join is always shuffled: Spark estimates the visits, 33 for each value,
    at a fraction of the size of the file that holds the values, and would bring
    them to the driver for a broadcast.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("the grid of neighbouring cells covers distances up to 2")
    steps = [0, *(s << (4 * i) for i in range(SEGMENTS) for s in (1, -1))]
    at = prints.select("fp", cell_of(F.col("fp")).alias("own"))
    visits = at.select("fp", "own", F.explode(F.array(*[F.col("own") + F.lit(s).cast("long") for s in steps])).alias("cell"))
    a = visits.select("cell", F.col("fp").alias("a"), F.col("own").alias("own_a"))
    b = visits.select("cell", F.col("fp").alias("b"), F.col("own").alias("own_b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    # One meeting cell counts: a's own one if the cells are equal or next to each other, else one between them.
    meet = (F.col("cell") == F.col("own_a")) | ((F.col("cell") != F.col("own_b")) & (F.col("own_a") != F.col("own_b")))
    return a.hint("merge").join(b.hint("merge"), "cell").where((F.col("a") < F.col("b")) & near & meet).select("a", "b").distinct()


def decide(docs: DataFrame, id_col: str, text_col: str, words: int, max_distance: int, row: str | None = None) -> DataFrame:
    """row_no, doc_id, fp and least (its component's smallest id, with the row that has it) of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col, words, row), "simhash-prints")
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("id"), F.col("row_no").alias("row_no"))
    nodes = materialize(prints.groupBy("fp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    # Only prints that link to another one have a root; all others are components by themselves.
    many = roots.count()
    linked = materialize(nodes.select("fp", "least").join(sized(roots, many), "fp"), "simhash-linked")
    first = materialize(linked.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-first")
    moved = join_counted(linked.select("fp", "root"), first, "root", "n").select("fp", "first")
    placed = materialize(nodes.join(sized(moved, many), "fp", "left").select("fp", F.coalesce("first", "least").alias("least"), "n"), "simhash-placed")
    return join_counted(prints, placed, "fp", "n").select("row_no", "doc_id", "fp", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (the smallest id reachable over links).

    Rows with one fingerprint are one node.  Texts without words have
    fingerprint zero and link like any others; null ids stay null and are never
    a component's smallest unless it has no other; repeated rows and ties share
    a component; an empty table gives an empty result; other columns are ignored.
    """
    return decide(docs, id_col, text_col, words, max_distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay: one of each component, of its smallest id.

    Null ids come last, and of rows with one id one stays, since rows are told
    apart by a written number; columns may have any names; an empty table gives
    an empty result.
    """
    rows, row = numbered(docs, "simhash-rows")
    mark = fresh_name(rows, "stays")
    stay = decide(rows, id_col, text_col, words, max_distance, row).where("row_no = least.row_no").select(F.col("row_no").alias(mark))
    return rows.join(stay, F.col(f"`{row}`") == F.col(mark), "left_semi").drop(row)
