"""Connected components by contraction, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, sized


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long); root is any one node of the component.

    Each round every root that has a smaller neighbour moves under its smallest
    one (with one pointer jump), and edges inside a tree vanish, so the number
    of roots with edges falls by half at least and rounds grow with the
    logarithm of the component size.  Every round is written to the shared
    folder, which cuts the lineage; what no later round reads is deleted.

    Repeated edges and both directions count once.  Edges with a null end and
    edges from a node to itself say nothing and are left out, so a node that
    has no others is not in the result.  No edges give an empty result.
    """
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = materialize(edges.where("a <> b").select(*pair).distinct(), "cc-edges")
    roots = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "cc-roots")
    while most := left.count():  # a round moves no more roots than there are edges
        up = left.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent"))
        above = up.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
        moves = materialize(up.join(sized(above, most), "parent", "left").select("child", F.coalesce("grand", "parent").alias("parent")), "cc-moves")
        to = lambda c: sized(moves.select(F.col("child").alias(c), F.col("parent").alias(f"{c}_to")), most)  # noqa: E731, B023
        moved = left.join(to("a"), "a", "left").join(to("b"), "b", "left")
        moved = moved.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b")
        before = left, roots
        left = materialize(moved.select(*pair).distinct(), "cc-edges")
        roots = materialize(roots.join(to("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")), "cc-roots")
        discard(*before, moves)
    return roots
