"""Nearest neighbours with vantage-point trees per shard.

Largest inner product becomes nearest Euclidean distance by one more dimension
(the root of the largest squared norm minus the own one).  Each shard builds
one tree over its distinct vectors; then all queries stream past it in blocks.
A side is skipped if even its nearest point must be farther than ``factor``
times the current k-th distance: one keeps the search exact, less skips more.

The search works on vectors scaled by a power of two, so squares neither
overflow nor vanish; scores come from the original ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches, materialize

SHARD_ROWS = 16_384
BLOCK_QUERIES = 2_048
LEAF = 512
#: More candidates than wanted, so that rounding in the search cannot change the exact order.
SLACK = 12


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[-1]):
            out += a[..., k] * b[..., k]
    return out


class Tree:
    """A vantage-point tree in arrays over points lifted to one norm; leaves are ranges of ``order``."""

    def __init__(self, points: np.ndarray, top: float | None = None, leaf: int = LEAF, seed: int = 3):
        self.points, self.order = points, np.arange(len(points))
        square = np.einsum("ij,ij->i", points, points)
        self.top = float(square.max(initial=0.0)) if top is None else top
        self.lifted = np.column_stack([points, np.sqrt(np.maximum(self.top - square, 0))])
        self.margin = 1e-7 * math.sqrt(self.top)  # well over the rounding of a distance
        self.nodes: list[tuple] = []
        self.looked = 0  # (query, point) products of all searches
        self.leaf, self.random = leaf, np.random.default_rng(seed)
        self.root = self._build(0, len(points))

    def _build(self, a: int, b: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if b - a > self.leaf:
            own = self.order[a:b]
            vantage = self.lifted[self.random.choice(own)]
            far = np.sqrt(((self.lifted[own] - vantage) ** 2).sum(1))
            half = (b - a) // 2
            split = np.argpartition(far, half)
            self.order[a:b], far = own[split], far[split]
            self.nodes[at] = (vantage, far[:half].max(), far[half:].min(), self._build(a, a + half), self._build(a + half, b))
        else:
            self.nodes[at] = (a, b)
        return at

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Inner products and points of the ``k`` largest, unordered (-inf and -1 where there are fewer)."""
        n = len(queries)
        best, who = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        reach = np.einsum("ij,ij->i", queries, queries) + self.top  # squared distance at product 0
        raised = np.column_stack([queries, np.zeros(n)])
        home = np.full(n, -1)

        def look(node: int, q: np.ndarray) -> None:
            own = self.order[slice(*self.nodes[node])]
            self.looked += len(q) * len(own)
            s = queries[q] @ self.points[own].T
            if s.shape[1] > k:
                pick = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s, own = np.take_along_axis(s, pick, 1), own[pick]
            else:
                own = np.broadcast_to(own, s.shape)
            s, own = np.hstack([best[q], s]), np.hstack([who[q], own])
            pick = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best[q], who[q] = np.take_along_axis(s, pick, 1), np.take_along_axis(own, pick, 1)

        def radius(q: np.ndarray) -> np.ndarray:
            return factor * np.sqrt(np.maximum(reach[q] - 2 * best[q].min(1), 0)) + self.margin

        def walk(node: int, q: np.ndarray, first: bool) -> None:
            if not len(q):
                return
            if len(self.nodes[node]) == 2:
                if first:
                    home[q] = node
                q = q if first else q[home[q] != node]
                if len(q):
                    look(node, q)
                return
            vantage, inner, outer, near, far = self.nodes[node]
            d = np.sqrt(((raised[q] - vantage) ** 2).sum(1))
            if first:  # down to one leaf, for a first bound
                inside = d <= (inner + outer) / 2
                walk(near, q[inside], True)
                walk(far, q[~inside], True)
                return
            # The bound shrinks while the near side is walked, so the far side asks anew.
            walk(near, q[d - inner <= radius(q)], False)
            walk(far, q[outer - d <= radius(q)], False)

        if len(self.points):
            walk(self.root, np.arange(n), True)
            walk(self.root, np.arange(n), False)
        return best, who


class Shard:
    """The tree of a shard, with the ids of each distinct vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, exponent: int, top: float, leaf: int = LEAF):
        rows = np.ascontiguousarray(vectors) + 0.0  # one zero
        _, first, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, same))
        self.ids, self.distinct, self.exponent = ids[order], rows[first], exponent
        self.starts = np.r_[0, np.nonzero(np.diff(same[order]))[0] + 1, len(order)]
        self.tree = Tree(np.ldexp(self.distinct, -exponent), top, leaf)

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best (query id, vec id, inner product) of the shard for each query, ties to smaller ids."""
        wanted = min(k + SLACK, len(self.distinct))
        small = np.ldexp(queries, -self.exponent)
        best, who = self.tree.search(small, wanted, factor)
        q, c = np.nonzero(who >= 0)
        found = who[q, c]
        score = exact_scores(queries[q], self.distinct[found])
        if wanted == k + SLACK:
            # Where products as good as the k-th one may lie beyond the slack, all distinct vectors are compared.
            near = np.sort(best, axis=1)
            unsure = ~(near[:, SLACK - 1] - near[:, 0] > 1e-13 * self.tree.top)  # a query may be its own neighbour
            sure = ~unsure[q]
            q, found, score = [q[sure]], [found[sure]], [score[sure]]
            for i in np.nonzero(unsure)[0].tolist():
                every = np.nan_to_num(exact_scores(queries[i], self.distinct), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                own = np.nonzero(every >= np.partition(every, len(every) - k - 1)[len(every) - k - 1])[0]
                q, found, score = [*q, np.full(len(own), i)], [*found, own], [*score, every[own]]
            q, found, score = np.concatenate(q), np.concatenate(found), np.concatenate(score)
        n = np.minimum(np.diff(self.starts)[found], k + 1)  # of equal vectors only the smallest ids can be among the best
        q, score, at = np.repeat(q, n), np.repeat(score, n), np.repeat(self.starts[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = self.ids[at]
        keep = other != query_ids[q]
        q, score, other = q[keep], np.where(np.isnan(score), -np.inf, score)[keep], other[keep]
        ranked = np.lexsort((other, -score, q))
        q, score, other = q[ranked], score[ranked], other[ranked]
        if len(q):
            first = np.r_[0, np.nonzero(np.diff(q))[0] + 1]
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            q, score, other = q[place < k], score[place < k], other[place < k]
        return query_ids[q], other, score


def nearest(table: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` the ``k`` rows of largest inner product.

    Ties go to the smaller id.  Null ids and vectors that are null, zero, hold a
    null or non-finite component, or are not of the most frequent length take no
    part.  Rows with the query's own id are no candidates; of repeated query ids
    the smallest vector asks.  Products beyond the range of doubles are infinite;
    one of opposite infinities ranks last.  Too few candidates give all; an empty
    table gives an empty result; other columns are ignored.
    """
    raw = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = raw.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad).where(F.exists("v", lambda x: x != 0))
    largest = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    sizes = good.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), largest.alias("largest"))
    common = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    size, n, largest = common[0] if common else (0, 0, 1.0)
    good = good.where(F.size("v") == size)
    exponent = math.frexp(largest)[1]
    steps = [2.0 ** -(exponent // 2), 2.0 ** -(exponent - exponent // 2)]
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * steps[0] * steps[1] * (x * steps[0] * steps[1]))
    top = good.agg(F.max(square)).first()[0] or 0.0
    shards = max(1, -(-n // SHARD_ROWS))
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    data = good.select(deal.alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    asking = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = asking.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, first its vectors, then the queries: one tree at a time is held."""
        here, parts, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.nonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0))[0] + 1, len(numbers)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if numbers[a] != here:
                    here, parts, shard = numbers[a], [], None
                ids = batch.column(2).slice(a, b - a).to_numpy()
                v = batch.column(3).slice(a, b - a).flatten().to_numpy().reshape(b - a, size)
                if not asks[a]:
                    parts.append((ids.copy(), v.copy()))
                    continue
                if shard is None and parts:
                    shard, parts = Shard(np.concatenate([p[0] for p in parts]), np.vstack([p[1] for p in parts]), exponent, top), []
                for at in range(0, b - a, BLOCK_QUERIES) if shard else ():
                    found = shard.answer(ids[at : at + BLOCK_QUERIES], v[at : at + BLOCK_QUERIES], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    # More partitions than shards, so that few get two by hash.
    dealt = data.unionByName(asking).repartition(3 * shards, "shard").sortWithinPartitions("shard", "asks")
    found = materialize(map_batches(dealt, run, "query_id long, vec_id long, score double"), "neighbours")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
