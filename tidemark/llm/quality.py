"""Quality by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled documents gives inverse document frequencies, a
truncated singular value decomposition and the labelled vectors, all of a size
fixed by parameters and therefore broadcast.  Every document is projected,
multiplied exactly with all labelled vectors in blocks, and its nearest
neighbours vote with their similarity.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import fold, labelled_sample
from .shared import map_batches, text_batches, text_of

SLOTS = 1 << 16
#: Labelled documents that the space is fitted on and that vote, at most.
SAMPLE = 4000
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8.0
EDGE = ".,;:!?\"'()[]{}<>*#$%&-_…«»„“”¡¿"
CACHE_WORDS = 500_000
LEVELS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)
REPETITION_WEIGHT = 12

_codes: dict[str, tuple[int, int]] = {}
SHAPE = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (re.compile(r"\d+"), lambda m: "9"), (re.compile(r"(\W)\1+"), lambda m: m[1] * 2))


def codes(token: str) -> tuple[int, int]:
    """Hash slots of the word and of its shape (case, digits, punctuation)."""
    got = _codes.get(token)
    if got is None:
        if len(_codes) >= CACHE_WORDS:
            _codes.clear()
        shape = token
        for pattern, to in SHAPE:
            shape = pattern.sub(to, shape)
        word = token.strip(EDGE).lower()
        got = tuple(zlib.crc32((k + x).encode("utf-8", "surrogatepass")) % SLOTS for k, x in (("w", word), ("s", shape)))
        _codes[token] = got
    return got


def repetition(tokens: list[str]) -> list[int]:
    """Slots that tell how often a token follows itself and how few distinct tokens there are."""
    n = len(tokens)
    if not n:
        return []
    again = sum(map(eq, tokens, tokens[1:])) / n
    bins = [f"again{bisect(LEVELS, again)}"]
    if n >= 20:
        bins.append(f"distinct{bisect(LEVELS, min(1.0, len(set(tokens)) / n**0.8))}")
    return [zlib.crc32(f"{b}:{k}".encode()) % SLOTS for b in bins for k in range(REPETITION_WEIGHT)]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and damped count of every distinct feature of every text."""
    rows, flat = [], []
    for i, t in enumerate(texts):
        tokens = t.split()
        rows.append((i, 2 * len(tokens)))
        for token in tokens:
            flat += codes(token)
        extra = repetition(tokens)
        rows[-1] = (i, 2 * len(tokens) + len(extra))
        flat += extra
    which, n = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, times = np.unique(np.repeat(which, n) * SLOTS + np.array(flat, np.int64), return_counts=True)
    return keys // SLOTS, keys % SLOTS, (1 + np.log(times)).astype(np.float32)


def row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by ascending ``rows``."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        starts = np.r_[0, np.nonzero(np.diff(rows))[0] + 1]
        out[rows[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Space:
    projection: np.ndarray  # slots x rank, inverse document frequencies included
    vectors: np.ndarray  # labelled documents x rank, of unit length
    y: np.ndarray

    def project(self, texts: list[str]) -> np.ndarray:
        rows, slots, times = counted(texts)
        out = np.zeros((len(texts), self.projection.shape[1]), np.float32)
        for part in np.array_split(np.arange(len(rows)), max(1, len(rows) >> 18)):
            out += row_sums(rows[part], self.projection[slots[part]] * times[part, None], len(texts))
        return unit(out)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; without any direction or neighbour, the labels' mean."""
        base = float(self.y.mean()) if len(self.y) else 0.5
        if not len(self.y):
            return np.full(len(x), base)
        k, out = min(NEIGHBOURS, len(self.y)), np.full(len(x), base)
        for at in range(0, len(x), 512):
            cosine = x[at : at + 512] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.exp(SHARPNESS * np.take_along_axis(cosine, near, 1).astype(float))
            out[at : at + 512] = (weight * self.y[near]).sum(1) / weight.sum(1)
        out[~x.any(axis=1)] = base
        return out


def build(texts: list[str], y: np.ndarray, rank: int = RANK, seed: int = 7) -> Space:
    """Randomised truncated SVD of the sample's tf-idf rows."""
    n = len(texts)
    rows, slots, times = counted(texts)
    df = np.bincount(slots, minlength=SLOTS)
    idf = np.where(df >= 2, np.log((1 + n) / (1 + df)) + 0.1, 0).astype(np.float32)
    used, local = np.unique(slots, return_inverse=True)
    values = times * idf[slots]
    norm = np.sqrt(np.bincount(rows, values.astype(float) ** 2, n))[rows] + 1e-12 if n else values
    values = (values / norm).astype(np.float32)
    by_slot = np.argsort(local, kind="stable")

    def times_matrix(m: np.ndarray) -> np.ndarray:  # X m
        return np.hstack([row_sums(rows, m[local, c : c + 8] * values[:, None], n) for c in range(0, m.shape[1], 8)])

    def times_transposed(m: np.ndarray) -> np.ndarray:  # X' m
        r, v, s = rows[by_slot], values[by_slot], local[by_slot]
        return np.hstack([row_sums(s, m[r, c : c + 8] * v[:, None], len(used)) for c in range(0, m.shape[1], 8)])

    rank = min(rank, n, len(used))
    if not rank:
        return Space(np.zeros((SLOTS, 1), np.float32), np.zeros((n, 1), np.float32), y)
    basis = np.random.default_rng(seed).standard_normal((len(used), min(rank + 8, len(used)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(times_matrix(basis))
        basis = times_transposed(q.astype(np.float32))
    u, s, vt = np.linalg.svd(basis, full_matrices=False)
    projection = np.zeros((SLOTS, u.shape[1]), np.float32)
    projection[used] = u * idf[used, None]
    space = Space(projection[:, :rank], np.zeros((0, rank), np.float32), y)
    space.vectors = np.vstack([space.project(texts[at : at + 500]) for at in range(0, n, 500)])
    return space


def fit(docs: DataFrame, labels: DataFrame, usable, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> Space:
    """The space and voters of ``limit`` labelled documents at most (a hash of ids picks them; see ``labelled_sample``).

    Without any usable label the space is empty and votes 0.5.
    """
    sample = labelled_sample(docs, labels, label, usable, limit, id_col, text_col).toArrow().sort_by([("at", "ascending")])
    return build(sample.column("text").to_pylist(), sample.column("y").to_numpy().astype(int))


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row; null and empty texts score the labels' mean; null ids and repeated rows pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            scores = shared.value.vote(shared.value.project(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(scores, 0, 1))], ["doc_id", "score"])

    ids = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_batches(ids, run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of all rows, from voters that exclude the ids with crc32(doc_id) mod ``modulus`` = ``held``.

    Null and empty texts score the labels' mean; a null id is not held out;
    repeated rows get a row each; labels of unknown ids and null labels do not
    count; an empty table gives an empty result; other columns are ignored.
    """
    space = fit(docs, labels, lambda: fold("doc_id", modulus) != held)
    return score(docs, space).select(
        "doc_id", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
