"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A linear model scores sentences, noisy-or
combines them to the document's probability, and the weights are trained from
document labels alone.  Afterwards the sentence scores locate what offends.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import fold, labelled_sample
from .shared import map_batches, text_batches, text_of

#: Hash slots for words.
SLOTS = 1 << 18
#: Labelled documents that a model is fitted on, at most.
SAMPLE = 6000
ROUNDS = 250
TELLING = 2.0
EDGE = ".,;:!?\"'()[]{}<>*#$%&-_…«»„“”¡¿"
CACHE_WORDS = 1_000_000

#: Features of a word besides the whole of it: its first characters.
PREFIXES = (5, 6, 7)
PER_WORD = 1 + len(PREFIXES)


def features(token: str) -> list[int]:
    """Hash slots of a token's word and its beginnings."""
    word = token.strip(EDGE).lower()
    if not word:
        return [SLOTS] * PER_WORD
    parts = [word, *("^" + word[:n] for n in PREFIXES)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in parts]


def is_end(token: str) -> bool:
    return token[-1:] in ".!?…\n"


def tokens_of(text: str) -> list[str]:
    """Tokens of a text; a line end is one that ends a sentence."""
    return [t for t in text.replace("\n", " \n ").split(" ") if t]


class Bags:
    """Tokens of many documents, flat, with the sentence of each and the document of each sentence."""

    def __init__(self, sizes: list[int], ends: np.ndarray):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        new = np.zeros(len(ends), np.int64)
        if len(ends):
            new[1:] = ends[:-1] | (doc[1:] != doc[:-1])
        self.docs, self.sentence = len(sizes), np.cumsum(new)
        self.owner = doc[np.r_[0, np.nonzero(new)[0]]] if len(ends) else np.zeros(0, np.int64)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, shrink: float = 2e-4, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss of noisy-or, with an L1 pull.

    Features of under three sample documents, or without ``TELLING`` times the usual odds of label 1, weigh nothing.

    ``docs``: for each document an array of its tokens' feature slots and, last, whether the token ends a sentence.
    """
    weights = np.zeros(SLOTS + 1)
    if not len(docs) or y.min() == y.max():
        return weights, 3.0 if len(docs) and y.max() else -30.0
    seen, toxic = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for d, label in zip(docs, y, strict=True):
        own = np.unique(d[:, :-1])
        seen[own] += 1
        toxic[own] += label
    base = y.mean()
    telling = (seen >= 3) & ((toxic + base) / (seen - toxic + 1 - base) >= TELLING * base / (1 - base))
    telling[SLOTS] = False
    sentence, chosen, owner, before = [], [], [], 0
    for i, d in enumerate(docs):
        number = before + np.cumsum(d[:, -1]) - d[:, -1]
        rows, cols = np.nonzero(telling[d[:, :-1]])
        sentence.append(number[rows])
        chosen.append(d[rows, cols])
        own = int(number[-1]) + 1 - before if len(d) else 0
        owner.append(np.full(own, i, np.int32))
        before += own
    sentence, owner = np.concatenate(sentence), np.concatenate(owner)
    slots, local = np.unique(np.concatenate(chosen), return_inverse=True)
    n_docs, n_sentences = len(docs), len(owner)
    w, b = np.zeros(len(slots)), -6.0
    m, v, mb, vb = np.zeros(len(slots)), np.zeros(len(slots)), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) / len(y)
    for t in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[local], n_sentences)
        total = np.bincount(owner, softplus(z), n_docs)
        slope = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-6, 60)), 1.0) * balance
        dz = slope[owner] * sigmoid(z)
        g = np.bincount(local, dz[sentence], len(slots)) + shrink * np.tanh(w * 10)
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    weights[slots] = w
    return weights, float(b)


TOKEN = re.compile(r"[^ \n]+|\n")


def offending(text: str, scores: np.ndarray, least: float) -> list[dict]:
    """Places (code points) of the sentences whose own probability is ``least`` or more."""
    tokens = list(TOKEN.finditer(text))
    ends = np.fromiter((is_end(t[0]) for t in tokens), np.int64, len(tokens))
    number = np.cumsum(ends) - ends
    out = []
    for s in np.nonzero(scores >= least)[0]:
        own = np.nonzero(number == s)[0]
        out.append({"start": tokens[own[0]].start(), "end": tokens[own[-1]].end(), "score": float(scores[s])})
    return out


class Scorer:
    """Document and sentence probabilities; remembers the weight of each token it has met."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Bags]:
        split = [tokens_of(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        for token in set().union(*split).difference(known):
            known[token] = float(self.weights[features(token)].sum()) + (1e6 if is_end(token) else 0)
        flat = np.fromiter((known[t] for d in split for t in d), float)
        ends = flat > 5e5
        flat[ends] -= 1e6
        bags = Bags([len(d) for d in split], ends.astype(np.int64))
        z = self.bias + np.bincount(bags.sentence, flat, len(bags.owner))
        return -np.expm1(-np.bincount(bags.owner, softplus(z), bags.docs)), sigmoid(z), bags


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def fit(docs: DataFrame, labels: DataFrame, usable, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model of ``limit`` labelled documents at most (a hash of ids picks them; see ``labelled_sample``).

    Without usable labels, or with one kind only, the model gives all sentences the same score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            docs = [np.array([[*features(w), is_end(w)] for w in tokens_of(t)], "<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(docs, pa.binary()), batch.column(2)], ["at", "tokens", "y"])

    sample = map_batches(labelled_sample(docs, labels, label, usable, limit, id_col, text_col), run, "at int, tokens binary, y int").toArrow().sort_by([("at", "ascending")])
    docs = [np.frombuffer(c, "<i4").reshape(-1, PER_WORD + 1) for c in sample.column("tokens").to_pylist()]
    return train(docs, sample.column("y").to_numpy().astype(int))


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", locate: float = 0.5) -> DataFrame:
    """doc_id, score, sentences (start, end, score of those at or over ``locate``), for each row.

    Null and empty texts have no sentence and score the noisy-or of nothing, 0;
    null ids and repeated rows pass through; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    weights, bias = model
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias)
        for batch in text_batches(batches, 4 << 20):
            texts = batch.column(1).to_pylist()
            whole, p, bags = scorer(texts)
            first = np.searchsorted(bags.owner, np.arange(bags.docs + 1))
            hot = set(np.unique(bags.owner[p >= locate]).tolist())
            places = [offending(t, p[first[i] : first[i + 1]], locate) if i in hot else [] for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole), pa.array(places, SPANS)], ["doc_id", "score", "sentences"])

    ids = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    return map_batches(ids, run, f"doc_id {kind}, score double, sentences array<struct<start:bigint,end:bigint,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and sentences of all rows, from a model that never saw the ids with crc32(doc_id) mod ``modulus`` = ``held``.

    Null and empty texts score 0; a null id is not held out; repeated rows get a
    row each; labels of unknown ids and null labels do not count; an empty table
    gives an empty result; other columns are ignored.
    """
    model = fit(docs, labels, lambda: fold("doc_id", modulus) != held)
    scored = score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences"
    )


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores under ``reject``; null and empty texts stay."""
    weights, bias = model
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias)
        for batch in text_batches(batches, 4 << 20):
            whole, _, _ = scorer([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(whole < reject))

    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return map_batches(rows, run, rows.schema)
