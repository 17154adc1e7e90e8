"""Best-fit packing planned on the length histogram.

1. Documents are tokenised and cut into pieces once; the pieces go to a shared
   table with their partition and their rank within (partition, length).
2. Counts per length (at most ``capacity`` rows, whatever the corpus) go to the
   driver, where best-fit decreasing runs over counts: bins in the same state
   are one group, so the plan has a number of runs bounded by the capacity.
3. Each piece's global rank within its length (offset of its partition plus its
   local rank) finds its planned slot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches, materialize, text_batches, text_of

END_ID = 1
CAPACITY = 4096
#: Words whose ids a worker remembers, at most.
CACHE_WORDS = 600_000

PIECES = "doc_id long, piece int, start long, length long, ids binary, part long, local_rank long"


def default_tokenizer() -> str:
    """Path of the word BPE vocabulary that the machine offers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of plain letters, digits and marks, whose lower case, normal form and parts need no Unicode tables.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: The tokenizer's own split of a lower-case plain word.
PART = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^ 0-9a-zß-öø-ÿ]+")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordCoder:
    """Ids of texts through a memory of white-space separated words.

    The tokenizer drops white space and never merges across it, so a text's ids
    are its words' ids in a row.  Splits only at space and newline; any other
    white space stays inside a word and is left to the tokenizer.

    New plain words go through the same merges in one call for thousands of
    words: with a zero byte for the end of a word, every merge is the join of
    two byte strings to a third one of lower rank.  That holds since every entry
    of the vocabulary encodes to itself (``merges_by_rank`` tests it).
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        alphabet, ranks = byte_alphabet(), {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            body = token.removesuffix("</w>")
            if all(c in alphabet for c in body):
                ranks[bytes(alphabet[c] for c in body) + bytes(body != token)] = i
        self.space = ranks[b" "]
        self.merger = tiktoken.Encoding("words", pat_str="[^\\x00 ]+\\x00| ", mergeable_ranks=ranks, special_tokens={})

    def merges_by_rank(self) -> bool:
        """Whether each entry of the vocabulary that a plain word can reach encodes to itself."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        model = self.tokenizer.model
        return all([t.id for t in model.tokenize(token.removesuffix("</w>"))] == [i] for token, i in vocab.items() if token.endswith("</w>"))

    def encode_new(self, words: list[str]) -> None:
        plain = [w for w in words if PLAIN(w) and "<|" not in w]
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self.merger.encode_ordinary(PART.sub("\\g<0>\x00", " ".join(some).lower())), "<u4")
            ends = np.r_[np.nonzero(ids == self.space)[0], len(ids)] * 4
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist(), strict=True):
                self.known[word] = raw[start:end]
                start = end + 4
        other = [w for w in words if w not in self.known]
        for at in range(0, len(other), 20_000):
            some = other[at : at + 20_000]
            for word, enc in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                self.known[word] = np.asarray(enc.ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (strings without null), flat, and each text's number of ids."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        known = self.known
        self.encode_new([w for w in distinct if w not in known])
        coded = [known[w] for w in distinct]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(coded), "<u4")
        which = words.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        flat = pool[np.repeat(start[which] - (ends - n), n) + np.arange(n.sum())]
        bounds = np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()]
        return flat, np.diff(bounds)


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = coder(tokenizer).encode, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in text_batches(batches, 12 << 20):
            rows, (flat, sizes) = [], encode(batch.column(1))
            raw, at_id = flat.tobytes(), 0
            for doc, size in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                ids = raw[4 * at_id : 4 * (at_id + size)] + end
                at_id += size
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc, piece, at // 4, n, cut, part, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids", "part", "local_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return map_batches(docs.select(F.col(id_col).cast("long"), text_of(text_col)), run, PIECES)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts.

    A group is a range of consecutive sequences in the same state.  Each run of
    the plan tells where the pieces of one length from one rank on go: ``per``
    of them into each sequence from ``sequence`` on, from ``offset`` on.
    """
    groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some group has room for r
    opened = 0
    runs: list[tuple[int, int, int, int, int]] = []

    def put(room: int, first: int, n: int) -> None:
        nonlocal free
        if n and room:
            groups[room].append((first, n))
            free |= 1 << room

    for length in range(capacity, 0, -1):
        left, rank = int(histogram.get(length, 0)), 0
        while left:
            fitting = free >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                first, n = groups[room].pop()
                if not groups[room]:
                    free &= ~(1 << room)
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, per, first, capacity - room))
                rank, left = rank + full * per, left - full * per
                put(room - per * length, first, full)
            if full < n:
                if left:  # one more sequence takes the rest
                    runs.append((length, rank, per, first + full, capacity - room))
                    put(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                put(room, first + full, n - full)
    cols = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "per", "sequence", "offset"), cols, strict=True)) | {"sequences": np.int64(opened)}


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    instead_of_ids: Column | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset.

    ``instead_of_ids``, an expression of ``ids`` with a name, takes their place
    before anything is written or shuffled, for callers that need no more.

    Documents of up to ``capacity`` tokens stay whole, longer ones are cut into
    pieces of ``capacity``.  Null text is empty (one end token); a null id stays
    null; repeated rows are packed as often as they come; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = tokenised_pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, capacity)
    carried = "ids"
    if instead_of_ids is not None:
        cut = cut.select(*[c for c in cut.columns if c != "ids"], instead_of_ids)
        carried = cut.columns[-1]
    pieces = materialize(cut, "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn("first_rank", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-offsets")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_best_fit(histogram, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length, rank):
        import pandas as pd

        p = plan.value
        size, nth = length.to_numpy(), rank.to_numpy()
        run = np.searchsorted((p["length"] << 44) | p["rank"], (size << 44) | nth, "right") - 1
        past = nth - p["rank"][run]
        return pd.DataFrame(
            {
                "sequence_id": p["sequence"][run] + past // p["per"][run],
                "offset": p["offset"][run] + past % p["per"][run] * size,
            }
        )

    # The offsets grow with the number of partitions, so they are merged, never broadcast.
    ranked = pieces.join(offsets.select("part", "length", "first_rank").hint("merge"), ["part", "length"])
    placed = ranked.withColumn("slot", slot("length", F.col("first_rank") + F.col("local_rank")))
    return placed.select("doc_id", "piece", "start", "length", carried, "slot.sequence_id", "slot.offset")
