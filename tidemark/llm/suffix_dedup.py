"""Repeated passages: every byte of a ``width``-byte string that also starts in a document of smaller id goes.

1. Documents are gathered into blocks, written once.
2. Each ``width``-byte window has an anchor, its smallest hash of ``GRAM``
   bytes.  A run of windows with one anchor and the bytes they cover is a
   record, so equal windows lie in records of equal anchors, wherever they are.
3. Records meet by anchor: equal records have one owner, the smallest id; all
   others' windows are repeats.  Records meet as short digests; those taken as
   equal prove it by SHA-256, or the hashes are drawn anew.  What is left to find is windows that an owner
   shares with *another* record of its anchor.  Such a window reaches ``SIDE``
   bytes beyond the anchor on one side at least, so it can only be there if the
   records agree in those bytes (a digest of 16 bits each tells).
4. Owners that agree with another record on a side send their bytes to the shard
   of the anchor with that side, where a suffix array by external induced sorting
   brings equal windows together and the smallest id of each is found.  An anchor
   that occurs twice in a record has one shard for all its records.
5. Every block applies the answers to its documents.

Nothing is capped: an anchor met by a third of all documents is one record per
block and context, its contexts part by their sides, and shards beyond memory
spill their queues.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .shared import discard, map_batches, materialize, text_batches, text_of
from .suffix_sort import Folder, suffix_order

WIDTH, GRAM = 50, 16
SIDE = (WIDTH - GRAM) // 2
BLOCK_BYTES = 2 << 20
#: Records that one task compares, about; of 18 windows on average each.
BUCKET_RECORDS = 1 << 19
NO_ID = np.iinfo(np.int64).max
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
ENTRY = np.dtype([("anchor", "<u8"), ("record", "<u8"), ("left", "<u2"), ("right", "<u2"), ("least", "<i8")])
#: Digests of a side: no window reaches that far; the anchor occurs more than once, so anything may match.
NOWHERE, ANYWHERE = 0, 1
#: Bytes hashed at a time, and the bits of a hash that give way to its place (more places than a window has).
STRIP, LOW = 1 << 15, np.uint64(63)


#: The first seed of the hashes; a collision makes the job go on with the next one.
SEED = 20
SEEDS = 8
_tables: dict[int, np.ndarray] = {}


def table_of(seed: int) -> np.ndarray:
    """Random odd numbers for the byte values."""
    if seed not in _tables:
        _tables[seed] = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return _tables[seed]


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x)], dtype=np.uint64) for x in (MULTIPLIER, inverse)]
    return _powers[0], _powers[1]


def gram_hashes(data: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A mixed hash of the ``GRAM`` bytes from each place on."""
    with np.errstate(over="ignore"):
        h, size = table_of(seed)[data], 1
        while size < GRAM:
            left = h[:-size] * (MULTIPLIER + np.uint64(2 * size))
            left += h[size:]
            left ^= left >> np.uint64(29)
            h = left
            size *= 2
    return h


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if n > size else h


def anchors(data: np.ndarray, width: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Each window's smallest hash of ``GRAM`` bytes, whose low bits are the place modulo 64, and if it occurs again there.

    Strips that fit the processor's cache are hashed one at a time.
    """
    n = len(data) - width + 1
    least, again = np.empty(n, np.uint64), np.zeros(n, bool)
    for at in range(0, n, STRIP):
        h = gram_hashes(data[at : at + STRIP + width - 1], seed)
        h &= ~LOW
        h |= np.arange(at, at + len(h), dtype=np.uint64) & LOW
        out = least[at : at + STRIP]
        out[:] = sliding_min(h, width - GRAM + 1)
        # The smallest place and the largest one are the same if there is only one.
        again[at : at + STRIP] = ((sliding_min(h ^ LOW, width - GRAM + 1) ^ out) & LOW) != LOW
    return least, again


class Records:
    """Records of a block: first and last window, anchor, digest, and the document each is in."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, width: int = WIDTH, seed: int = SEED):
        n = len(data)
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.anchor = self.digest = np.zeros(0, np.uint64)
        self.left = self.right = np.zeros(0, np.uint16)
        if n < width:
            return
        least, again = anchors(data, width, seed)
        table = table_of(seed)
        whole = np.maximum(np.diff(bounds) - width + 1, 0)  # windows of each document
        inside = np.repeat(np.tile([True, False], len(whole)), np.stack([whole, np.diff(bounds) - whole], 1).ravel())[: len(least)]
        new = np.ones(len(least), bool)
        change = least[1:] ^ least[:-1]
        new[1:] = (change > LOW) | (inside[1:] != inside[:-1])
        new[bounds[1:-1][bounds[1:-1] < len(new)]] = True
        first = np.nonzero(new)[0]
        last = np.r_[first[1:] - 1, len(least) - 1]
        keep = inside[first]
        self.first, self.last = first[keep], last[keep]
        self.doc = np.searchsorted(bounds, self.first, "right") - 1
        self.anchor = least[self.first] >> np.uint64(6)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        for at in range(0, n, STRIP):
            np.multiply(table[data[at : at + STRIP]], up[at : min(at + STRIP, n)], out=sums[at + 1 : at + 1 + STRIP])
        np.cumsum(sums, out=sums)

        def digest(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                d = (sums[end] - sums[start]) * down[start]
                d = (d ^ (d >> np.uint64(32))) * MULTIPLIER + (end - start).astype(np.uint64)
            return d ^ (d >> np.uint64(31))

        self.digest = digest(self.first, self.last + width)
        self.left = self.right = np.zeros(len(self.first), np.uint16)
        if not len(self.first):
            return
        # The anchor occurs more than once if any window holds two of it or its place moves within the record.
        again[1:] |= (change != 0) & ~new[1:]
        times = np.logical_or.reduceat(again, first)[keep]
        place = self.first + ((least[self.first] - self.first.astype(np.uint64)) & LOW).astype(np.int64)
        side = lambda there, start, end: np.where(times, ANYWHERE, np.where(there, digest(np.where(there, start, 0), np.where(there, end, 0)) % np.uint64(65_534) + np.uint64(2), NOWHERE)).astype(np.uint16)
        self.left = side(self.first <= place - SIDE, place - SIDE, place)
        self.right = side(self.last >= place - SIDE, place + GRAM, place + GRAM + SIDE)

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (anchor, digest) with the least id, and each record's number among them."""
        order = np.argsort(self.digest)  # the digest covers the anchor
        d = self.digest[order]
        new = np.ones(len(order), bool)
        new[1:] = d[1:] != d[:-1]
        of = np.cumsum(new) - 1
        number = np.empty(len(order), np.int64)
        number[order] = of
        start = np.nonzero(new)[0]
        out = np.zeros(len(start), ENTRY)
        self.stands = np.zeros(0, np.int64)
        if len(start):
            owner = ids[self.doc[order]]
            least = np.minimum.reduceat(owner, start)
            # The record that stands for an entry: the first one of the least id.
            self.stands = np.minimum.reduceat(np.where(owner == least[of], order, len(order)), start)
            for name, values in (("anchor", self.anchor), ("record", self.digest), ("left", self.left), ("right", self.right)):
                out[name] = values[self.stands]
            out["least"] = least
        return out, number


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    # The smallest hash of a window is low in its top bits, so the bits are mixed first.
    with np.errstate(over="ignore"):
        return (((anchor * MULTIPLIER) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def grouped(b: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Distinct values and their places."""
    order = np.argsort(b, kind="stable")
    cuts = np.r_[0, np.nonzero(np.diff(b[order]))[0] + 1, len(order)] if len(order) else np.zeros(1, int)
    return [(int(b[order[x]]), order[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


#: Bytes of anchors and digests by which records meet.
CUT = 6
#: The block number of a proof that failed.
FAILED = -1


def pack_entries(e: np.ndarray) -> bytes:
    """Entries, column after column."""
    cut = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :CUT].tobytes()
    return cut(e["anchor"]) + cut(e["record"]) + e["left"].tobytes() + e["right"].tobytes() + e["least"].tobytes()


def unpack_entries(raw: bytes) -> np.ndarray:
    n = len(raw) // (2 * CUT + 12)
    out, wide, at = np.zeros(n, ENTRY), np.zeros((n, 8), np.uint8), 0
    for name in ("anchor", "record"):
        wide[:, :CUT] = np.frombuffer(raw, np.uint8, CUT * n, at).reshape(n, CUT)
        out[name] = wide.view("<u8").ravel()
        at += CUT * n
    for name, kind, size in (("left", "<u2", 2), ("right", "<u2", 2), ("least", "<i8", 8)):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += size * n
    return out


def agreeing(group: np.ndarray, side: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Whether another record of the anchor has the same digest of a side."""
    keys = group * 65_536 + side
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, np.diff(keys[order]) != 0]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return (np.bincount(number, fresh)[number] > 1) & (side != NOWHERE)


def meet(blobs: list[bytes]) -> list[bytes]:
    """For each block's entries of a bucket five rows of bits: is the block the owner; may another record share
    a window that reaches to the left; to the right; or anywhere, as the anchor occurs twice in one of them;
    and is the record in another block, too."""
    parts = [unpack_entries(b) for b in blobs]
    e, sizes = np.concatenate(parts), [len(p) for p in parts]
    order = np.argsort(e["record"])
    s = e[order]
    same, near = s["record"][1:] == s["record"][:-1], s["anchor"][1:] == s["anchor"][:-1]
    if (same & ~near).any():  # cut digests of two anchors collide
        order = np.lexsort((e["anchor"], e["record"]))
        s = e[order]
        same, near = s["record"][1:] == s["record"][:-1], s["anchor"][1:] == s["anchor"][:-1]
    fresh = np.r_[True, ~(same & near)]
    start, of = np.nonzero(fresh)[0], np.cumsum(fresh) - 1
    least = np.minimum.reduceat(s["least"], start)[of]
    # Anchors that only one record has are done.
    rank = np.argsort(s["anchor"][start])
    anchor = s["anchor"][start[rank]]
    group = np.empty(len(start), np.int64)
    group[rank] = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
    several = (np.bincount(group)[group] > 1)[of]
    group, left, right = group[of][several], s["left"][several], s["right"][several]
    out = np.zeros((5, len(s)), bool)
    out[0, order] = s["least"] == least
    out[4, order] = (np.bincount(of) > 1)[of]
    if len(group):
        anywhere = np.bincount(group, left == ANYWHERE)[group] > 0
        out[3, order[several]] = anywhere
        for row, side in ((1, left), (2, right)):
            out[row, order[several]] = ~anywhere & agreeing(group, side.astype(np.int64), fresh[several])
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1], axis=1)]


def shared_windows(records: list[bytes], owners: np.ndarray, width: int = WIDTH, memory: int | None = None) -> list[np.ndarray]:
    """For each record whether each of its windows is in a record of a smaller owner, by suffix order.

    The text of the shard and the answers are mapped files, and the sorter's
    queues go to files beyond ``memory`` bytes.
    """
    sizes = np.array([len(r) for r in records], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    folder = Folder()
    try:
        text = folder.array(int(sizes.sum()) + len(records) + 1, np.uint16)
        for k in range(0, len(records), STRIP):  # each record and a 1 behind it
            flat = np.frombuffer(b"\xff".join([*records[k : k + STRIP], b""]), np.uint8)
            part = text[starts[k] : starts[k] + len(flat)]
            part[:] = flat
            part += 2
            part[starts[k : k + STRIP] + sizes[k : k + STRIP] - starts[k]] = 1
        repeated = folder.array(len(text), bool)
        tail, tail_of = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last group, which may go on in the next block
        ends = starts + sizes - width
        for at, prefix in suffix_order(text, width, memory, folder):
            of = np.searchsorted(starts, at, "right") - 1
            # A window starts where its record goes on for ``width`` bytes; what shares as much with such a place is one, too.
            whole = at <= ends[of]
            run, of = np.concatenate([tail, at[whole]]), np.concatenate([tail_of, of[whole]])
            if not len(run):
                continue
            same = np.concatenate([np.ones(len(tail), bool), prefix[whole] >= width])
            same[0] = False
            start = np.nonzero(~same)[0]
            mine = owners[of]
            least = np.repeat(np.minimum.reduceat(mine, start), np.diff(np.append(start, len(run))))
            # All groups but the last one are done.
            repeated[run[: start[-1]]] = (least < mine)[: start[-1]]
            tail, tail_of = run[start[-1] :], of[start[-1] :]
        if len(tail):
            mine = owners[tail_of]
            repeated[tail] = mine.min() < mine
        return [np.array(repeated[s : s + n - width + 1]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    finally:
        folder.close()


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows, of which only one at a time is copied."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def make_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3).compress

        def flush():
            nonlocal number
            row = {"block": [(part << 32) + number], "ids": [np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes()], "nulls": [np.array([i is None for i in ids]).tobytes()], "sizes": [np.array([len(t) for t in texts], "<i8").tobytes()], "data": [squeeze(b"".join(texts))], "n": [sum(map(len, texts))]}
            number += 1
            return pa.RecordBatch.from_pydict(row, pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("n", pa.int64())]))

        ids, texts, held = [], [], 0
        for batch in text_batches(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                if texts and held + len(raw) > BLOCK_BYTES:
                    yield flush()
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(raw)
                held += len(raw)
        if texts:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return map_batches(rows, run, "block long, ids binary, nulls binary, sizes binary, data binary, n long")


def prove(keys: list[bytes], proofs: list[bytes]) -> bool:
    """Whether all records of one key (record and anchor, cut) have one SHA-256."""
    k = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 2 * CUT)
    p = np.frombuffer(b"".join(proofs), np.uint8).reshape(-1, 32)
    order = np.lexsort(k.T)
    same = (k[order[1:]] == k[order[:-1]]).all(axis=1)
    return bool((p[order[1:]][same] == p[order[:-1]][same]).all())


class Block:
    def __init__(self, row: dict, seed: int = SEED):
        self.id, self.ids = row["block"], np.frombuffer(row["ids"], "<i8")
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.raw = zstandard.ZstdDecompressor().decompress(row["data"]) if row["n"] else b""
        self.bounds = np.r_[0, np.cumsum(np.frombuffer(row["sizes"], "<i8"))]
        self.records = Records(np.frombuffer(self.raw, np.uint8), self.bounds, seed=seed)
        self.entries, self.number = self.records.distinct(self.ids)

    def split(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """Numbers of the entries of each bucket."""
        return grouped(bucket_of(self.entries["anchor"], buckets))

    def apply(self, replies: list[dict], buckets: int) -> None:
        """Take the five bits of each entry."""
        self.bits = np.zeros((5, len(self.entries)), bool)
        bits = {r["bucket"]: r["bits"] for r in replies}
        for bucket, which in self.split(buckets):
            self.bits[:, which] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8))[: 5 * len(which)].reshape(5, -1)

    def asking(self, buckets: int):
        """(bucket, entry numbers) whose bytes go to the bucket's shard; an entry may go to the shards of both sides."""
        own, left, right, anywhere, _ = self.bits
        which, keys = [], []
        for number, (bit, side) in enumerate(((left, self.entries["left"]), (right, self.entries["right"]), (anywhere, None))):
            which.append(np.nonzero(own & bit)[0])
            key = self.entries["anchor"][which[-1]]
            keys.append(key if side is None else key ^ (side[which[-1]].astype(np.uint64) + np.uint64((number + 1) << 16)))
        which = np.concatenate(which)
        for bucket, at in grouped(bucket_of(np.concatenate(keys), buckets)):
            yield bucket, which[at]

    def proving(self, buckets: int):
        """(bucket, keys, SHA-256) of the entries that other blocks have, too, and of records here that are not what stands for them."""
        which = np.nonzero(self.bits[4])[0]
        proofs = [hashlib.sha256(self.bytes_of(e)).digest() for e in which.tolist()]
        r, width = self.records, WIDTH
        begin, end = r.first.tolist(), (r.last + width).tolist()
        odd = []
        times = np.bincount(self.number, minlength=len(self.entries))
        for k in np.nonzero(times[self.number] > 1)[0].tolist() if len(self.number) else ():
            e = int(self.number[k])
            if self.raw[begin[k] : end[k]] != self.bytes_of(e):
                odd += [(e, hashlib.sha256(self.raw[begin[k] : end[k]]).digest()), (e, hashlib.sha256(self.bytes_of(e)).digest())]
        which = np.r_[which, np.array([e for e, _ in odd], np.int64)].astype(np.int64)
        proofs += [p for _, p in odd]
        mask = np.uint64((1 << (8 * CUT)) - 1)
        for bucket, at in grouped(bucket_of(self.entries["record"][which] & mask, buckets)):
            e = self.entries[which[at]]
            keys = np.hstack([np.ascontiguousarray(e[name]).view(np.uint8).reshape(-1, 8)[:, :CUT] for name in ("record", "anchor")])
            yield bucket, keys.tobytes(), b"".join(proofs[k] for k in at.tolist())

    def bytes_of(self, entry: int) -> bytes:
        r = self.records.stands[entry]
        return self.raw[self.records.first[r] : self.records.last[r] + WIDTH]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for each row.

    Null text is empty.  A null id counts as larger than all others; rows of one
    id never remove from each other.  Texts under ``WIDTH`` bytes stay whole; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    blocks = materialize(make_blocks(docs, id_col, text_col), "blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // (18 * BUCKET_RECORDS)))
    for seed in range(SEED, SEED + SEEDS):
        cut = _attempt(blocks, buckets, seed)
        if cut is not None:
            return cut
    raise RuntimeError(f"different records had one digest under {SEEDS} seeds")


def _attempt(blocks: DataFrame, buckets: int, seed: int) -> DataFrame | None:
    """The result with hashes of one seed, None if two different records were taken as equal."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                b = Block(row, seed)
                parts = b.split(buckets)
                yield pa.RecordBatch.from_pydict({"bucket": [k for k, _ in parts], "block": [b.id] * len(parts), "entries": [pack_entries(b.entries[w]) for _, w in parts]}, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("entries", pa.binary())]))

    def answer(group: pa.Table) -> pa.Table:
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "bits": pa.array(meet(group.column("entries").to_pylist()), pa.binary())})

    asked = map_batches(blocks, entries, "bucket long, block long, entries binary")
    replies = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, bits binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))
    replies = materialize(replies, "block-replies")
    told = blocks.join(replies, "block", "left")

    asked_schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("sizes", pa.binary()), ("owners", pa.binary()), ("data", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for row in one_by_one(batch):
                b = Block(row, seed)
                b.apply(row["replies"] or [], buckets)
                for bucket, keys, proofs in b.proving(buckets):
                    yield pa.RecordBatch.from_pydict({"bucket": [buckets + bucket], "block": [b.id], "sizes": [keys], "owners": [b""], "data": [proofs]}, asked_schema)
                for bucket, which in b.asking(buckets):
                    sent = [b.bytes_of(e) for e in which.tolist()]
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": [bucket], "block": [b.id], "sizes": [np.array(list(map(len, sent)), "<i8").tobytes()], "owners": [b.entries["least"][which].tobytes()], "data": [squeeze(b"".join(sent))]},
                        asked_schema,
                    )

    def sort(group: pa.Table) -> pa.Table:
        number = group.column("bucket")[0].as_py()
        if number >= buckets:  # proofs; only a failed one makes a row
            failed = not prove(group.column("sizes").to_pylist(), group.column("data").to_pylist())
            return pa.table({"block": pa.array([FAILED] * failed, pa.int64()), "bucket": pa.array([number] * failed, pa.int64()), "bits": pa.array([b""] * failed, pa.binary())})
        records, owners, counts = [], [], []
        for row in group.to_pylist():
            ends = np.cumsum(np.frombuffer(row["sizes"], "<i8")).tolist()
            raw = zstandard.ZstdDecompressor().decompress(row["data"])
            records += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            owners.append(np.frombuffer(row["owners"], "<i8"))
            counts.append(len(ends))
        marks = shared_windows(records, np.concatenate(owners))
        bits, at = [], 0
        for n in counts:
            bits.append(np.packbits(np.concatenate(marks[at : at + n])).tobytes())
            at += n
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "bits": pa.array(bits, pa.binary())})

    sent = map_batches(told, ask, "bucket long, block long, sizes binary, owners binary, data binary")
    found = sent.groupBy("bucket").applyInArrow(sort, "block long, bucket long, bits binary")
    found = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))
    found = materialize(found, "block-repeats")
    if not found.where(F.col("block") == FAILED).isEmpty():
        discard(replies, found)
        return None
    settled = replies.join(found, "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                yield finished(Block(row, seed), row, buckets)

    whole = blocks.join(settled, "block", "left")
    return map_batches(whole, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def finished(b: Block, row: dict, buckets: int) -> pa.RecordBatch:
    b.apply(row["replies"] or [], buckets)
    r, n = b.records, len(b.raw)
    # Records whose entry is owned by a smaller id: all their windows are repeats.
    entry_owner = np.where(b.bits[0], b.entries["least"], np.iinfo(np.int64).min)
    gone = b.ids[r.doc] > entry_owner[b.number] if len(r.first) else np.zeros(0, bool)
    begins, ends = [r.first[gone]], [r.last[gone] + WIDTH]
    found = {x["bucket"]: x["bits"] for x in row["found"] or []}
    windows: dict[int, list[np.ndarray]] = {}
    for bucket, which in b.asking(buckets):
        size = (r.last - r.first)[r.stands[which]] + 1
        bits = np.unpackbits(np.frombuffer(found[bucket], np.uint8))[: int(size.sum())].astype(bool)
        hits, ends_at = np.nonzero(bits)[0], np.cumsum(size)
        of = np.searchsorted(ends_at, hits, "right")
        for at in np.split(np.arange(len(hits)), np.nonzero(np.diff(of))[0] + 1) if len(hits) else ():
            e = of[at[0]]
            windows.setdefault(int(which[e]), []).append(hits[at] - (ends_at[e] - size[e]))
    if windows:
        hit = np.zeros(len(b.entries), bool)
        hit[list(windows)] = True
        for k in np.nonzero(hit[b.number] & ~gone)[0].tolist():
            at = r.first[k] + np.concatenate(windows[int(b.number[k])])
            begins.append(at)
            ends.append(at + WIDTH)
    begins, ends = (np.bincount(np.concatenate(x), minlength=n + 1) for x in (begins, ends))
    removed = np.cumsum(begins - ends)[:n] > 0
    opens = removed.copy()
    opens[1:] &= ~removed[:-1]
    opens[b.bounds[:-1][b.bounds[:-1] < n]] |= removed[b.bounds[:-1][b.bounds[:-1] < n]]
    gone_by, spans_by = (np.searchsorted(np.nonzero(x)[0], b.bounds) for x in (removed, opens))
    kept = np.frombuffer(b.raw, np.uint8)[~removed].tobytes()
    kept_by = (b.bounds - gone_by).tolist()
    out = [
        [None if null else int(i) for i, null in zip(b.ids, b.nulls, strict=True)],
        np.diff(b.bounds),
        np.diff(gone_by),
        np.diff(spans_by),
        [kept[s:e] for s, e in zip(kept_by[:-1], kept_by[1:], strict=True)],
    ]
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def brute_force(texts: list[tuple[int, bytes]], width: int = WIDTH) -> list[tuple[int, int, int, int, str]]:
    """The same by a table of all windows, for tests."""
    least: dict[bytes, int] = {}
    for i, t in texts:
        for k in range(len(t) - width + 1):
            w = t[k : k + width]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        cut = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if least[t[k : k + width]] < i:
                cut[k : k + width] = True
        spans = int(cut[:1].sum() + (np.diff(cut.astype(np.int8)) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~cut].tobytes()
        out.append((i, len(t), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
