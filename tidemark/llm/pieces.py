"""SentencePiece encoding and decoding with a batched numpy Viterbi.

The vocabulary at hand merges pairs by rank, so the best path is the one whose
neighbouring pieces no merge would ever join.  Words of equal length advance
together, character by character: for every piece length the substring's hash
probes the sorted piece keys, the pieces that go with the best piece before
them are the candidates, and the maximum over them is kept as the backpointer.
For merges by rank at most one candidate per place survives, which makes the
path exactly the library's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, text_batches, text_of

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 300_000
#: Words of more characters are cut first, which scripts without spaces need.
LONG_WORD = 24
#: Marks a word that follows a line end directly.
INNER = "\x02"
NEVER = np.int64(1) << 40


def default_model() -> str:
    """Path of the piece model that the machine offers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chars(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Pieces:
    """Vocabulary tables of a merge-by-rank model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        normal = [i for i in range(n) if not model.is_byte(i) and i not in self.special and not model.is_unused(i)]
        self.rank = np.full(n, NEVER)
        self.rank[normal] = [round(-model.get_score(i)) for i in normal]
        self.id = {self.text[i]: i for i in normal}
        self.longest = max(map(len, self.id))
        self.newline_splits = not any("\n" in t for t in self.id)
        with np.errstate(over="ignore"):
            hashes = np.zeros(len(normal), np.uint64)
            sizes = np.array([len(self.text[i]) for i in normal])
            for size in np.unique(sizes):
                own = np.nonzero(sizes == size)[0]
                hashes[own] = self.hash_rows(chars([self.text[normal[i]] for i in own]))
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(normal)[order]
        #: Characters of the pieces, to confirm what hashes find, and pairs of characters that lie next to each other in a piece.
        self.codes = np.zeros((n, self.longest), np.uint64)
        for i in normal:
            self.codes[i, : len(self.text[i])] = chars([self.text[i]])[0]
        inside = (self.codes[:, :-1] << np.uint64(32) | self.codes[:, 1:])[self.codes[:, 1:] > 0]
        self.neighbours = np.unique(inside)
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces have one key")
        pairs = {}
        for t, i in self.id.items():
            for cut in range(1, len(t)):
                a, b = self.id.get(t[:cut]), self.id.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = self.rank[i]
        self.n = n
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self._spines()
        self.memory = np.full(1 << 20, -2, np.int64)

    @staticmethod
    def hash_rows(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for c in codes.T:
                h = mixed(h * BASE + c + np.uint64(1))
        return h

    def merges(self, text: str) -> list[tuple[int, str, str]]:
        """The merges (rank, left, right) that build up ``text``, in their order."""
        parts, done = list(text), []
        while True:
            options = [(self.rank[self.id[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id]
            if not options:
                return done if len(parts) == 1 else []
            rank, k = min(options)
            done.append((int(rank), parts[k], parts[k + 1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _spines(self) -> None:
        """For each piece its right-most and left-most parts over time, with the rank of the merge that ends each."""
        depth = self.longest
        self.right, self.right_end = np.full((self.n, depth), -1), np.full((self.n, depth), NEVER)
        self.left, self.left_end = np.full((self.n, depth), -1), np.full((self.n, depth), NEVER)
        self.reachable = np.zeros(self.n, bool)
        final: dict[str, tuple[int, str, str] | None] = {}
        for t, i in self.id.items():
            steps = self.merges(t) if len(t) > 1 else []
            final[t] = steps[-1] if steps else None
            self.reachable[i] = len(t) == 1 or bool(steps)
        for t, i in self.id.items():
            if not self.reachable[i]:
                continue
            for table, ends, side in ((self.right, self.right_end, 2), (self.left, self.left_end, 1)):
                chain, x = [(t, NEVER)], t
                while final[x]:
                    rank, x = final[x][0], final[x][side]
                    if x not in self.id:
                        break
                    chain.append((x, rank))
                for k, (part, end) in enumerate(reversed(chain)):
                    table[i, k], ends[i, k] = self.id[part], end

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def goes_with(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge ever joins across the border of pieces ``a`` and ``b``; remembers recent pairs."""
        keys = a * self.n + b
        slot = ((keys * 0x9E3779B1) >> 7) & (len(self.memory) - 1)
        known = self.memory[slot]  # twice the key, plus the answer
        out = (known & 1).astype(bool)
        miss = np.nonzero(known >> 1 != keys)[0]
        if len(miss):
            out[miss] = self._goes_with(a[miss], b[miss])
            self.memory[slot[miss]] = 2 * keys[miss] + out[miss]
        return out

    def _goes_with(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same, from the merges.

        Both sides' merges happen by rank, the left one first if equal; a merge
        across the border happens if its rank comes before both next ones.
        """
        ok = np.ones(len(a), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            cross = self.pair_rank(self.right[x, i[live]], self.left[y, j[live]])
            ends_a, ends_b = self.right_end[x, i[live]], self.left_end[y, j[live]]
            joined = (cross < ends_a) & (cross <= ends_b) & (cross < NEVER)
            ok[live[joined]] = False
            go = ~joined & ((ends_a < NEVER) | (ends_b < NEVER))
            first = ends_a <= ends_b
            i[live[go & first]] += 1
            j[live[go & ~first]] += 1
            live = live[go]
        return ok

    def apart(self, word: str) -> list[str]:
        """The word cut where two characters meet that no piece has next to each other: no merge crosses there."""
        c = chars([word])[0]
        pairs = c[:-1] << np.uint64(32) | c[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pairs), len(self.neighbours) - 1)
        cuts = (np.nonzero(self.neighbours[at] != pairs)[0] + 1).tolist() if len(self.neighbours) else list(range(1, len(word)))
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Piece ids (little-endian uint32) of words of equal length; an unknown character is its bytes (or -1 if the model has none)."""
        codes = chars(words)
        n, size = codes.shape
        last = np.full((n, size + 1), -1)  # the piece that ends the best path here; -1 before the first, -2 an unknown character
        step = np.zeros((n, size + 1), np.int64)
        known = np.ones((n, size + 1), bool)
        hashes = np.zeros((n, size), np.uint64)  # of the substring from each place, grown by one character a round
        table = np.full((size + 1, self.longest + 1, n), -1, np.int32)  # piece by its end and length
        for length in range(1, min(self.longest, size) + 1):
            with np.errstate(over="ignore"):
                hashes = mixed(hashes[:, : size - length + 1] * BASE + codes[:, length - 1 :] + np.uint64(1))
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            found = np.where(self.keys[at] == hashes, self.key_ids[at], -1)
            found[(found >= 0) & ~self.reachable[found]] = -1
            for k in range(length):
                found[(found >= 0) & (self.codes[found, k] != codes[:, k : size - length + 1 + k])] = -1
            for start in range(size - length + 1):
                table[start + length, length] = found[:, start]
        for end in range(1, size + 1):
            choice = np.full(n, -1)
            for length in range(1, min(self.longest, end) + 1):
                piece = table[end, length].astype(np.int64)
                rows = np.nonzero((piece >= 0) & known[:, end - length])[0]
                if not len(rows):
                    continue
                before = last[rows, end - length]
                free = before < 0
                fits = free.copy()
                fits[~free] = self.goes_with(before[~free], piece[rows][~free])
                rows = rows[fits]
                better = rows[piece[rows] > choice[rows]]
                choice[better], step[better, end] = piece[better], length
            last[:, end] = choice
            alone = (choice < 0) & (table[end, 1] < 0)
            last[alone, end], step[alone, end] = -2, 1
            known[:, end] = (choice >= 0) | (alone & known[:, end - 1])
        return self._paths(words, last, step)

    def _paths(self, words: list[str], last: np.ndarray, step: np.ndarray) -> list[bytes]:
        """Follow the backpointers of all words together."""
        n, size = last.shape[0], last.shape[1] - 1
        ids, count, at, rows = np.zeros((n, size), "<u4"), np.zeros(n, np.int64), np.full(n, size), np.arange(n)
        odd = set(np.nonzero((last[:, 1:] == -2).any(axis=1))[0].tolist())
        live = rows
        while len(live):
            ids[live, size - 1 - count[live]] = np.maximum(last[live, at[live]], 0)
            count[live] += 1
            at[live] -= step[live, at[live]]
            live = live[at[live] > 0]
        raw, width, first = ids.tobytes(), 4 * size, (size - count) * 4
        out = [raw[r * width + f : (r + 1) * width] for r, f in enumerate(first.tolist())]
        for r in odd:
            path, k = [], size
            while k:
                if last[r, k] == -2:
                    path += [self.byte.get(b, 0) for b in reversed(words[r][k - 1].encode("utf-8", "surrogatepass"))]
                else:
                    path.append(int(last[r, k]))
                k -= int(step[r, k])
            out[r] = np.asarray(path[::-1], "<u4").tobytes()
        return out


class Codec:
    """Encodes and decodes texts; remembers words."""

    def __init__(self, path: str):
        self.pieces, self.known = Pieces(path), {}
        p = self.pieces
        self.raw = [bytes([p.byte_of[i]]) if i in p.byte_of else b"" if i in p.special else t.replace(SPACE, " ").encode() for i, t in enumerate(p.text)]
        self.cut = re.compile(" *[^ \n]+| +|\n" if self.pieces.newline_splits else " *[^ ]+| +").findall

    def learn(self, words: set[str]) -> None:
        """Remember the ids of new words (a leading space is the word's own); long ones are put together from what they can be cut into."""
        long = {w: self.pieces.apart(w.replace(" ", SPACE)) for w in words if len(w) > LONG_WORD}
        runs = {w: w.replace(" ", SPACE) for w in words if w not in long}
        by_size: dict[int, list[str]] = {}
        for run in set(runs.values()).union(*long.values()):
            by_size.setdefault(len(run), []).append(run)
        coded: dict[str, bytes] = {}
        for size, some in by_size.items():
            step = max(1, 200_000 // size)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                coded.update(zip(part, self.pieces.viterbi(part), strict=True))
        self.known.update((w, coded[run]) for w, run in runs.items())
        self.known.update((w, b"".join(map(coded.__getitem__, parts))) for w, parts in long.items())

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids (little-endian uint32) of each text (strings without null)."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        texts = texts.to_pylist()
        out: list[bytes] = [b""] * len(texts)
        even = [i for i, t in enumerate(texts) if t and "  " not in t and t[0] != " " and INNER not in t and self.pieces.newline_splits]
        self._encode_even(even, texts, out)
        rest = [i for i in sorted(set(range(len(texts))) - set(even)) if texts[i]]
        split = [self.cut(" " + texts[i]) for i in rest]
        self.learn(set().union(*split).difference(self.known))
        for i, words in zip(rest, split, strict=True):
            out[i] = b"".join(map(self.known.__getitem__, words))
        return out

    def _encode_even(self, even: list[int], texts: list[str], out: list[bytes]) -> None:
        """Texts of words between single spaces and line ends: distinct words once per batch."""
        if not even:
            return
        # A line end stands alone; what follows it directly is marked, since it has no space of its own.
        rows = pc.replace_substring(pa.array([texts[i] for i in even], pa.string()), "\n", f" \n {INNER}")
        split = pc.split_pattern(rows, " ")
        words = split.flatten().dictionary_encode()
        own = [w[1:] if w[:1] == INNER else w if w == "\n" else " " + w for w in words.dictionary.to_pylist()]
        self.learn(set(own).difference(self.known, [""]))
        coded = [self.known[w] if w else b"" for w in own]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(coded), "<u4")
        which = words.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        raw = pool[np.repeat(start[which] - (ends - n), n) + np.arange(n.sum())].tobytes()
        bounds = (4 * np.r_[0, ends][split.offsets.to_numpy()]).tolist()
        for k, i in enumerate(even):
            out[i] = raw[bounds[k] : bounds[k + 1]]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes in a row, without the first space."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian uint32) of each row.

    Null and empty texts have no ids; null ids and repeated rows pass through;
    an empty table gives an empty result; other columns are ignored.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 6 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec(path).encode(batch.column(1)), pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and text of encoded rows; null ids decode to the empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 4 << 20):
            texts = [codec(path).decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")
