"""Secret scan with a recursive decoding worklist.

Layer 0 is the text itself.  A worklist unwraps URL escapes, Unicode escapes,
base64 and zlib or gzip data until nothing decodes any more; a digest of every
layer seen on the way stops cycles.  Escapes are decoded in place, so their
layer is the whole layer above and a find may mix decoded and plain characters.
Bytes are scanned whatever they hold.  Each layer is rescanned, and every
decoded character knows the stretch of the text it came from, so that finds map
back.

Every step takes time in proportion to its layer.  Escapes within escapes beyond
``DEEP`` layers are decoded to the end in one pass, and compressed data of any
size are scanned in windows that overlap, one at a time.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, text_batches, text_of

#: The kinds of finds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: An assignment up to its value, and the rest of a value.
HEAD = re.compile(ASSIGN.pattern.rpartition("(")[0] + "(?=[A-Za-z0-9+/_.=-])")
VALUE = re.compile("[A-Za-z0-9+/_.=-]*")
ASSIGN_LEAST = 6
# A run of fewer characters fails as a whole, so asking for the length at once finds the same matches.
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")

URL = re.compile(r"%[0-9A-Fa-f]{2}")
#: Strings of strings double the backslash, so all those in front go.
ESCAPED = re.compile(r"(?<!\\)\\+(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})")
BOTH = re.compile(f"{URL.pattern}|{ESCAPED.pattern}")
#: A run of base64 from its first character on, line breaks included.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-](?:[ \t]*\r?\n[ \t]*)?){16,}+={0,2}")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PLAIN = str.maketrans("-_", "+/", " \t\r\n")
#: What decoded bytes need to hold for a find or another layer of text; everything else is left at once.
WORTH = re.compile(
    rb"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    rb"|(?:[A-Za-z0-9+/_-](?:[ \t]*\r?\n[ \t]*)?){16}"
)
#: Headers of gzip and, by window size, of zlib.
PACKED = re.compile(
    b"|".join([rb"\x1f\x8b\x08", *(b"%s[%s]" % (re.escape(bytes([c])), b"".join(re.escape(bytes([f])) for f in range(256) if (c * 256 + f) % 31 == 0 and not f & 32)) for c in range(8, 128, 16))]),
    re.DOTALL,
)
#: Layers of escapes within escapes that are scanned one by one.
DEEP = 12
#: Unfolded bytes that are scanned at a time, and how many of them again with the next ones.
WINDOW, OVERLAP = 32 << 20, 1 << 20

Span = tuple[str, int, int]


def find(text: str) -> list[Span]:
    """Finds in the text itself, by start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(out + runs(text), key=order)


def find_all(text: str) -> list[Span]:
    """Finds in a decoded layer; an assignment may begin inside of another one, whose value would hide it."""
    out, end = [], 0
    for m in HEAD.finditer(text):
        if m.end() >= end:  # else it is in the run of value characters whose end is known
            end = VALUE.match(text, m.end()).end()
        if end - m.end() >= ASSIGN_LEAST:
            out.append(("assign", m.start(), end))
    return sorted(out + runs(text), key=order)


def runs(text: str) -> list[Span]:
    out = [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Layer:
    """Decoded text and where its characters came from in the document: their starts and ends (never falling), one place for all, or neither in the document itself."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, place: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.place = text, starts, ends, place
        self.differ: np.ndarray | None = None
        #: Whether its compressed data are layers already, or it is the document, which cannot hold any.
        self.unpacked = starts is None and place is None

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.place is not None:
            return self.place
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def derive(self, text: str, first: Sequence[int], last: Sequence[int]) -> Layer:
        """A layer whose characters came from those of this one, first to last (inclusive)."""
        if self.place is not None:
            return Layer(text, place=self.place)
        first, last = np.asarray(first, np.int64), np.asarray(last, np.int64)
        return Layer(text, first, last + 1) if self.starts is None else Layer(text, self.starts[first], self.ends[last])

    def changed(self, document: np.ndarray, start: int, end: int) -> bool:
        """Whether a stretch is other characters than its place in the document (code points), so something in it was decoded."""
        if self.place is not None:
            return True
        if self.differ is None:
            here = code_points(self.text)
            same = (self.ends - self.starts == 1) & (document[self.starts] == here)
            same[1:] &= self.starts[1:] == self.ends[:-1]  # the characters of one base64 group share bits
            self.differ = np.r_[0, np.cumsum(~same)]
        return bool(self.differ[end] - self.differ[start + 1]) or not self.same_first(document, start)

    def same_first(self, document: np.ndarray, start: int) -> bool:
        return bool(self.ends[start] - self.starts[start] == 1 and document[self.starts[start]] == ord(self.text[start]))

    def mark(self) -> bytes:
        digest = hashlib.sha256(self.text.encode("utf-8", "surrogatepass"))
        for part in (self.starts, self.ends, repr(self.place).encode()):
            digest.update(b"" if part is None else part)
        return digest.digest()


BROKEN = -1


def unfolded(raw: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of the zlib or gzip data that begin at a place, each with the place where the data end if they do so there, else 0.

    Further gzip members go on with the data of the first one.  Data that are
    cut off give what there is; ``BROKEN`` as the place tells that what came
    since the last end was not such data, as is the case after most headers.
    """
    view, first = memoryview(raw), at
    while True:
        machine, step = zlib.decompressobj(47), 256  # most places that look like a header fail at once
        try:
            while at < len(raw) and not machine.eof:
                fed = view[at : at + step]
                at, step = at + len(fed), 1 << 16
                while len(fed) and not machine.eof:
                    out = machine.decompress(fed, WINDOW // 4)
                    fed = machine.unconsumed_tail
                    yield out, 0
                    if not out and not fed:
                        break
        except zlib.error:
            yield b"", BROKEN
            return
        if not machine.eof:
            return
        at -= len(machine.unused_data)
        yield b"", at
        if raw[first : first + 2] != b"\x1f\x8b" or raw[at : at + 3] != b"\x1f\x8b\x08":
            return


def windows(raw: bytes, at: int, size: int) -> Iterator[bytes]:
    """The first ``size`` unfolded bytes in overlapping windows."""
    held, fresh = bytearray(), 0
    for out, _ in unfolded(raw, at):
        out, size = out[:size], size - len(out)
        held += out
        fresh += len(out)
        if len(held) >= WINDOW:
            yield bytes(held)
            del held[:-OVERLAP]
            fresh = 0
        if size <= 0:
            break
    if fresh:
        yield bytes(held)


def unpack(layer: Layer, raw: bytes, tail: tuple[int, int] | None = None) -> Iterator[Layer]:
    """The compressed data anywhere in a layer's bytes; ``tail`` is the place that follows the last byte, padding included."""
    at = 0
    while m := PACKED.search(raw, at):
        size, whole, end = 0, 0, m.start()
        for out, ended in unfolded(raw, m.start()):
            size += len(out)
            if ended == BROKEN:
                size = whole
            elif ended:
                whole, end = size, ended
        at = max(end, m.start() + 1)
        if size:
            start, stop = layer.source(m.start(), end if end > m.start() else len(raw))
            if tail and end in (m.start(), len(raw)):
                stop = tail[1]
            for window in windows(raw, m.start(), size):
                yield Layer(window.decode("latin-1"), place=(start, stop))


def in_place(layer: Layer, pattern: re.Pattern) -> Layer | None:
    """The whole layer with every escape decoded, None if it has none.

    Each escape becomes one character, bytes as Latin-1: all patterns are ASCII,
    so the bytes of other characters need not be put together.
    """
    text, spans, at = [], [], 0
    for m in pattern.finditer(layer.text):
        a, b = m.span()
        code = int(layer.text[a:b].lstrip("\\%ux"), 16)
        text += [layer.text[at:a], "\ufffd" if 0xD800 <= code < 0xE000 else chr(code)]
        spans.append((a, b))
        at = b
    if not at:
        return None
    text.append(layer.text[at:])
    if layer.place is not None:
        return layer.derive("".join(text), (), ())
    a, b = np.array(spans, np.int64).T
    steps = np.zeros(len(layer.text) + 1, np.int32)
    np.add.at(steps, a + 1, 1)
    np.add.at(steps, b, -1)
    first = np.nonzero(np.cumsum(steps[:-1]) == 0)[0]
    last = first.copy()
    last[np.searchsorted(first, a)] = b - 1
    return layer.derive("".join(text), first, last)


HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def settle(layer: Layer, kinds: tuple[str, ...]) -> Layer | None:
    """The whole layer with all escapes decoded until none is left, in one pass, None if it has none.

    Characters go on a stack; as soon as its top is an escape, the decoded
    character takes its place, and may complete the next one.
    """
    chars: list[str] = []
    first: list[int] = []
    last: list[int] = []
    decoded = False

    def cut(n: int, code: int, end: int) -> None:
        start = first[-n]
        del chars[-n:], first[-n:], last[-n:]
        chars.append("\ufffd" if 0xD800 <= code < 0xE000 else chr(code))
        first.append(start)
        last.append(end)

    for i, c in enumerate(layer.text):
        chars.append(c)
        first.append(i)
        last.append(i)
        while chars[-1] in HEX_DIGITS:
            if "url" in kinds and len(chars) > 2 and chars[-3] == "%" and chars[-2] in HEX_DIGITS:
                cut(3, int("".join(chars[-2:]), 16), i)
            elif "escaped" in kinds and (n := next((k for k, sign in ((2, "x"), (4, "u")) if len(chars) > k + 1 and chars[-k - 1] == sign and chars[-k - 2] == "\\" and HEX_DIGITS.issuperset(chars[-k:])), 0)):
                code, size = int("".join(chars[-n:]), 16), n + 1
                while size < len(chars) and chars[-size - 1] == "\\":
                    size += 1
                cut(size, code, i)
            else:
                break
            decoded = True
    return layer.derive("".join(chars), first, last) if decoded else None


def from_base64(layer: Layer, begin: int, end: int) -> Iterator[Layer]:
    """What a run holds from each of its four alignments on, as bytes in Latin-1, and the compressed data in it.

    Text joined to its front, the separators of the alphabet too, moves the
    alignment only, and what follows spoils its own bytes only.
    """
    run = layer.text[begin:end]
    packed, places = run.rstrip("= \t\r\n").translate(PLAIN), None
    tail = layer.source(begin, begin + len(run.rstrip()))
    for k in range(4):
        part = packed[k : len(packed) - ((len(packed) - k) % 4 == 1)]
        raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        worth = WORTH.search(raw)
        if not worth and not PACKED.search(raw):
            continue
        if places is None:
            codes = np.frombuffer(run.encode("ascii"), np.uint8)
            places = begin + np.nonzero(codes > 32)[0]
        byte = np.arange(len(raw))
        inner = layer.derive(raw.decode("latin-1"), places[k + byte * 4 // 3], places[k + byte * 4 // 3 + 1])
        inner.unpacked = True
        yield from unpack(inner, raw, tail)
        if worth:
            yield inner


def children(layer: Layer, how: str, chain: int) -> Iterator[tuple[Layer, str, int]]:
    """The layers one step below, how they go on, and how many steps of escapes led to them.

    All escapes are decoded at once, and the two kinds also apart, since one may
    cut what the other completes.  A layer of one kind goes on with that kind, so
    layers do not multiply with every order of decoding.
    """
    kinds = tuple(k for k, sign in (("url", "%"), ("escaped", "\\")) if how in ("both", k) and sign in layer.text)
    if chain >= DEEP:
        if kinds and (got := settle(layer, ("url", "escaped") if how == "both" else (how,))):
            yield got, how, chain
    else:
        inner = {k: got for k in kinds if (got := in_place(layer, {"url": URL, "escaped": ESCAPED}[k]))}
        if len(inner) == 2:
            yield in_place(layer, BOTH), "both", chain + 1
            yield from ((got, k, chain + 1) for k, got in inner.items())
        else:
            yield from ((got, how, chain + 1) for got in inner.values())
    for m in BASE64.finditer(layer.text):
        if "\n" in m[0]:
            for line in BASE64_LINE.finditer(layer.text, *m.span()):
                yield from ((got, "both", 0) for got in from_base64(layer, *line.span()))
        yield from ((got, "both", 0) for got in from_base64(layer, *m.span()))
    if not layer.unpacked:
        yield from ((got, "both", 0) for got in unpack(layer, layer.text.encode("latin-1", "replace")))


def scan(text: str) -> list[tuple[str, int, int, int]]:
    """All finds as (kind, start, end, depth); those of depth 0 are in the text itself.

    The worklist is a stack of what is yet to come of each layer, so one layer of
    each depth is held at a time.
    """
    found = {span: 0 for span in find(text)}
    document: np.ndarray | None = None
    seen, work = set(), [children(Layer(text), "both", 0)]
    while work:
        step = next(work[-1], None)
        if step is None:
            work.pop()
            continue
        inner, onward, chain = step
        if (mark := (inner.mark(), onward)) in seen:
            continue
        seen.add(mark)
        for kind, a, b in find_all(inner.text):
            document = code_points(text) if document is None else document
            if inner.changed(document, a, b):
                start, end = inner.source(a, b)
                found[kind, start, end] = min(found.get((kind, start, end), len(work)), len(work))
        work.append(children(inner, onward, chain))
    return [(*span, found[span]) for span in sorted(found, key=order)]


def redact_text(text: str, spans: list[tuple[str, int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in sorted((s[1], s[2]) for s in spans):
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())]))
SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint,depth:int>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: kind, start, end (code points, end exclusive), depth of decoding.

    Null text counts as empty and has no spans; null ids and repeated rows pass
    through; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            spans = [[dict(zip(("kind", "start", "end", "depth"), s, strict=True)) for s in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPAN_TYPE)], ["doc_id", "spans"])

    ids = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_batches(ids, run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, spans {SPAN_SQL}")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with every found stretch of ``text_col`` replaced by ``mark``; null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = [t if t is None else redact_text(t, scan(t), mark) for t in batch.column(at).to_pylist()]
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return map_batches(rows, run, rows.schema)
