"""Secret scans that also look below nested encodings.

Every text is scanned for three kinds of secret.  A worklist then unwraps encoded stretches
(percent escapes, backslash-u and backslash-x escapes, numeric character references, base64, and what gzip or
zlib compressed), scans what comes out, and goes
on with the encoded stretches in that, until nothing new appears.  Each decoded layer carries a
map to the original text, so a secret found at any depth is reported at the least span that holds
it: to the character through escapes and base64, at the whole stretch through compression.  A layer whose content was seen before in the same text is not unwrapped
again, which ends cycles and repeated work.

Defined cases: null text is empty and has no spans; empty layers are dropped; overlapping finds
from different layers are all reported, equal (kind, start, end) once.  Bytes are read as UTF-8, with
a sign for each that is none, and as UTF-16 if any is zero.  What compressed data holds, in any number
of joined members and as far as it is whole, is scanned in overlapping windows of about
``MOST_INFLATED`` bytes; encoded data without a blank for that long is read in every phase in each window.  Repeated
rows are scanned each, texts of any length whole; an empty table gives no rows.  Columns named like
the operator's own cannot be kept (ValueError).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches, own_names, rows_of

KINDS = ("assign", "access", "hex")
# The three patterns, by the contract of the scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Runs are matched whole and searched inside, so that long ones without escapes take linear time.
URL_RUN, URL_BYTE = re.compile(r"[\w.~!$&'()*+,;=:@/?%-]+", re.ASCII), re.compile(r"%[0-9A-Fa-f]{2}")
RUN = re.compile(r"[\x21-\x7E]+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
UNIT = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
# How base64 of gzip and of zlib's usual headers begins (fixed values); anywhere in a run.
PACKED = re.compile(r"H4sI|eAE|eF4|eJ|eNo")
# Two lines or more; the first is one by itself as well.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
MOST_INFLATED = 32 << 20  #: bytes of an inflated stream that are scanned at once
MOST_PIECE = 1 << 20

Span = tuple[str, int, int]
Places = tuple[np.ndarray, np.ndarray]


def scan(text: str) -> list[Span]:
    """The base spans of one text, leftmost and not overlapping per kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def compressed(head: bytes) -> bool:
    """Whether gzip or zlib data begins so; text may have the signs of it, but does not inflate."""
    if not (head[:2] == b"\x1f\x8b" or len(head) > 2 and head[0] & 0x0F == 8 and (head[0] << 8 | head[1]) % 31 == 0):
        return False
    unpack = zlib.decompressobj(47)
    try:
        return bool(unpack.decompress(head, 64)) or unpack.eof
    except zlib.error:
        return False


def chunks(data: bytes) -> Iterator[bytes]:
    return (data[at : at + 512] for at in range(0, len(data), 512))


def inflate(source: Iterator[bytes]) -> Iterator[bytes]:
    """What joined gzip or zlib members hold, as far as they can be read; what follows them as it is."""
    unpack, begun = zlib.decompressobj(47), True
    for part in source:
        while part:
            if unpack is None:
                if not begun and len(part) < 3:
                    part += next(source, b"")
                if begun or not compressed(part):
                    begun = True
                    yield part
                    break
                unpack = zlib.decompressobj(47)
            try:
                out = unpack.decompress(part, MOST_PIECE)
            except zlib.error:
                unpack, begun = None, True
                break
            if out:
                yield out
            part = unpack.unconsumed_tail
            if unpack.eof:
                part, unpack, begun = unpack.unused_data, None, False
            elif not part and len(out) == MOST_PIECE:
                # the last of the output may still be held back
                while tail := unpack.decompress(b"", MOST_PIECE):
                    yield tail


def unpacked(data: bytes) -> Iterator[bytes]:
    """The content of compressed data in pieces, through any number of compressions; nothing if it is none.

    A content that begins as one further out did ends the descent, so data that holds itself does too.
    """
    source, heads = chunks(data), set()
    head = data[:4096]
    while compressed(head) and head not in heads:
        heads.add(head)
        source = inflate(source)
        pieces = []
        while sum(map(len, pieces)) < 4096 and (piece := next(source, None)) is not None:
            pieces.append(piece)
        joined = b"".join(pieces)
        if not joined:
            return iter(())
        head, source = joined[:4096], itertools.chain(chunks(joined), source)
    return source if heads else iter(())


def windows(source: Iterator[bytes]) -> Iterator[bytes]:
    """Stretches of about ``MOST_INFLATED`` bytes that end at a blank, if there is one, and overlap."""
    lap = min(4096, MOST_INFLATED // 4)
    held = bytearray()
    fresh = False
    for piece in source:
        held += piece
        fresh = True
        while len(held) > MOST_INFLATED:
            end = max(held.rfind(b" ", 2 * lap, MOST_INFLATED), held.rfind(b"\n", 2 * lap, MOST_INFLATED)) + 1 or MOST_INFLATED
            yield bytes(held[:end])
            del held[: end - lap]
    if fresh and held:
        yield bytes(held)


def decode(data: bytes) -> tuple[str, np.ndarray]:
    """UTF-8 text, with a sign for each byte that is none; where each character starts, and the number of bytes."""
    text = data.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    size[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    return text, np.append(0, np.cumsum(size))


def texts(data: bytes) -> Iterator[tuple[str, Callable[[], np.ndarray]]]:
    """The readings of decoded bytes, each with the starts of its characters: UTF-8, and UTF-16 if there are zeros."""
    if data.isascii():
        yield data.decode("ascii"), partial(np.arange, len(data) + 1)
    elif data:
        text, starts = decode(data)
        yield text, lambda: starts
    if b"\0" in data:
        for order in ("utf-16-le", "utf-16-be"):
            text = data.decode(order, "replace")
            # a lone surrogate or byte at the end is one sign as well
            units = np.cumsum([0, *(4 if c > "\uffff" else 2 for c in text)])
            if text:
                yield text, partial(np.minimum, units, len(data))


def kept(run: str, escapes: re.Pattern[str]) -> np.ndarray:
    """Where each item of an unescaped run starts in ``run``, and the run's length: an escape is one item."""
    first = np.ones(len(run), bool)
    for m in escapes.finditer(run):
        first[m.start() + 1 : m.end()] = False
    return np.append(np.flatnonzero(first), len(run))


def code_point(m: re.Match[str]) -> str:
    if m[1]:
        return chr(0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00)
    code = int(m[7]) if m[7] else int(m[3] or m[4] or m[5] or m[6], 16)
    return "\ufffd" if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code)


def unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def between(edges: np.ndarray) -> Places:
    return edges[:-1], edges[1:]


def url_map(run: str, starts: Callable[[], np.ndarray], at: int) -> Places:
    return between(at + kept(run, URL_BYTE)[starts()])


def unit_map(run: str, at: int) -> Places:
    return between(at + kept(run, UNIT))


def base64_map(starts: Callable[[], np.ndarray], at: np.ndarray) -> Places:
    """A character of base64 holds six bits; ``at`` are the places of these characters."""
    bits = starts() * 8
    return at[bits[:-1] // 6], at[(bits[1:] - 1) // 6] + 1


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Base64 in a line, and wrapped over lines: all of them, and from each line on whose length differs from
    the one before, as long as it stays the same, with the line after.

    What stands before encoded data may belong to its run (a path, a name), so a run is read from each of its first
    four characters, one of which the data is in step with, and from where compressed data begins in it.
    """
    for m in BASE64.finditer(text):
        for phase in range(4):
            yield m.start() + phase, m.end()
        for p in PACKED.finditer(text, m.start() + 4, m.end()):
            head = unbase64(text[p.start() : min(m.end(), p.start() + 256)])
            if head and compressed(head):
                yield p.start(), m.end()
    for m in WRAPPED.finditer(text):
        yield m.span()
        lines = [(m.start() + w.start(), m.start() + w.end()) for w in LINE.finditer(m[0])]
        sizes = [b - a for a, b in lines]
        at = 0
        while at < len(lines) - 1:
            to = at + 1
            while to < len(lines) and sizes[to] == sizes[at]:
                to += 1
            if (at, to) != (0, len(lines)):
                yield lines[at][0], lines[min(to, len(lines) - 1)][1]
            at = to


def layers(text: str) -> Iterator[tuple[int, int, str, Callable[[], Places] | None]]:
    """(start, end, content, places) of the encoded stretches of ``text``, each unwrapped once.

    Places are the start and end in ``text`` of every character of the content; None after
    compression, where all of the stretch counts.
    """
    if "%" in text:
        for m in URL_RUN.finditer(text):
            if URL_BYTE.search(m[0]):
                for out, starts in texts(unquote_to_bytes(m[0])):
                    yield m.start(), m.end(), out, partial(url_map, m[0], starts, m.start())
    if "\\u" in text or "\\x" in text or "&#" in text:
        for m in RUN.finditer(text):
            if UNIT.search(m[0]):
                yield m.start(), m.end(), UNIT.sub(code_point, m[0]), partial(unit_map, m[0], m.start())
    for start, end in stretches(text):
        body = text[start:end]
        lines = body.split("\n")
        data = unbase64("".join(line.rstrip("\r") for line in lines)) if len(lines) > 1 else unbase64(body)
        if not data:
            continue
        found = False
        if compressed(data):
            for part in windows(unpacked(data)):
                found = True
                for out, _ in texts(part):
                    yield start, end, out, None
        if not found:
            at = np.array([start + i for i, c in enumerate(body) if c not in "\r\n"]) if len(lines) > 1 else np.arange(start, end)
            for out, starts in texts(data):
                yield start, end, out, partial(base64_map, starts, at)


def below(layer: tuple[int, int, str, Places | None]) -> Iterator[tuple[int, int, str, Places | None]]:
    """The layers in a layer, with their places in the original text."""
    start, end, text, places = layer
    for a, b, inner, within in layers(text):
        if places is None:
            yield start, end, inner, None
        elif within is None:
            yield int(places[0][a]), int(places[1][b - 1]), inner, None
        else:
            lo, hi = within()
            yield int(places[0][a]), int(places[1][b - 1]), inner, (places[0][lo], places[1][hi - 1])


def unwrap(text: str, base: list[Span] | None = None) -> tuple[list[Span], int]:
    """Base spans and those of all decoded layers, in code points of ``text``; the number of layers."""
    found = set(scan(text) if base is None else base)
    seen = {hashlib.blake2b(f"0:{len(text)}:".encode() + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    # the layers of a text are drawn one at a time, so that of a stream only a window is held
    work = [((a, b, inner, places and places()) for a, b, inner, places in layers(text))]
    n = 0
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        start, end, inner, places = layer
        mark = hashlib.blake2b(f"{start}:{end}:".encode() + inner.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        n += 1
        if places is None:
            found.update((kind, start, end) for kind, _, _ in scan(inner))
        else:
            found.update((kind, int(places[0][a]), int(places[1][b - 1])) for kind, a, b in scan(inner))
        work.append(below(layer))
    return sorted(found, key=order), n


def order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with the union of its spans replaced."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, text: str, keep: list[str], redacted: bool = False) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans`` (arrays of kind, start, end), ``layers`` unwrapped and,
    if asked for, the ``redacted`` text."""
    own_names(keep, "base", "spans", "layers", "redacted")
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [df.schema[k] for k in keep] + [T.StructField("base", span), T.StructField("spans", span), T.StructField("layers", T.LongType())]
    fields += [T.StructField("redacted", T.StringType())] * redacted
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    record = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            schema = pa.schema([*(pa.field(k, batch.schema.field(i + 1).type) for i, k in enumerate(keep)), ("base", kind), ("spans", kind), ("layers", pa.int64()), *[("redacted", pa.string())] * redacted])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        body = row[0] or ""
                        base = sorted(scan(body), key=order)
                        spans, n = unwrap(body, base)
                        yield (*row[1:], record(base), record(spans), n, *[redact(body, spans) if row[0] is not None else None] * redacted)

            yield from batches(rows(), schema)

    return df.select(df[text].alias("_scanned"), *keep).mapInArrow(find, T.StructType(fields))
