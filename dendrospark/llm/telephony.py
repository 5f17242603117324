"""Media columns: telephony audio held in WAV containers.

Three companded or predictive codecs of telephony are supported, one byte of payload for one
8-bit sample (mu-law, A-law) or two 4-bit samples (IMA ADPCM).  Expansion of the first two is a
gather from a 256-entry table; ADPCM blocks are independent of each other, so the recurrence
runs over the positions inside a block while numpy steps all blocks of a batch at once.
Decoded sound is resampled by an integer factor with a windowed-sinc polyphase filter and
returned as 16-bit PCM.

``store`` makes containers and ``save`` writes a table, of containers or of PCM, to the shared folder
and reads it back.

Defined cases: a null or empty payload becomes one block of zero bytes; equal payloads give
equal containers and features; very long sounds are read whole and resampled in slices; an empty
table gives an empty result; further input columns are kept only if named in ``keep``, where names
of the operator's own columns are refused (ValueError).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialise, own_names, rows_of

UNIT = 64  #: payload bytes of an ADPCM block, and the unit that payloads are padded to
RATE = 8000
SLICE = 1 << 20  #: samples that are described and resampled at once
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}  #: WAVE format tags (fixed values)

# The step sizes and index moves of IMA ADPCM.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 0x0F
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, uint8 [n, 4 + m] -> int16 [n, 1 + 2 m]."""
    n, width = blocks.shape
    level = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = level
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        nibble = (codes[k >> 1] >> (4 * (k & 1))) & 0x0F
        step = STEPS[index]
        move = step >> 3
        move += np.where(nibble & 4, step, 0)
        move += np.where(nibble & 2, step >> 1, 0)
        move += np.where(nibble & 1, step >> 2, 0)
        level = np.clip(np.where(nibble & 8, level - move, level + move), -32768, 32767)
        index = np.clip(index + MOVES[nibble & 7], 0, len(STEPS) - 1)
        out[k + 1] = level
    return out.T


def filter_phases(factor: int, half: int = 4) -> np.ndarray:
    """Taps of the interpolation filter by phase: [factor, 2 half], each phase summing to 1."""
    at = np.arange(1 - half, half + 1)[None, :] - np.arange(factor)[:, None] / factor
    taps = np.sinc(at) * np.cos(np.pi * at / (2 * half + 1)) ** 2
    return (taps / taps.sum(1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, phases: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Samples ``start`` to ``stop`` of ``pcm``, ``len(phases)`` for each, rounded and clipped to 16 bits."""
    factor, taps = phases.shape
    half = taps // 2
    stop = len(pcm) if stop is None else stop
    low, high = max(0, start - half + 1), min(len(pcm), stop + half)
    padded = np.pad(pcm[low:high].astype(np.float32), (low - (start - half + 1), stop + half - high), mode="edge")
    n = stop - start
    out = np.empty((n, factor), np.int16)
    out[:, 0] = pcm[start:stop]
    for phase in range(1, factor):
        total = padded[:n] * phases[phase, 0]
        for k in range(1, taps):
            total += padded[k : k + n] * phases[phase, k]
        out[:, phase] = np.clip(np.rint(total), -32768, 32767)
    return out.ravel()


def wrap(payload: bytes, codec: str) -> bytes:
    """The WAV container of a payload whose length is a multiple of UNIT."""
    tag = CODECS[codec]
    if codec == "adpcm":
        cells = np.zeros((len(payload) // UNIT, 4 + UNIT), np.uint8)
        cells[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, samples = cells.tobytes(), 4 + UNIT, 4, (1 + 2 * UNIT) * len(cells)
        extra = struct.pack("<HH", 2, 1 + 2 * UNIT)
        speed = RATE * align // (1 + 2 * UNIT)
    else:
        data, align, bits, samples, extra, speed = payload, 1, 8, len(payload), struct.pack("<H", 0), RATE
    form = struct.pack("<HHIIHH", tag, 1, RATE, speed, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes) -> tuple[str, int, bytes]:
    """Codec, block size and sample bytes of a WAV container, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, codec, align, data = 12, "", 0, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, _, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            codec = next((k for k, v in CODECS.items() if v == tag), "")
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if not codec:
        raise ValueError("no telephony codec in the container")
    return codec, align, data


def padded(payload: Column) -> Column:
    """``payload`` with zero bytes appended up to a positive multiple of UNIT."""
    full = F.greatest(F.lit(UNIT), F.ceil(F.octet_length(payload) / UNIT) * UNIT).cast("int")
    return F.rpad(payload, full, F.lit(b"\x00"))


def codec_by_content(payload: Column) -> Column:
    """Deals contents to the three codecs evenly; equal contents get the same one."""
    return F.element_at(F.array(*(F.lit(c) for c in CODECS)), (F.crc32(payload) % 3 + 1).cast("int"))


def store(df: DataFrame, payload: str, codec: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``media``: each padded payload inside a WAV container of its codec."""
    own_names(keep, "media", payload, codec)
    fields = [df.schema[k] for k in keep] + [T.StructField("media", T.BinaryType())]

    def build(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = ((*row[2:], wrap(row[0], row[1])) for row in rows_of(batch, payload, codec, *keep))
            yield from batches(made, pa.schema([*(batch.schema.field(k) for k in keep), ("media", pa.binary())]))

    return df.select(payload, codec, *keep).mapInArrow(build, T.StructType(fields))


def load(df: DataFrame, media: str, keep: list[str], factor: int = 2, with_pcm: bool = True) -> DataFrame:
    """Reads containers back: ``payload``, the resampled ``pcm`` (16-bit, little-endian), ``feature``.

    The feature names codec, samples, peak, energy and zero crossings of the decoded sound, and
    count and checksum of the resampled one.
    """
    own_names(keep, "payload", "pcm", "feature", media)
    extra = [T.StructField("payload", T.BinaryType()), T.StructField("pcm", T.BinaryType()), T.StructField("feature", T.StringType())]
    laws = {"mulaw": mulaw_table(), "alaw": alaw_table()}
    phases = filter_phases(factor)

    def describe(codec: str, pcm: np.ndarray) -> tuple[bytes, str]:
        """The resampled sound and the feature; long sounds go through in slices."""
        peak = energy = crossings = crc = 0
        parts = []
        for at in range(0, len(pcm), SLICE):
            own = pcm[at : at + SLICE]
            wide = own.astype(np.int64)
            peak, energy = max(peak, int(np.abs(wide).max())), energy + int((wide * wide).sum())
            sign = pcm[at : at + SLICE + 1] >= 0
            crossings += int(np.count_nonzero(sign[1:] != sign[:-1]))
            made = resample(pcm, phases, at, at + len(own)).astype("<i2").tobytes()
            crc = zlib.crc32(made, crc)
            parts.append(made)
        out = b"".join(parts)
        return out, f"codec={codec};samples={len(pcm)};peak={peak};energy={energy};crossings={crossings};resampled={len(out) // 2};crc={crc}"

    def part(rows: list[tuple]) -> Iterator[tuple]:
        opened = [unwrap(r[0]) for r in rows]
        groups: dict[int, list[int]] = {}
        for i, (codec, align, _) in enumerate(opened):
            if codec == "adpcm":
                groups.setdefault(align, []).append(i)
        sound: dict[int, tuple[bytes, np.ndarray]] = {}
        for align, members in groups.items():
            cells = np.frombuffer(b"".join(opened[i][2] for i in members), np.uint8).reshape(-1, align)
            pcm, at = adpcm_blocks(cells), 0
            for i in members:
                n = len(opened[i][2]) // align
                sound[i] = cells[at : at + n, 4:].tobytes(), pcm[at : at + n].ravel()
                at += n
        for i, row in enumerate(rows):
            codec, _, data = opened[i]
            payload, pcm = sound.pop(i) if i in sound else (data, laws[codec][np.frombuffer(data, np.uint8)])
            resampled, feature = describe(codec, pcm)
            yield (*row[1:], payload, resampled if with_pcm else None, feature)

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            schema = pa.schema([*(batch.schema.field(k) for k in keep), ("payload", pa.binary()), ("pcm", pa.binary()), ("feature", pa.string())])
            held: list[tuple] = []
            weight = 0
            for row in rows_of(batch, media, *keep):
                held.append(row)
                weight += len(row[0])
                if weight > 2 << 20:
                    yield from batches(part(held), schema)
                    held, weight = [], 0
            yield from batches(part(held), schema)

    return df.select(media, *keep).mapInArrow(read, T.StructType([df.schema[k] for k in keep] + extra))


def save(df: DataFrame, name: str) -> DataFrame:
    """Containers or sounds, stored in the shared folder and read from there."""
    return materialise(df, name)
