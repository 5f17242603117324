import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from dendrospark.llm import telephony
from dendrospark.llm.entry import op1_telephony_audio

from .conftest import TEXTS


def test_tables_match_known_points():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0x80], a[0x2A]) == (8, -8, 5504, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def plain_adpcm(block):
    level, index, out = int.from_bytes(block[:2], "little", signed=True), block[2], []
    out.append(level)
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            move = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            level = max(-32768, min(32767, level - move if nibble & 8 else level + move))
            index = max(0, min(88, index + int(telephony.MOVES[nibble & 7])))
            out.append(level)
    return out


def test_adpcm_blocks_against_one_at_a_time():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (40, 4 + telephony.UNIT), np.uint8)
    blocks[:, 2] = rng.integers(0, 89, 40)
    assert telephony.adpcm_blocks(blocks).tolist() == [plain_adpcm(b.tolist()) for b in blocks]


def test_resample_keeps_samples_and_constants():
    pcm = np.array([5, -7, 32767, -32768, 9] * 20, np.int16)
    out = telephony.resample(pcm, telephony.filter_phases(2))
    assert out[::2].tolist() == pcm.tolist() and len(out) == 2 * len(pcm)
    assert set(telephony.resample(np.full(50, 1234, np.int16), telephony.filter_phases(3)).tolist()) == {1234}


@pytest.mark.parametrize("codec", telephony.CODECS)
def test_container_round_trip(codec):
    payload = bytes(range(256)) * 2
    found, align, data = telephony.unwrap(telephony.wrap(payload, codec))
    assert found == codec
    assert (b"".join(data[i + 4 : i + align] for i in range(0, len(data), align)) if codec == "adpcm" else data) == payload


def test_bad_container():
    with pytest.raises(ValueError):
        telephony.unwrap(b"RIFFxxxxJUNK")


def test_query_on_edge_cases(spark, documents, folder):
    rows = op1_telephony_audio(spark, folder(documents=documents)).collect()
    expected = Counter()
    for i, text in TEXTS:
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        expected[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == expected
    same = {(r.payload_sha256, r.media_sha256, r.feature, r.media_bytes) for r in rows}
    assert len(same) == len({r.payload_sha256 for r in rows})
    assert all(r.pcm_bytes >= 4 * r.payload_bytes for r in rows)


def test_empty_table(spark, no_documents, folder):
    assert op1_telephony_audio(spark, folder(documents=no_documents)).count() == 0


def test_long_sounds_are_resampled_in_slices():
    pcm = np.random.default_rng(1).integers(-32768, 32767, 5000).astype(np.int16)
    phases = telephony.filter_phases(3)
    whole = telephony.resample(pcm, phases)
    parts = [telephony.resample(pcm, phases, a, min(a + 7, len(pcm))) for a in range(0, len(pcm), 7)]
    assert (np.concatenate(parts) == whole).all()


def test_sounds_are_stored_and_read_back(spark):
    docs = spark.createDataFrame([(i, bytearray(bytes([i]) * 64), c) for i, c in enumerate(telephony.CODECS)], "id long, payload binary, codec string")
    media = telephony.save(telephony.store(docs, "payload", "codec", ["id"]), "media")
    pcm = telephony.save(telephony.load(media, "media", ["id"]).select("id", "pcm"), "pcm")
    made = {r.id: bytes(r.pcm) for r in telephony.load(media, "media", ["id"]).collect()}
    assert {r.id: bytes(r.pcm) for r in pcm.collect()} == made and all(len(v) >= 256 for v in made.values())
    with pytest.raises(ValueError, match="media"):
        telephony.store(docs.withColumn("media", docs.payload), "payload", "codec", ["id", "media"])
