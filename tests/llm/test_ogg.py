import hashlib
import random
import zlib

import pytest

from quillmatch.llm import ogg


def slow_checksum(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else r << 1
    return r


def test_checksum():
    rng = random.Random(6)
    for n in (0, 1, 5, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [576, 1152, 576 * 63, 576 * 200, 576 * 1000])
@pytest.mark.parametrize("streams", [1, 2, 3])
def test_round_trip(n, streams):
    data = random.Random(n).randbytes(n)
    payload, feature = ogg.samples(ogg.write(data, streams))
    assert payload == data and f"streams={streams};" in feature and f"seconds={n / 8000:.3f}" in feature


def test_levels():
    data = bytes([128, 130, 126, 255, 0, 128]) * 96
    _, feature = ogg.samples(ogg.write(data))
    levels = [b - 128 for b in data]
    mean, rms = sum(levels) / 576, (sum(x * x for x in levels) / 576) ** 0.5
    crossings = sum((a < 0) != (b < 0) for a, b in zip(levels, levels[1:]))
    assert feature.endswith(f"mean={mean:.3f};rms={rms:.3f};peak=128;crossings={crossings}")


def test_packets_over_pages():
    packets = [b"h", b"", b"x" * 255, b"y" * 200_000, b"z" * 510]
    data = b"".join(ogg.pages_of(packets, [0, 1, 2, 3, 4], 9))
    (serial, s), = ogg.read(data).items()
    assert serial == 9 and s.packets == packets and s.granule == 4


def test_damage_is_found():
    data = ogg.write(random.Random(1).randbytes(576 * 300))
    for at in (3, 30, 5000, len(data) - 1):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises(ValueError):
            ogg.read(broken)
    second = data.index(b"OggS", data.index(b"OggS", 1) + 1)
    third = data.index(b"OggS", second + 1)
    for broken in (data[:-1], data[:third], data[:second] + data[third:]):
        with pytest.raises(ValueError):
            ogg.read(broken)


def test_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 288, "long " * 30_000, "a", "a"]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in ogg.op7_ogg_media(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        r = got[i or None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert got[2][1:] == got[5][1:]
    assert ogg.media(df.limit(0)).count() == 0
