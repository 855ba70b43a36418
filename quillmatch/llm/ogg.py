"""Operator 7: Ogg media columns.

Writes and reads Ogg bitstreams in a binary column: page checksums are verified, packets reassembled from lacing
values across pages, logical streams demultiplexed by serial number, and timestamps derived from granule positions.
Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")  # capture, version, flags, granule, serial, sequence, checksum, segments
NO_GRANULE = -1

RATE = 8000
BLOCK = 576
#: Packets of one page; a page's 255 lacing values hold 65,025 bytes.
PACKETS = 64
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<8sBBIQ")  # magic, channel, channels, rate, samples of all channels together


def checksum(page: bytes) -> int:
    """The page checksum: polynomial 0x04C11DB7, not reflected, from 0, without a final inversion.

    zlib's CRC is the reflected form of the same polynomial, so bit-reversed bytes give the bit-reversed result.
    """
    value = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "little").translate(_FLIP), "big")


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def pages_of(packets: list[bytes], granules: list[int], serial: int) -> Iterator[bytes]:
    """One logical stream: the first packet on a page of its own, the others in pages of PACKETS packets or 255 lacing values."""
    flags, sequence = FIRST, 0
    lacing, body, granule, held = bytearray(), [], NO_GRANULE, 0
    for n, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        begin, values = 0, bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        for i, v in enumerate(values):
            lacing.append(v)
            body.append(packet[begin : begin + v])
            begin += v
            ends = i == len(values) - 1
            if ends:
                granule, held = at, held + 1
            last = ends and n == len(packets) - 1
            if last or len(lacing) == 255 or ends and (n == 0 or held == PACKETS):
                yield page(flags | LAST * last, granule, serial, sequence, bytes(lacing), b"".join(body))
                flags, sequence = CONTINUED * (not ends), sequence + 1
                lacing, body, granule, held = bytearray(), [], NO_GRANULE, 0


def write(payload: bytes, streams: int = 2) -> bytes:
    """Samples of 8 bits, in blocks of BLOCK dealt out to `streams` logical streams in turn; pages are interleaved."""
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    tracks = []
    for s in range(streams):
        mine = blocks[s::streams]
        granules, total = [0], 0
        for b in mine:
            total += len(b)
            granules.append(total)
        tracks.append(pages_of([_HEAD.pack(b"PCM8\0\0\0\0", s, streams, RATE, len(payload)), *mine], granules, s + 1))
    out, first = [], [next(t) for t in tracks]  # the first pages of all streams come first
    out += first
    while tracks:
        for t in list(tracks):
            p = next(t, None)
            if p is None:
                tracks.remove(t)
            else:
                out.append(p)
    return b"".join(out)


class Stream:
    def __init__(self) -> None:
        self.packets: list[bytes] = []
        self.times: list[float] = []  # seconds at the end of each page that ends a packet
        self.pages, self.granule, self.sequence, self.ended = 0, 0, 0, False
        self.open: list[bytes] = []


def read(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. Raises ValueError on a broken page, a lost page or a packet without its end."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError(f"a page is cut short at byte {at}")
        capture, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        if capture != CAPTURE or version:
            raise ValueError(f"no page at byte {at}")
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError(f"a page is cut short at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise ValueError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if sequence != s.sequence or s.ended or bool(flags & CONTINUED) != bool(s.open):
            raise ValueError(f"a page of stream {serial} is missing before byte {at}")
        body = at + HEADER.size + n
        for v in lacing:
            s.open.append(data[body : body + v])
            body += v
            if v < 255:
                s.packets.append(b"".join(s.open))
                s.open = []
        if granule != NO_GRANULE:
            s.granule = granule
            s.times.append(granule / RATE)
        s.pages, s.sequence, s.ended, at = s.pages + 1, s.sequence + 1, bool(flags & LAST), end
    if bad := [k for k, s in streams.items() if s.open or not s.ended]:
        raise ValueError(f"streams without an end: {bad}")
    return streams


def samples(data: bytes) -> tuple[bytes, str]:
    """The samples that write() stored, and a line on them and their container: streams, pages, packets, samples, seconds, time of the last page;
    mean, root mean square and peak of the levels (128 is silence), and how often their sign changes."""
    streams = read(data)
    tracks: dict[int, list[bytes]] = {}
    count = total = 0
    for s in streams.values():
        magic, track, count, rate, total = _HEAD.unpack(s.packets[0])
        if magic != b"PCM8\0\0\0\0" or rate != RATE or s.granule != sum(map(len, s.packets[1:])):
            raise ValueError("not a stream of samples, or its granule positions are wrong")
        tracks[track] = s.packets[1:]
    if sorted(tracks) != list(range(count)):
        raise ValueError("streams are missing")
    blocks: list[bytes] = [b""] * sum(map(len, tracks.values()))
    for k, v in tracks.items():
        blocks[k::count] = v
    payload = b"".join(blocks)
    if len(payload) != total:
        raise ValueError("samples are missing")
    pages, packets = sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values())
    last = max(s.times[-1] for s in streams.values())
    level = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    loud = f"mean={level.mean():.3f};rms={np.sqrt((level * level).mean()):.3f};peak={np.abs(level).max()};crossings={np.count_nonzero(np.diff(level < 0))}"
    return payload, f"streams={len(streams)};pages={pages};packets={packets};samples={total};seconds={total / RATE:.3f};last_page={last:.3f};{loud}"


def media(docs: DataFrame, batch: int = 64) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, media (binary, an Ogg bitstream), payload (binary, read back from it), feature.

    The payload is the text's UTF-8 bytes and then bytes 255 up to a positive multiple of 576. Null and empty text: 576 bytes 255.
    Equal texts: equal values. Repeated rows: a row each. Null doc_id: kept. Empty table: no rows. Other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part, rows = pdf.iloc[lo : lo + batch], []
                for raw in part["raw"]:
                    stored = write(raw + b"\xff" * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0))
                    payload, feature = samples(stored)
                    rows.append((len(raw), stored, payload, feature))
                out = pd.DataFrame(rows, columns=["n_bytes", "media", "payload", "feature"])
                out.insert(0, "doc_id", part["doc_id"].array)
                yield out

    raw = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    out = raw.mapInPandas(run, "doc_id string, n_bytes long, media binary, payload binary, feature string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    tail = F.substring("payload", -32, 32)
    return m.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_ogg_media": op7_ogg_media}
