"""Operator 10: suffix-array dedup of byte strings, sorted deep-shallow.

A byte goes if a `width`-byte string over it also starts in a document of smaller doc_id.

Round 1 leaves out what can't repeat. Every window of `width` bytes has an anchor, the window's `gram`-byte string of least
hash; equal windows have equal anchors, so a window whose anchor occurs in one document alone is unique. One short hash for
each distinct anchor of a part (about 1 a 14 bytes) goes out, one bit comes back.
Round 2 sends the text of the other windows, joined into segments (runs of windows over one anchor, at most
width + width - gram bytes), each distinct segment once a part, to a bucket of the anchor's hash. The bucket sorts the suffixes of
its distinct segments: multikey quicksort over super-characters of 5 bytes to a shallow depth, then blind tries for the
groups whose common prefix is longer (a trie's branching depths are found against one member of the group, and its
branches are sorted by depth and branching byte alone). Suffixes that agree to `width` bytes form a class; its least document
decides for all. A bit for each window comes back to each part.
A copy of a whole text with a smaller doc_id takes no part. A passage that all documents hold costs a segment a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm import hashing as H
from quillmatch.llm.hashing import U
from quillmatch.llm.parts import KEYS, MASKS, REPLY, Parts, Reply, answered, bucket_slices, key_rows, outward, pack, short, unpack
from quillmatch.llm.substring_dedup import intervals

BITS = 40
SHALLOW = 20
SUPER = 5


def remove_repeated_bytes(docs: DataFrame, width: int = 50, gram: int = 24, bytes_per_part: int = 4 << 20) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, spans array<struct<start, end>> (bytes, end exclusive), kept (binary).

    Null text: as empty. Texts shorter than `width` keep all. Null doc_id: counts as smaller than all others. Repeated rows: rows of
    one doc_id never remove each other's bytes. Empty table: no rows. Other columns are ignored. width - gram is 31 at most.
    """
    if not 0 < gram <= width or width - gram > 31:
        raise ValueError("gram must be from width - 31 to width")
    parts = Parts(docs, keys_per_byte=0.075, bytes_per_part=bytes_per_part, keys_per_bucket=1 << 17)
    bits, homes = parts.bucket_bits, parts.homes

    def anchors(part: int, docs: pd.DataFrame, reply: Reply) -> pd.DataFrame:
        found = [s.anchor for s in segments(docs, reply.copy, width, gram, bits)]
        return key_rows(part, np.unique(np.concatenate(found)) if found else np.empty(0, U), BITS)

    def suspects(docs: pd.DataFrame, reply: Reply) -> tuple[list[Segments], np.ndarray, np.ndarray, np.ndarray]:
        """The pieces, which of all their segments may repeat, and for those the distinct ones: index of the first, number."""
        pieces = list(segments(docs, reply.copy, width, gram, bits))
        if not pieces:
            return [], np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)
        anchor, doc = (np.concatenate([getattr(p, x) for p in pieces]) for x in ("anchor", "doc"))
        keys, inverse = np.unique(anchor, return_inverse=True)
        least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
        np.minimum.at(least, inverse, doc)
        np.maximum.at(most, inverse, doc)
        maybe = (reply.bits(keys, BITS) | (least < most))[inverse]
        at = np.flatnonzero(maybe)
        kind, first = distinct(text for p, m in zip(pieces, np.split(maybe, np.cumsum([len(p.anchor) for p in pieces])[:-1]), strict=True) for text in p.texts(np.flatnonzero(m), width))
        first = at[first]
        order = np.argsort(anchor[first], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = np.full(len(anchor), -1)
        number[at] = rank[kind]
        return pieces, maybe, first[order], number

    def send(part: int, docs: pd.DataFrame, reply: Reply) -> pd.DataFrame:
        pieces, _, firsts, _ = suspects(docs, reply)
        rows = []
        if len(firsts):
            anchor, doc, windows = (np.concatenate([getattr(p, x) for p in pieces]) for x in ("anchor", "doc", "windows"))
            doc = doc_codes(part, docs["k"], homes.value)[doc]
            base = np.cumsum([0] + [len(p.anchor) for p in pieces])
            piece = np.searchsorted(base, firsts, "right") - 1
            for bucket, lo, n in bucket_slices(anchor[firsts], BITS):
                own, texts = firsts[lo : lo + n], []
                for j, p in zip(own.tolist(), piece[lo : lo + n].tolist(), strict=True):
                    texts += pieces[p].texts([j - base[p]], width)
                rows.append((bucket, part, pack(anchor[own], BITS), windows[own].astype(np.uint8).tobytes(), doc[own].tobytes(), b"".join(texts)))
        return pd.DataFrame(rows, columns=["bucket", "part", "anchors", "windows", "docs", "texts"])

    def sort(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ignore_index=True)
        masks = removed_windows(pdf, width)
        return pd.DataFrame({"part": pdf["part"].astype("int32"), "kind": np.int32(MASKS), "bucket": np.int32(key[0]), "blob": masks, "ids": None})

    def finish(part: int, docs: pd.DataFrame, reply: Reply) -> pd.DataFrame:
        pieces, maybe, firsts, number = suspects(docs, reply)
        out_masks: dict[int, np.ndarray] = {}
        if len(firsts):
            anchor, doc = (np.concatenate([getattr(p, x) for p in pieces]) for x in ("anchor", "doc"))
            mask = reply.masks(anchor[firsts], BITS)[number]
            # a later document of the part holds the whole segment again
            mask = np.where(doc > doc[firsts][number], np.uint32(0xFFFFFFFF), mask)
            base = 0
            for p in pieces:
                n = len(p.anchor)
                hit = np.flatnonzero(maybe[base : base + n] & (mask[base : base + n] != 0))
                if len(hit):
                    flags = np.unpackbits(mask[base : base + n][hit].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, : width - gram + 1]
                    flags &= np.arange(flags.shape[1]) < p.windows[hit][:, None]
                    which, offset = np.nonzero(flags)
                    gone = H.covered(p.start[hit][which] + offset, width, len(p.joined))
                    for i, row in enumerate(p.rows):
                        mine = gone[p.text_starts[i] : p.text_starts[i + 1] - 1]
                        if mine.any():
                            out_masks[row] = mine
                base += n
        out = []
        for i, (k, t) in enumerate(zip(docs["k"], docs["t"], strict=True)):
            gone = out_masks.get(i)
            if reply.copy[i] and len(t) >= width:
                out.append((k, len(t), len(t), [{"start": 0, "end": len(t)}], b""))
            elif gone is None:
                out.append((k, len(t), 0, [], t))
            else:
                out.append((k, len(t), int(gone.sum()), intervals(gone), np.frombuffer(t, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["k", "n_bytes", "n_removed", "spans", "kept"])

    sent = parts.each(anchors, KEYS)
    replies = answered(sent, BITS, True)
    texts = parts.each(send, "bucket int, part int, anchors binary, windows binary, docs binary, texts binary", replies)
    masks = texts.groupBy("bucket").applyInPandas(sort, REPLY)
    done = parts.each(finish, "k long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary", replies, masks)
    return done.select(outward(), "n_bytes", "n_removed", "spans", "kept")


class Segments:
    """Runs of windows over one anchor in a run of texts: start (byte of joined), windows, anchor (short hash), doc
    (rank of the doc_id in its part). joined: the texts, each with a byte behind it; rows: their rows in the part."""

    def __init__(self, rows: np.ndarray, texts: list[bytes], ranks: np.ndarray, width: int, gram: int, bucket_bits: int) -> None:
        self.rows, self.joined = rows.tolist(), b"\xff".join(texts) + b"\xff"  # \xff isn't in UTF-8
        buf = np.frombuffer(self.joined, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths)))
        sums = H.prefix_sums(H.byte_values(buf), H.BYTE_BASE)
        grams = H.fixed_hashes(sums, gram, H.BYTE_BASE)
        best = H.sliding_argmin(grams, width - gram + 1)
        at = np.flatnonzero(H.inside(self.text_starts, width + 1, len(best)))
        best = best[at]
        new = np.ones(len(at), bool)
        new[1:] = (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.start, self.windows = at[begin], np.diff(np.append(begin, len(at)))
        # the least hashes crowd at the low end: mixed again, they spread evenly over the buckets
        self.anchor = short(H.mix(grams[best[begin]] + U(0x9E3779B97F4A7C15)), bucket_bits, BITS)
        self.doc = ranks[np.searchsorted(self.text_starts, self.start, "right") - 1]

    def texts(self, of, width: int) -> list[bytes]:
        begin = self.start[of]
        return [self.joined[a:b] for a, b in zip(begin.tolist(), (begin + self.windows[of] + width - 1).tolist(), strict=True)]


def doc_codes(part: int, ids: pd.Series, homes: dict[int, int]) -> np.ndarray:
    """For each distinct doc_id of a part, in order, a number that orders like the ids of all parts. An id that goes on in other parts
    is the last of the first of them."""
    own = np.unique(ids.to_numpy())
    codes = np.arange(len(own)) | part << 32
    for i in {0, len(own) - 1}:
        if int(own[i]) in homes:
            codes[i] = homes[int(own[i])] << 32 | 0xFFFFFFFF
    return codes


def distinct(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's kind, in order of appearance, and where each kind appears first. Texts are compared, not hashes."""
    kinds: dict[bytes, int] = {}
    of = np.fromiter((kinds.setdefault(t, len(kinds)) for t in texts), np.int64)
    return of, np.flatnonzero(np.diff(np.maximum.accumulate(of), prepend=-1))


def segments(docs: pd.DataFrame, skip: np.ndarray, width: int, gram: int, bucket_bits: int) -> Iterator[Segments]:
    ranks = np.unique(docs["k"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    rows = np.flatnonzero(~skip & (docs["t"].str.len() >= width).to_numpy(bool))
    for first, texts in H.chunks(docs["t"].iloc[rows], 1 << 18):
        mine = rows[first : first + len(texts)]
        yield Segments(mine, texts, ranks[mine], width, gram, bucket_bits)


def removed_windows(pdf: pd.DataFrame, width: int) -> list[bytes]:
    """For each row of segments (in order of part): a mask for each, bit j set if its window j also starts in a smaller document."""
    anchor = np.concatenate([unpack(b, BITS) for b in pdf["anchors"]])
    windows = np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["windows"]]).astype(np.int64)
    counts = [len(b) for b in pdf["windows"]]
    doc = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["docs"]])
    joined = b"".join(pdf["texts"])
    buf = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(windows + width - 1)
    starts = ends - (windows + width - 1)

    # equal segments: the least document stands for all
    kinds, _ = distinct(joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    order = np.lexsort((doc, kinds))
    new = np.ones(len(order), bool)
    new[1:] = kinds[order][1:] != kinds[order][:-1]
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    lead = order[new]  # one segment of each kind, of the least document

    # suffixes: each window of each kind of segment, grouped by anchor to begin with
    n = windows[lead]
    kind = np.repeat(np.arange(len(lead)), n)
    first = np.cumsum(n) - n
    offset = np.arange(len(kind)) - first[kind]
    group = np.unique(anchor[lead], return_inverse=True)[1][kind]
    alone = np.bincount(np.unique(anchor[lead], return_inverse=True)[1])[group] == 1
    least = doc[lead][kind]
    many = np.flatnonzero(~alone)
    if len(many):
        ranked, classes = suffix_order(buf, starts[lead][kind[many]] + offset[many], group[many], width)
        best = np.full(classes[-1] + 1, np.iinfo(np.int64).max)
        of = np.empty(len(many), np.int64)
        of[ranked] = classes
        np.minimum.at(best, of, least[many])
        least[many] = best[of]

    # back to every segment
    total = int(windows.sum())
    seg = np.repeat(np.arange(len(own)), windows)
    off = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = least[first[own[seg]] + off] < doc[seg]
    value = np.bincount(seg[hit], weights=(1 << off[hit]).astype(float), minlength=len(own)).astype(np.uint32)
    return [x.astype("<u4").tobytes() for x in np.split(value, np.cumsum(counts)[:-1])]


def suffix_order(buf: np.ndarray, at: np.ndarray, group: np.ndarray, width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at `at`, cut to width bytes (all inside buf), in order within each group, and the class of each in that order.

    -> (order, classes): at[order] is sorted by (group, bytes); classes rises by one where group or bytes differ.
    """
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    order = np.argsort(group, kind="stable")
    label = np.unique(group[order], return_inverse=True)[1].astype(np.int64)  # rank of the suffix's current group, sparse later
    label = np.searchsorted(label, label)  # the group's first place
    live = np.arange(len(order))
    depth = 0
    while depth < min(shallow, width) and len(live):  # multikey quicksort: one super-character at a time, inside equal groups
        take = min(SUPER, width - depth)
        place, char = label[live], _chars(padded, at[order[live]] + depth, take)
        compact = np.cumsum(np.concatenate(([0], place[1:] != place[:-1])))
        if compact[-1] < 1 << (64 - 8 * take):
            ranked = np.argsort((compact.astype(U) << U(8 * take)) | char)
        else:
            ranked = np.lexsort((char, compact))
        order[live] = order[live][ranked]
        char = char[ranked]
        new = np.ones(len(live), bool)
        new[1:] = (compact[1:] != compact[:-1]) | (char[1:] != char[:-1])
        label[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[_shared(label[live])]
        depth += take
    if depth < width and len(live):
        _blind_tries(padded, at, order, label, live, depth, width)
    classes = np.cumsum(np.concatenate(([0], label[1:] != label[:-1])))
    return order, classes


def _shared(label: np.ndarray) -> np.ndarray:
    """Where a run of equal labels has more than one member."""
    same = np.zeros(len(label), bool)
    same[1:] = label[1:] == label[:-1]
    same[:-1] |= same[1:]
    return same


def _chars(padded: np.ndarray, at: np.ndarray, take: int) -> np.ndarray:
    """take bytes at each place as one number that orders like them."""
    out = np.zeros(len(at), U)
    for i in range(take):
        out = (out << U(8)) | padded[at + i]
    return out


def _blind_tries(padded: np.ndarray, at: np.ndarray, order: np.ndarray, label: np.ndarray, live: np.ndarray, depth: int, width: int) -> None:
    """Order the groups that share depth bytes. All tries grow in step, one path at a time.

    The first member of a group is the path: each other member leaves it at the depth of their common prefix, by its next byte.
    Branches are put in order by that depth and byte without reading further: lower ones left of the path, the shallowest
    first, then the path with its equals, then higher ones, the deepest first. A branch is a group of the next round.
    """
    while len(live):
        place = label[live]
        head = np.concatenate(([True], place[1:] != place[:-1]))
        path = order[live][np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))]
        a, b = at[order[live]], at[path]
        common = np.full(len(live), width)
        side = np.ones(len(live), np.int64)  # 0 left, 1 on the path, 2 right
        byte = np.zeros(len(live), np.int64)
        open_ = np.flatnonzero(~head)
        for d in range(depth, width, 8):
            if not len(open_):
                break
            take = min(8, width - d)
            x, y = _chars(padded, a[open_] + d, take), _chars(padded, b[open_] + d, take)
            differ = x != y
            got, x, y = open_[differ], x[differ], y[differ]
            lead = take - 1 - (np.frexp((x ^ y).astype(np.float64))[1] - 1) // 8
            # a float may round up over a byte's border: then the byte before is equal
            lead += (x >> (U(8) * (take - 1 - lead).clip(0).astype(U))) == (y >> (U(8) * (take - 1 - lead).clip(0).astype(U)))
            shift = U(8) * (take - 1 - lead).astype(U)
            cx, cy = ((x >> shift) & U(255)).astype(np.int64), ((y >> shift) & U(255)).astype(np.int64)
            common[got], byte[got], side[got] = d + lead, cx, np.where(cx < cy, 0, 2)
            open_ = open_[~differ]
        key = np.where(side == 0, common, np.where(side == 2, 2 * width - common, width))
        ranked = np.lexsort((byte, key, side, place))
        order[live] = order[live][ranked]
        side, key, byte = side[ranked], key[ranked], byte[ranked]
        new = np.ones(len(live), bool)
        new[1:] = (place[1:] != place[:-1]) | (side[1:] != side[:-1]) | (key[1:] != key[:-1]) | (byte[1:] != byte[:-1])
        label[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[_shared(label[live]) & (side != 1)]


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_suffix_dedup": op10_suffix_dedup}

ORACLE_SQL = {
    "op10_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, i, md5_number(substring(h, 2 * i - 1, 100)) AS k FROM (SELECT r, doc_id, h, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 48)) AS i FROM d WHERE length(h) >= 100)),
least_ AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING count(*) > 1),
st AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM win JOIN least_ USING (k) WHERE m < doc_id),
runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM st),
spans AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS x, a AS y FROM spans UNION ALL SELECT r, max(b), 1000000000 FROM spans GROUP BY r),
kept AS (SELECT r, string_agg(substring(h, 2 * x - 1, CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS t FROM gaps JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(b - a) AS gone, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
}
