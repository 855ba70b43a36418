"""Documents in parts: ranges of doc_id of a bounded number of bytes, and exchanges between parts and hash buckets.

The exact dedup operators ask one kind of question many times: "does this key also occur in an earlier part?"
Parts are ranges of (doc_id, beginning of the text), so the order of parts is the order of documents. A part sends each distinct key once,
packed by hash bucket (so a key that a third of all rows hold is sent once a part); a bucket answers with bits in the
order received. No document ids, positions or texts travel with the keys.

The ranges are cut where the running sum of bytes in sorted order reaches the part's size, so a part holds at most that and one text more,
whatever the sizes and ids; rows without a doc_id, or of one doc_id, are split by the beginnings of their texts. Tasks find a row's part
in a table of the parts' first rows (a number each), which is broadcast: the plan doesn't grow with it. Up to GROWS bytes, parts and buckets have a fixed
size; beyond, both grow with the square root of the input, and so do their numbers: at 100 TB there are 640,000 parts of 160 MB.

Everything is one lazy plan over deterministic functions of the data: a lost executor costs a recomputation and nothing
else. The exchange of the texts by part is reused by every round.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.hashing import U

#: Stands for a null doc_id inside; such rows come before all others.
NULL_ID = -(1 << 63)
REPLY = "part int, kind int, bucket int, blob binary, ids array<long>"
COPIES, BITS, MASKS = 0, 1, 2
GROWS = 64 << 30
#: Bytes of a text's beginning that order rows of one doc_id into parts; rows that agree in both stay together.
BEGINNING = 64
#: Parts whose bounds one task cuts.
PARTS_A_TASK = 64


class Parts:
    """docs(doc_id, text, ...) as rows (part, k, t), t in UTF-8 bytes, and the copies to be left out.

    bytes_per_part: text in a part (a single longer document makes a longer part); keys_per_bucket and keys_per_byte
    (distinct keys expected of a byte of text) set the number of buckets, so a bucket's keys stay bounded as the input grows.
    """

    def __init__(self, docs: DataFrame, keys_per_byte: float, bytes_per_part: int = 4 << 20, keys_per_bucket: int = 1 << 19) -> None:
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t"))
        total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        scale = math.sqrt(max(1.0, total / GROWS))
        self.bucket_bits = min(24, max(3, math.ceil(math.log2(max(1.0, total * keys_per_byte / (keys_per_bucket * scale))))))
        number, homes = _part(rows, total, round(bytes_per_part * scale))
        #: doc_ids whose rows are in several parts -> the first of them
        self.homes = rows.sparkSession.sparkContext.broadcast(homes)
        self.rows = rows.select(number.alias("part"), "k", "t")
        keys = self.rows.select("part", "k", F.md5("t").alias("m")).groupBy("part", "m").agg(F.collect_list("k").alias("ks"))
        firsts = keys.groupBy("m").agg(F.min(F.array_min("ks")).alias("first"), F.sum(F.size("ks")).alias("n")).where("n > 1").drop("n")
        # a copy is a doc_id and a text: another text of the same doc_id is none
        later = F.transform(F.filter("ks", lambda k: k > F.col("first")), lambda k: F.struct(k.alias("k"), F.col("m").alias("m")))
        copies = keys.join(firsts, "m").groupBy("part").agg(F.flatten(F.collect_list(later)).alias("c"))
        digests = F.unhex(F.array_join("c.m", ""))  # 16 bytes for each of ids
        self.copies = copies.select("part", F.lit(COPIES).alias("kind"), F.lit(0).alias("bucket"), digests.alias("blob"), F.col("c.k").alias("ids"))

    def each(self, fn: Callable, schema: str, *replies: DataFrame) -> DataFrame:
        """fn(part, texts of one part in order of (doc_id, text), replies to it) -> frame, for every part."""
        right = self.copies
        for r in replies:
            right = right.unionByName(r)

        def run(key: tuple, docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
            docs = docs.sort_values(["k", "t"], kind="stable", ignore_index=True)
            return fn(int(key[0]), docs, Reply(docs, back))

        right = right.select(F.col("part").alias("to"), "kind", "bucket", "blob", "ids")  # another name: both sides come from docs
        return self.rows.groupBy("part").cogroup(right.groupBy("to")).applyInPandas(run, schema)


class Reply:
    """What came back to a part."""

    def __init__(self, docs: pd.DataFrame, back: pd.DataFrame) -> None:
        copies = back[back["kind"] == COPIES]
        #: per row: whether its text is that of a document with a smaller doc_id
        self.copy = np.zeros(len(docs), bool)
        if len(copies):
            ids = np.concatenate(list(copies["ids"]))
            blob = b"".join(copies["blob"])
            pairs = set(zip(ids.tolist(), (blob[i : i + 16] for i in range(0, len(blob), 16)), strict=True))
            for i in np.flatnonzero(docs["k"].isin(ids)):
                self.copy[i] = (int(docs["k"].iloc[i]), hashlib.md5(docs["t"].iloc[i], usedforsecurity=False).digest()) in pairs
        self.back = back

    def _blobs(self, kind: int) -> dict[int, bytes]:
        rows = self.back[self.back["kind"] == kind]
        return dict(zip(rows["bucket"].astype(int), rows["blob"], strict=True))

    def bits(self, keys: np.ndarray, remainder_bits: int) -> np.ndarray:
        """The answer for each of the distinct keys, in the order of key_rows."""
        blobs = self._blobs(BITS)
        out = [np.unpackbits(np.frombuffer(blobs[b], np.uint8), count=n).astype(bool) for b, _, n in bucket_slices(keys, remainder_bits)]
        return np.concatenate(out) if out else np.empty(0, bool)

    def masks(self, keys: np.ndarray, remainder_bits: int) -> np.ndarray:
        blobs = self._blobs(MASKS)
        out = [np.frombuffer(blobs[b], np.uint32) for b, _, _ in bucket_slices(keys, remainder_bits)]
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def _part(rows: DataFrame, total: int, limit: int) -> tuple[Column, dict[int, int]]:
    """The number of a row's part, of limit bytes at most and one text more; the ids that are split, with their first part."""
    if total <= limit:
        return F.lit(0), {}
    beginning = F.substring("t", 1, BEGINNING)
    tasks = math.ceil(total / limit / PARTS_A_TASK)
    sizes = rows.select("k", beginning.alias("b"), F.octet_length("t").alias("n"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last, out = 0, None, []
        for pdf in frames:
            for k, b, n in zip(pdf["k"].tolist(), pdf["b"], pdf["n"].tolist(), strict=True):
                if last is None or held + n > limit and (k, b) != last:
                    out.append((k, b if last is None or last[0] == k else b""))
                    held = 0
                held, last = held + n, (k, b)
        yield pd.DataFrame(out, columns=["k", "b"])

    ordered = sizes.repartitionByRange(tasks, "k", "b").sortWithinPartitions("k", "b")
    firsts = sorted((r.k, bytes(r.b)) for r in ordered.mapInPandas(cut, "k long, b binary").collect())  # one a part
    firsts[0] = (firsts[0][0], b"")  # nothing comes before
    table = rows.sparkSession.sparkContext.broadcast((np.array([k for k, _ in firsts], np.int64), {k for k, b in firsts if b}, firsts))

    @F.pandas_udf("int")
    def number(k: pd.Series, b: pd.Series) -> pd.Series:
        ids, split, firsts = table.value
        out = np.searchsorted(ids, k.to_numpy(), "right") - 1
        for i in np.flatnonzero(k.isin(split)) if split else ():
            out[i] = bisect.bisect_right(firsts, (int(k.iloc[i]), bytes(b.iloc[i]))) - 1
        return pd.Series(np.maximum(out, 0).astype(np.int32))

    return number("k", beginning), {k: bisect.bisect_right(firsts, (k, b"")) - 1 for k, b in firsts if b}


def short(hashes: np.ndarray, bucket_bits: int, remainder_bits: int) -> np.ndarray:
    """The bits of a hash that are kept: those of the bucket, then the remainder."""
    return hashes >> U(64 - min(64, bucket_bits + remainder_bits))


def bucket_slices(keys: np.ndarray, remainder_bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, count) of sorted keys."""
    if not len(keys):
        return
    buckets = (keys >> U(remainder_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
        yield int(buckets[lo]), int(lo), int(hi - lo)


def pack(keys: np.ndarray, remainder_bits: int) -> bytes:
    """The remainders, in remainder_bits / 8 bytes each, by byte planes (equal high bytes then compress)."""
    raw = (keys & U((1 << remainder_bits) - 1)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - remainder_bits // 8 :]
    return np.ascontiguousarray(raw.T).tobytes()


def unpack(blob: bytes, remainder_bits: int) -> np.ndarray:
    width = remainder_bits // 8
    raw = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 8 - width :] = raw
    return full.view(">u8").ravel().astype(U)


def in_order(keys: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys, of equal keys by `more`; and where in it a new key begins."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    if more is not None:
        other = more[order][1:] != more[order][:-1]
        if (other & ~new[1:]).any():  # equal in the first hash alone
            order = np.lexsort((more, keys))
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, new


def key_rows(part: int, keys: np.ndarray, remainder_bits: int, more: np.ndarray | None = None, more_bits: int = 0) -> pd.DataFrame:
    """Distinct keys in order as rows (bucket, part, blob, more): more is a second hash of more_bits bits."""
    rows = [(b, part, pack(keys[lo : lo + n], remainder_bits), b"" if more is None else pack(more[lo : lo + n], more_bits)) for b, lo, n in bucket_slices(keys, remainder_bits)]
    return pd.DataFrame(rows, columns=["bucket", "part", "blob", "more"])


KEYS = "bucket int, part int, blob binary, more binary"


def answered(keys: DataFrame, remainder_bits: int, first_too: bool, more_bits: int = 0) -> DataFrame:
    """Rows of KEYS -> reply bits: whether an earlier part has the key; first_too: whether any other part has it."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ignore_index=True)
        held = [unpack(b, remainder_bits) for b in pdf["blob"]]
        order, new = in_order(np.concatenate(held), np.concatenate([unpack(b, more_bits) for b in pdf["more"]]) if more_bits else None)
        same = ~new
        if first_too:
            same[:-1] |= ~new[1:]
        out = np.empty(len(order), bool)
        out[order] = same
        cuts = np.cumsum([len(h) for h in held])[:-1]
        blobs = [np.packbits(x).tobytes() for x in np.split(out, cuts)]
        return pd.DataFrame({"part": pdf["part"].astype("int32"), "kind": np.int32(BITS), "bucket": np.int32(key[0]), "blob": blobs, "ids": None})

    return keys.groupBy("bucket").applyInPandas(run, REPLY)


def outward(column: str = "k"):
    """doc_id again."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias("doc_id")
