"""Operator 1: substring dedup over token windows.

Rabin-Karp hashes of every window of `width` words are counted across the corpus in Spark; a window that also starts earlier
is repeated, and repeated windows merge into maximal removal intervals.

The count is kept as "has an earlier part this hash?", see parts.py: per part of 4 MB of text every distinct window goes out once, as
two hashes (the bucket's bits, 40 more, and 48 of the other), and one bit comes back. Each hash is made from the words' letters under a key
of its own, drawn at random for each run: nobody can write words or windows of equal hashes beforehand, and the two are independent, so false repeats are expected
n**2 / 2**(89 + bucket bits) times for n windows: 2**-37 at 30 GB, 2**-21 at 100 TB. Texts that repeat a smaller doc_id's whole text need no
hashes: all their windows start earlier. Nothing is collected but the parts' bounds; a hash that every document holds costs one entry a part.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm import hashing as H
from quillmatch.llm.parts import KEYS, Parts, Reply, answered, in_order, key_rows, outward, short

BITS, MORE_BITS = 40, 48


def remove_repeated_windows(docs: DataFrame, width: int = 20, bytes_per_part: int = 4 << 20) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_removed, intervals array<struct<start, end>> (words, end exclusive), kept (text).

    A word goes if a window of `width` words that covers it has a word sequence that also starts earlier: in a row
    that precedes in order of (doc_id, text), or in the same text at an earlier word. Windows are judged on the input.
    Null text: no words. Empty or short text: nothing removed. Null doc_id: precedes all. A repeated row: the second
    counts as later. A long text is one row of one part. Empty table: no rows. Other columns are ignored.
    """
    parts = Parts(docs, keys_per_byte=0.16, bytes_per_part=bytes_per_part)
    bits = parts.bucket_bits
    keyed = (secrets.randbits(64), secrets.randbits(64))  # a part of the plan: a task that runs again has the same

    def hashes(docs: pd.DataFrame, skip: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """Per chunk of texts: row numbers, words, starts of windows; and both hashes of all windows."""
        rows, pieces, one, two = np.flatnonzero(~skip), [], [np.empty(0, H.U)], [np.empty(0, H.U)]
        for first, texts in H.chunks(docs["t"].iloc[rows], 1 << 18):
            words = H.Words(texts)
            at, x, y = words.windows(width, keyed)
            pieces.append((rows[first : first + len(texts)], words.first, len(words.starts), at))
            one.append(short(x, bits, BITS))
            two.append(y >> H.U(64 - MORE_BITS))
        return pieces, np.concatenate(one), np.concatenate(two)

    def send(part: int, docs: pd.DataFrame, reply: Reply) -> pd.DataFrame:
        _, keys, more = hashes(docs, reply.copy)
        order, new = in_order(keys, more)
        return key_rows(part, keys[order[new]], BITS, more[order[new]], MORE_BITS)

    def finish(part: int, docs: pd.DataFrame, reply: Reply) -> pd.DataFrame:
        pieces, keys, more = hashes(docs, reply.copy)
        order, new = in_order(keys, more)
        again = np.empty(len(keys), bool)
        again[order] = ~new | reply.bits(keys[order[new]], BITS)[np.cumsum(new) - 1]
        gone: dict[int, np.ndarray] = {}
        seen = 0
        for rows, begins, n, at in pieces:
            hit = H.covered(at[again[seen : seen + len(at)]], width, n)
            seen += len(at)
            for i, row in enumerate(rows):
                if (mine := hit[begins[i] : begins[i + 1]]).any():
                    gone[row] = mine
        out = []
        for i, (k, t) in enumerate(zip(docs["k"], docs["t"], strict=True)):
            own = t.split()  # bytes.split() splits at \x20 and \x09-\x0D
            mask = gone.get(i)
            if reply.copy[i] and len(own) >= width:
                mask = np.ones(len(own), bool)
            if mask is None:
                out.append((k, len(own), 0, [], b" ".join(own).decode()))
            else:
                kept = b" ".join(w for w, m in zip(own, mask.tolist(), strict=True) if not m)
                out.append((k, len(own), int(mask.sum()), intervals(mask), kept.decode()))
        return pd.DataFrame(out, columns=["k", "n_words", "n_removed", "intervals", "kept"])

    sent = parts.each(send, KEYS)
    done = parts.each(finish, "k long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept string", answered(sent, BITS, False, MORE_BITS))
    return done.select(outward(), "n_words", "n_removed", "intervals", "kept")


def intervals(mask: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_substring_dedup": op1_substring_dedup}

ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS n FROM win) WHERE n > 1),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN hit USING (r, p) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
}
