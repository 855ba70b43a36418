"""Operator 12: periodic runs of words by difference-cover LCE.

A run of period q and at least 4 * q words meets three neighbouring points of the grid 0, q, 2q, ... at which the word equals the one q
further on. So the grids of all periods (n/1 + n/2 + ... points: n log n) are looked at, and where three points in a row agree, the longest common extensions of
both sides give the whole run. Runs of one extent are one run, with its smallest period.

Extensions are answered by a difference cover: only suffixes at positions whose remainder modulo COVER is in the cover are sorted (by blocks of COVER
words, then by doubling), with the lengths of the common prefixes of neighbours in a sparse table of minima. For any two positions
some shift below COVER brings both into the sample: so few words are compared, and a range minimum tells the rest.

A task takes whole documents, several at a time with a word of its own between any two, so no run leaves its document; documents
without three agreeing points (most) have no run and aren't sorted.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.hashing import chunks
from quillmatch.llm.prefix_trie import CRC
from quillmatch.llm.workers import sparing

COVER = 32
#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words looked at together, and bytes of text held as words; a longer document comes alone.
CHUNK, CHUNK_BYTES = 1 << 16, 4 << 20


@functools.cache
def difference_cover(v: int) -> np.ndarray:
    """Remainders modulo v among which every difference modulo v occurs (chosen greedily: each adds the most new differences)."""
    have, seen = [0], {0}
    while len(seen) < v:
        new = max(range(v), key=lambda x: (len({(x - h) % v for h in have} | {(h - x) % v for h in have} | seen), -x))
        seen |= {(new - h) % v for h in have} | {(h - new) % v for h in have}
        have.append(new)
    return np.array(sorted(have))


@functools.cache
def _shifts(v: int) -> tuple[np.ndarray, np.ndarray]:
    """Which remainders are in the cover; of remainders r and r + d, the least shift that brings both into it."""
    held = np.zeros(v, bool)
    held[difference_cover(v)] = True
    on = held[np.add.outer(np.arange(v), np.arange(v)) % v]  # [r, shift]
    return held, np.stack([(on & np.roll(on, -d, axis=0)).argmax(axis=1) for d in range(v)], axis=1)


class Extensions:
    """Longest common extensions to the right of any two positions of words (numbers of 0 or more)."""

    def __init__(self, words: np.ndarray, v: int = COVER) -> None:
        self.v, n = v, len(words)
        held, self.shift = _shifts(v)
        # behind the end, each place has a number of its own: no two suffixes are equal, no extension runs over the end
        self.words = np.concatenate((words.astype(np.int64), -1 - np.arange(2 * v, dtype=np.int64)))
        at = np.arange(n + v)
        sample = at[held[at % v]]
        self.index = np.full(n + 2 * v, -1, np.int64)
        self.index[sample] = np.arange(len(sample))
        # rank of each sampled block of v words, then of 2 * v, 4 * v, ... until all differ
        rank = np.zeros(len(sample), np.int64)
        for j in range(v):
            if int(rank.max(initial=-1)) + 1 == len(sample):
                break
            rank = _ranks(rank, self.words[sample + j])
        levels, step = [rank], v
        while int(rank.max(initial=-1)) + 1 < len(sample):
            on = sample + step
            inside = on < n + v
            rank = _ranks(rank, np.where(inside, rank[self.index[np.minimum(on, n + v - 1)]], -1 - sample))
            levels.append(rank)
            step *= 2
        self.rank = rank
        order = np.empty(len(sample), np.int64)
        order[rank] = np.arange(len(sample))
        # common prefixes of neighbours: from the longest blocks to the shortest, then words
        a, b = sample[order[:-1]], sample[order[1:]]
        common = np.zeros(len(a), np.int64)
        for ranks in reversed(levels):
            step = v << (len(levels) - 1)
            levels.pop()
            x, y = a + common, b + common
            inside = (x < n + v) & (y < n + v)
            same = inside & (ranks[self.index[np.where(inside, x, 0)]] == ranks[self.index[np.where(inside, y, 0)]])
            common += same * step
        common += self._compared(a + common, b + common, np.full(len(a), v))
        self.minima = [common]
        while (half := 1 << (len(self.minima) - 1)) * 2 <= len(common):
            row = self.minima[-1]
            self.minima.append(np.minimum(row[: len(row) - half], row[half:]))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, most at most."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        last = len(self.words) - 1
        d = 0
        while len(live):
            same = self.words[np.minimum(i[live] + d, last)] == self.words[np.minimum(j[live] + d, last)]
            live = live[same]
            d += 1
            out[live] = d
            live = live[most[live] > d]
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For positions i < j: how many words from i on equal those from j on."""
        shift = self.shift[i % self.v, (j - i) % self.v]
        out = self._compared(i, j, shift)
        on = np.flatnonzero(out == shift)
        if not len(on):
            return out
        x, y = self.rank[self.index[i[on] + shift[on]]], self.rank[self.index[j[on] + shift[on]]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        least = np.empty(len(on), np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            row = self.minima[k]
            least[own] = np.minimum(row[lo[own]], row[hi[own] - (1 << int(k))])
        out[on] += least
        return out


def _ranks(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    low = int(minor.min(initial=0))
    keys = major * (int(minor.max(initial=0)) - low + 1) + (minor - low)
    order = np.argsort(keys)
    new = np.zeros(len(order), np.int64)
    keys = keys[order]
    new[1:] = keys[1:] != keys[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def grid(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, q) of all periods up to longest: i is a multiple of q at which, as at i + q and i + 2 * q, the word equals the one q further on."""
    starts, periods = [], []
    for q in range(1, longest + 1):
        points = words[::q]
        same = points[1:] == points[:-1]
        if len(same) < 3:
            break
        k = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(k):
            starts.append(k * q)
            periods.append(np.full(len(k), q))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, in order of (start, period)."""
    i, q = grid(words, longest)
    if not len(i):
        return np.empty((0, 3), np.int64)
    n = len(words)
    right = Extensions(words).of(i, i + q)
    left = Extensions(words[::-1]).of(n - i - q, n - i)  # from i - 1 and i + q - 1 backwards
    start, length = i - left, left + q + right
    keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    found = np.stack((start, length, q), axis=1)[keep]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)  # of one extent, the smallest period
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def greatest(found: np.ndarray) -> tuple[int, int, int]:
    """The run of the greatest exact length / period; ties: the smallest start, then period."""
    near = found[:, 1] / found[:, 2]
    best = found[near >= near.max() * (1 - 1e-9)].tolist()
    return min(((s, n, q) for s, n, q in best), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def repeated(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word each of a document's n words becomes: a tenth of the documents, by crc32 of doc_id, are periodic from a word on."""
    take = np.arange(n)
    if doc_id is None or not n:
        return take
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        take[a:] = a + (take[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return take


SCHEMA = "k string, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, int], np.ndarray] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_runs, the run of the greatest length / period (start, length, period,
    exponent_milli; null without a run), runs array<struct<start, length, period>>, collapsed (text without the repeats of runs).

    Words are runs of bytes other than \\x20 and \\x09-\\x0D. A word goes if a run has it after its first period. rewrite(doc_id, n): which
    original word each of n words becomes (default: itself).
    Null, empty or blank text: no words, no runs, an empty text. Null doc_id: kept, judged like others. Repeated rows: a row each. A long
    text is worked on whole in one task, n log n in its words. Empty table: no rows. Other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids = [None if k is None else int(k) for k in pdf["k"]]
            for first, texts in chunks((t.encode() for t in pdf["text"]), CHUNK_BYTES):
                yield _judged(ids[first : first + len(texts)], [t.split() for t in texts], rewrite)

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInPandas(sparing(run), SCHEMA)
    return out.select(F.col("k").cast("long").alias("doc_id"), *(c.split()[0] for c in SCHEMA.split(", ")[1:]))


def _judged(ids: list[int | None], split: list[list[bytes]], rewrite: Callable | None) -> pd.DataFrame:
    """Rows of SCHEMA; bytes.split() splits at \\x20 and \\x09-\\x0D."""
    if rewrite is not None:
        split = [[w[x] for x in rewrite(k, len(w)).tolist()] for w, k in zip(split, ids, strict=True)]
    out = []
    for k, w, r in zip(ids, split, found_in(split), strict=True):
        best, milli, kept = (None, None, None), None, w
        if len(r):
            best = greatest(r)
            milli = 1000 * best[1] // best[2]
            gone = np.zeros(len(w) + 1, np.int64)
            np.add.at(gone, r[:, 0] + r[:, 2], 1)
            np.add.at(gone, r[:, 0] + r[:, 1], -1)
            kept = [x for x, g in zip(w, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
        every = [{"start": a, "length": n, "period": q} for a, n, q in r.tolist()]
        out.append((None if k is None else str(k), len(w), len(r), *best, milli, every, b" ".join(kept).decode()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")})


def found_in(split: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each document. Documents of like lengths are looked at together."""
    order = sorted(range(len(split)), key=lambda d: len(split[d]))
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(split)
    lo = 0
    while lo < len(order):
        hi, total = lo, 0
        while hi < len(order) and (hi == lo or total + len(split[order[hi]]) < CHUNK):
            total += len(split[order[hi]]) + 1
            hi += 1
        group = order[lo:hi]
        lo = hi
        flat, bounds = _numbered([split[d] for d in group])
        longest = len(split[group[-1]]) // LEAST_PERIODS
        i, _ = grid(flat, longest)
        # only documents with three agreeing points of a grid can have a run
        for x in np.unique(np.searchsorted(bounds, i, "right") - 1).tolist():
            words = flat[bounds[x] : bounds[x + 1] - 1]
            out[group[x]] = runs(words, len(words) // LEAST_PERIODS)
    return out


def _numbered(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal ones alike, a number of its own behind each document; where each begins."""
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    bounds = np.concatenate(([0], np.cumsum([len(w) + 1 for w in split])))
    flat = np.empty(int(bounds[-1]), np.int64)
    for w, a in zip(split, bounds.tolist(), strict=False):
        flat[a : a + len(w)] = [numbers[x] for x in w]
    flat[bounds[1:] - 1] = len(numbers) + np.arange(len(split))
    return flat, bounds


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeated)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_periodic_runs": op12_periodic_runs}

ORACLE_SQL = {
    "op12_periodic_runs": f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, CAST({CRC.format(x="doc_id")} AS BIGINT) AS h FROM d),
a AS (SELECT *, h % 10 = 0 AND n > 0 AS again, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN again THEN list_concat(w[1:a], list_transform(range(n - a), lambda j: w[1 + a + j % p])) ELSE w END) AS x FROM p),
pair AS (SELECT o.r, o.i, b.i - o.i AS q FROM t o JOIN t b ON o.r = b.r AND o.x = b.x AND b.i > o.i AND 4 * (b.i - o.i) <= o.n),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pair),
ext AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM isle GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, l, min(q) AS q FROM ext GROUP BY r, s, l),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1),
list AS (SELECT r, count(*) AS k, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS v FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS v FROM t ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT d.doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(list.v, '')) AS runs_sha256, sha256(coalesce(kept.v, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN list USING (r) LEFT JOIN kept USING (r)
"""
}
