"""Operator 2: language identification by rank-order profiles.

A profile is a text's `size` most frequent n-grams (1 to 3 letters, word ends count as a letter) in order of frequency. A language's
profile is counted in Spark over all of its training documents; a document gets the language whose profile is least out of
place: the sum, over its own profile, of the difference of ranks, or `size` for an n-gram the language lacks. The profiles
(`size` n-grams a language) are the only thing that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
EDGE = 1  # stands for the end of a word; no letter has this code point
#: Characters handled at once.
CHUNK = 1 << 18
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


class Grams:
    """The n-grams of a run of texts as numbers, of text i: grams(i). Numbers order as the n-grams' code points do."""

    def __init__(self, texts: list[str]) -> None:
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        letter = letters()[points]
        points[~letter] = EDGE
        keep = letter | np.concatenate(([True], letter[:-1]))  # one EDGE after each word, one before the first
        starts = np.cumsum([1] + [len(t) + 1 for t in lowered])
        self.bounds = np.concatenate(([0], np.cumsum(keep)))[starts]
        self.has_letters = np.diff(np.concatenate(([0], np.cumsum(letter)))[starts]) > 0
        points = points[keep]
        self.alphabet = np.flatnonzero(np.bincount(points, minlength=2))  # in order of code points
        self.bits = max(4, int(len(self.alphabet)).bit_length())
        kind = np.uint32 if 3 * self.bits <= 32 else np.uint64
        rank = np.zeros(int(self.alphabet[-1]) + 1, kind)
        rank[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        c = rank[points]
        edge = points == EDGE
        shift = kind(self.bits)
        two = (c[:-1] << shift) | c[1:]
        three = (two[:-1] << shift) | c[2:]
        #: at its first letter's place; 0: none
        self.one = np.where(edge, 0, c)
        self.two = np.where(edge[:-1] & edge[1:], 0, two)
        self.three = np.where(edge[1:-1], 0, three)  # none runs over the end of a word

    def grams(self, i: int) -> np.ndarray:
        lo, hi = self.bounds[i], self.bounds[i + 1]
        if hi == lo:
            return self.one[:0]
        before = lo - 1  # the EDGE before the first word
        found = np.concatenate((self.one[lo:hi], self.two[before : hi - 1], self.three[before : hi - 2]))
        return found[found != 0]

    def plain(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers that mean the same in every run: 21 bits a code point."""
        mask = (1 << self.bits) - 1
        out = np.zeros(len(numbers), np.uint64)
        numbers = numbers.astype(np.uint64)
        points = np.concatenate(([0], self.alphabet)).astype(np.uint64)
        for i in (2, 1, 0):
            out = (out << np.uint64(21)) | points[((numbers >> np.uint64(i * self.bits)) & np.uint64(mask)).astype(np.int64)]
        return out


def runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        if held and total + len(t) > CHUNK:
            yield first, held
            first, held, total = i, [], 0
        held.append(t)
        total += len(t)
    if held:
        yield first, held


def top(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent numbers in order (ties: the smaller first)."""
    values, counts = np.unique(numbers, return_counts=True)
    order = np.lexsort((values, -counts))[:size]
    return values[order], counts[order]


def profiles(docs: DataFrame, size: int = 400) -> dict[str, np.ndarray]:
    """Per language of docs(text, lang, ...), the n-grams of its profile in order. Rows of null text or lang are left out."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[int, int]] = {}
        for pdf in frames:
            for lang, texts in pdf.groupby("lang")["text"]:
                mine = held.setdefault(lang, {})
                for _, some in runs(texts.tolist()):
                    g = Grams(some)
                    values, counts = np.unique(np.concatenate([g.grams(i) for i in range(len(some))]), return_counts=True)
                    for v, n in zip(g.plain(values).tolist(), counts.tolist(), strict=True):
                        mine[v] = mine.get(v, 0) + n
                if len(mine) > 200_000:  # counts are sums: what is held may go out early
                    yield pd.DataFrame({"lang": lang, "gram": list(mine), "n": list(mine.values())})
                    mine.clear()
        for lang, mine in held.items():
            yield pd.DataFrame({"lang": lang, "gram": list(mine), "n": list(mine.values())})

    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    counted = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "gram", "r").collect():  # `size` rows a language
        out.setdefault(r.lang, []).append((r.r, r.gram))
    return {k: np.array([g for _, g in sorted(v)], np.uint64) for k, v in sorted(out.items())}


class Ranker:
    def __init__(self, known: dict[str, np.ndarray], size: int) -> None:
        self.names, self.size = list(known), size
        self.keys = np.unique(np.concatenate([*known.values(), np.empty(0, np.uint64)]))
        self.ranks = np.full((len(known), len(self.keys) + 1), -1, np.int32)  # the last column: in no profile
        for i, grams in enumerate(known.values()):
            self.ranks[i, np.searchsorted(self.keys, grams)] = np.arange(len(grams))

    def best(self, own: np.ndarray) -> tuple[str, float]:
        """own: a document's profile. -> language, 1 - distance / the greatest distance possible."""
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == own, at, len(self.keys))
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        i = int(away.argmin())  # ties: the first name
        return self.names[i], 1.0 - float(away[i]) / (self.size * len(own))


def identify(docs: DataFrame, known: dict[str, np.ndarray], size: int = 400) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score (0 to 1).

    Null text and texts without letters: 'und', 0. Ties: the first language by name. Repeated rows: a row each. Null doc_id: kept.
    Empty table: no rows. Only text is read; lang and other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(sent.value, size)
        for pdf in frames:
            found = []
            for _, texts in runs(pdf["text"].tolist()):
                g = Grams(texts)
                found += [ranker.best(g.plain(top(g.grams(i), size)[0])) if g.has_letters[i] else (UNKNOWN, 0.0) for i in range(len(texts))]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = lambda c: F.crc32(F.col(c).cast("string")) % 3 == 1
    known = profiles(docs.where(~held("doc_id")))
    return identify(docs, known).select("doc_id", F.coalesce(held("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_language_id": op2_language_id}
