"""Operator 6: toxicity by multiple-instance learning.

Labels are on documents, the cause is in sentences. A document is a bag of sentences; a sentence's probability comes from a linear
score of its words, and the bag's is their noisy-or, 1 - prod(1 - p). The weights are trained on document labels alone,
through the noisy-or; sentence probabilities then point at the offending sentences.

A word's score is the sum of the weights of the word and its prefixes, so that inflected forms share what they have in common. The fit
runs in one task on a bounded sample (`sample` toxic and twice as many clean documents, `sample_bytes` of text at most, a third of them for
toxic documents, picked by a hash of doc_id; a text that doesn't fit any more is passed over, and where none of a label fits,
sentences of its shortest text stand for it); scoring is a map over all documents with the weights (2**bits floats) broadcast.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.checkpoints import cut
from quillmatch.llm.workers import give_back, sparing

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Words of an instance; a longer sentence is several.
INSTANCE = 25
PREFIXES = (3, 4, 5, 6)
REMEMBERED = 1 << 17


def features(word: str, bits: int) -> list[int]:
    """Hashed features of a lower-case word: itself and its proper prefixes."""
    top = (1 << bits) - 1
    return [zlib.crc32(b"=" + word.encode("utf-8", "replace")) & top] + [zlib.crc32(b"^" + word[:n].encode("utf-8", "replace")) & top for n in PREFIXES if len(word) >= n]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence with words; offsets in code points."""
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m[0].lower())
        if words:
            yield m.start(), m.end(), words


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(texts: list[str], labels: np.ndarray, bits: int = 18, steps: int = 80, rate: float = 0.15, shrink: float = 1e-4, bias: float = -9.0) -> np.ndarray:
    """Weights (float32, the last is the bias) by Adam on the noisy-or's likelihood.

    Words can only speak for toxicity (weights of 0 or more), and each weight costs `shrink` times its size: what also
    occurs in clean documents, or adds little, stays at 0. A low first bias keeps documents of thousands of instances near 0.
    """
    numbers: dict[str, int] = {}
    word, instance, bag = array("i"), array("i", [0]), array("i")  # flat: the sample's words are millions
    for d, t in enumerate(texts):
        for _, _, own in sentences(t):
            for lo in range(0, len(own), INSTANCE):
                word.extend(numbers.setdefault(w, len(numbers)) for w in own[lo : lo + INSTANCE])
                instance.append(len(word))
                bag.append(d)
    weights = np.zeros((1 << bits) + 1)
    rate_1 = labels.mean() if len(labels) else 0.0
    if not word or rate_1 in (0.0, 1.0):  # nothing to tell apart
        weights[-1] = -30.0 if rate_1 < 1 else 30.0
        return weights.astype(np.float32)
    words, bounds, bags = (np.frombuffer(x, np.int32) for x in (word, instance, bag))
    starts, owner = bounds[:-1], np.repeat(np.arange(len(bags), dtype=np.int32), np.diff(bounds))
    flat, sizes = array("i"), array("i")
    for w in numbers:
        own = features(w, bits)
        flat.extend(own)
        sizes.append(len(own))
    named = len(numbers)
    numbers.clear()
    column, row = np.frombuffer(flat, np.int32), np.repeat(np.arange(named, dtype=np.int32), np.frombuffer(sizes, np.int32))
    weights[-1] = bias
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    positive = labels.astype(bool)
    for step in range(1, steps + 1):
        score = np.bincount(row, weights[column], named)
        z = weights[-1] + np.add.reduceat(score[words], starts)
        mass = np.bincount(bags, softplus(z), len(texts))  # -log(1 - p) of the document
        # d loss / d mass: 1 for clean documents, -exp(-mass) / (1 - exp(-mass)) for toxic ones
        slope = np.where(positive, -1 / np.expm1(np.clip(mass, 1e-6, 50)), 1.0) / len(texts)
        dz = slope[bags] / (1 + np.exp(-z))
        grad = np.bincount(column, np.bincount(words, dz[owner], named)[row], len(weights)) + shrink
        grad[-1] = dz.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.maximum(weights[:-1], 0, out=weights[:-1])
    return weights.astype(np.float32)


class Scorer:
    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.bits = weights, (len(weights) - 1).bit_length() - 1
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        s = self.known.get(w)
        if s is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            s = self.known[w] = float(self.weights[features(w, self.bits)].sum())
        return s

    def text(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of the document, and its sentences of probability 0.5 or more."""
        spans, z, of = [], [], []
        word = self.word
        for start, end, words in sentences(text):
            scores = list(map(word, words))
            for lo in range(0, len(words), INSTANCE):
                z.append(sum(scores[lo : lo + INSTANCE]))
                of.append(len(spans))
            spans.append((start, end))
        if not spans:
            return 0.0, []
        mass = np.bincount(of, softplus(np.array(z) + self.weights[-1]), len(spans))
        p = -np.expm1(-mass)
        return float(-np.expm1(-mass.sum())), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def train(docs: DataFrame, labels: DataFrame, sample: int = 2500, sample_bytes: int = 24 << 20, bits: int = 18, folds: int = 5) -> np.ndarray:
    """Weights from rows whose crc32(doc_id as text) mod folds isn't 0. labels(doc_id, toxic, ...).

    sample: toxic documents at most; twice as many clean ones at most; sample_bytes: their text in all at most (whole texts), a third of it
    for toxic documents and two for clean ones. In order of hash, a text that doesn't fit its share any more is passed over; where none of a
    label fits, its shortest text (ties: by hash) takes part by some of its instances (`some_of`). Null doc_id, null toxic and labels without a document are left out; of several labels of one document the highest
    counts, of equal texts of one document one.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = chosen.where(F.crc32(F.col("doc_id").cast("string")) % folds != 0).withColumn("h", F.xxhash64("doc_id"))
    picked = chosen.where("toxic > 0").orderBy("h", "doc_id").limit(sample).unionAll(chosen.where("toxic <= 0").orderBy("h", "doc_id").limit(2 * sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    one = F.broadcast(picked).join(texts, "doc_id")  # at most 3 * sample documents

    shares = {True: sample_bytes // 3, False: sample_bytes - sample_bytes // 3}

    def fits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size", "t"], ignore_index=True)
        room, taken = dict(shares), []
        for y, size in zip(pdf["y"].tolist(), pdf["size"].tolist(), strict=True):
            taken.append(size <= room[y])
            room[y] -= size if taken[-1] else 0
        pdf["room"] = np.where(taken, pdf["size"], 0)
        for y, own in pdf.groupby("y"):
            if not own["room"].any() and own["size"].min() > shares[y]:
                pdf.loc[own["size"].idxmin(), "room"] = max(shares[y], 1)
                taken[own["size"].idxmin()] = True
        return pdf[["doc_id", "t", "room"]][taken]

    @F.pandas_udf("string")
    def shortened(text: pd.Series, room: pd.Series) -> pd.Series:
        return pd.Series([some_of(t, int(n)) for t, n in zip(text, room, strict=True)], dtype=object)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "text"], ignore_index=True)
        weights = fit(pdf["text"].tolist(), (pdf["toxic"] > 0).to_numpy(), bits).tobytes()
        del pdf
        give_back()
        return pd.DataFrame({"w": [weights]})

    # the sample is chosen by sizes alone, so what meets in the one task is bounded
    sized = one.withColumns({"size": F.octet_length("text"), "t": F.xxhash64("text"), "y": F.col("toxic") > 0, "task": F.pmod("h", F.lit(1))})
    ids = sized.select("task", "doc_id", "h", "t", "y", "size").distinct()
    limit = cut(ids.groupBy("task").applyInPandas(fits, "doc_id long, t long, room long"))
    kept = sized.join(F.broadcast(limit), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
    kept = kept.withColumn("text", F.when(F.col("size") <= F.col("room"), F.col("text")).otherwise(shortened("text", "room")))
    row = kept.groupBy("task").applyInPandas(run, "w binary").first()
    return np.frombuffer(row[0], np.float32) if row else fit([], np.empty(0), bits)


def some_of(text: str, room: int) -> str:
    """Instances of text, a sentence each, in order of a hash until the next one doesn't fit into room bytes; one at least, whole if it has any words."""
    every = [" ".join(words[lo : lo + INSTANCE]) for _, _, words in sentences(text) for lo in range(0, len(words), INSTANCE)]
    out, left = [], room
    for x in sorted(set(every), key=lambda x: (zlib.crc32(x.encode("utf-8", "replace")), x)):
        size = len(x.encode("utf-8", "replace")) + 2
        if out and size > left:
            break
        out.append(x)
        left -= size
    return ". ".join(out)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, score (0 to 1), sentences array<struct<start, end, score>> of the offending ones (code points).

    Null texts, empty texts and texts without words: 0. Repeated rows: a row each. Null doc_id: kept. A long text is many sentences and
    scored whole. Empty table: no rows. Only text is read; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for pdf in frames:
            found = [scorer.text(t) if t else (0.0, []) for t in pdf["text"]]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "score": [s for s, _ in found], "sentences": spans})

    rows = docs.select(F.col("doc_id").cast("string"), "text")
    out = rows.mapInPandas(sparing(run), "doc_id string, score double, sentences array<struct<start:long,end:long,score:double>>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold."""
    weights = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    @sparing
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for text in batches:
            yield pd.Series([scorer.text(t)[0] if t else 0.0 for t in text], dtype=float)

    return docs.where(run("text") < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is false where doc_id is null: such a row has no label."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_toxicity": op6_toxicity}
