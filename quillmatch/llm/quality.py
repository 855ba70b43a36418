"""Operator 13: a quality classifier of histogram gradient-boosted trees over document statistics.

A document is a row of STATISTICS: sizes, shares of kinds of letters and words, repetition, lines, and the worst stretches of SPAN words. Trees are
grown on histograms: each statistic is cut into `bins` ranges at quantiles once, and a split is chosen from the sums of gradients and curvatures
in its ranges. A forest is flattened into arrays, a full binary tree in breadth-first order each, so a whole batch of documents goes
down one level of one tree by an index.

Statistics are computed where the documents are. The fit runs in one task on the statistics (not texts) of at most `sample` labelled documents;
scoring is a map over all documents with the arrays (trees * 2**depth numbers) broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm import hashing as H
from quillmatch.llm.workers import give_back, sparing

#: Words of a stretch.
SPAN = 40
#: Kinds of bytes that are counted.
KINDS = {
    "upper": bytes(range(0x41, 0x5B)), "lower": bytes(range(0x61, 0x7B)), "digit": b"0123456789", "stop": b".!?", "comma": b",;:'\"()-", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "pipe": b"|",
    "bang": b"!", "high": bytes(range(0x80, 0x100)), "newline": b"\n", "space": H.SPACES,
}
STATISTICS = [
    "log_bytes", "log_words", "word_mean", "word_deviation", *KINDS, "short", "long", "distinct", "commonest", "pairs_distinct", "repeats", "longest_repeat", "shouted", "capital", "no_letter",
    "ends_stop", "symbol_words", "log_lines", "words_a_line", "lines_distinct", "lines_stopped", "span_repeats", "span_symbols", "span_short_least", "span_short_most", "span_distinct_least", "span_shouted", "span_length_most",
]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values between each bound and the next."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[bounds])


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: how many distinct keys, and the count of the commonest."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    at = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))))
    most = np.zeros(n)
    np.maximum.at(most, o[at], np.diff(np.concatenate((at, [len(k)]))))
    return np.bincount(o[at], minlength=n).astype(float), most


def _statistics(texts: list[bytes]) -> np.ndarray:
    words = H.Words(texts)
    buf, n = words.buf, len(texts)
    sizes = np.fromiter(map(len, texts), float, n)
    count = words.counts.astype(float)
    table = {k: np.isin(np.arange(256), list(v)) for k, v in KINDS.items()}
    kinds = {k: t[buf] for k, t in table.items()}
    of = lambda x, y: x / np.maximum(y, 1)
    # bytes of a kind in each document (the byte that parts two documents isn't counted) and in each word
    each = {k: _sums(v, words.text_starts) - (k == "space") for k, v in kinds.items()}
    starts, ends = words.starts, words.ends
    inner = lambda k: (c := np.concatenate(([0], np.cumsum(kinds[k], dtype=np.int32))))[ends] - c[starts]
    points = ends - starts - _runs(buf >= 0x80, buf < 0xC0, starts, ends)
    upper, lower, high, symbol = (inner(k) for k in ("upper", "lower", "high", "symbol"))
    letters = upper + lower + high
    owner = np.repeat(np.arange(n), words.counts)
    total = lambda x: np.bincount(owner, x, n)
    mean = of(total(points), count)
    values = words.hashes()
    first = np.zeros(len(owner), bool)
    first[words.first[:-1][words.counts > 0]] = True
    again = np.concatenate(([False], values[1:] == values[:-1])) & ~first
    distinct, commonest = _distinct(values, owner, n)
    follow = np.flatnonzero(~first)
    pairs, _ = _distinct(H.mix(values[follow - 1]) + values[follow], owner[follow], n)
    # the longest row of one word: the distance between places that don't repeat
    fresh = np.flatnonzero(~again)
    longest = np.zeros(n)
    np.maximum.at(longest, owner[fresh], np.diff(np.concatenate((fresh, [len(owner)]))))
    short, shouted, odd = points <= 3, (upper == letters) & (upper > 1), symbol > 0
    last = table["stop"][buf[ends - 1]] if len(ends) else np.empty(0, bool)
    # lines with words
    line = np.concatenate(([0], np.cumsum(kinds["newline"], dtype=np.int64)))[starts] if len(starts) else np.empty(0, np.int64)
    opens = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1]))) if len(line) else np.empty(0, bool))
    lines = np.bincount(owner[opens], minlength=n)
    sums = H.prefix_sums(values, H.WORD_BASE)
    closes = np.concatenate((opens[1:], [len(line)])).astype(np.int64) if len(opens) else opens
    one, _ = _distinct(H.span_hashes(sums, opens, closes, H.WORD_BASE), owner[opens], n)
    stopped = np.bincount(owner[opens], last[closes - 1] if len(opens) else None, n)
    # stretches of SPAN words; a document's last one may be shorter, but only a document's only one is under half of it
    place = np.arange(len(owner)) - words.first[:-1][owner]
    whole = np.maximum(1, (words.counts + SPAN // 2) // SPAN)
    base = np.concatenate(([0], np.cumsum(whole)))
    span = base[owner] + np.minimum(place // SPAN, whole[owner] - 1) if len(owner) else owner
    m, home = int(base[-1]), np.repeat(np.arange(n), whole)
    held = np.maximum(np.bincount(span, minlength=m), 1)
    share = lambda x: np.bincount(span, x, m) / held
    span_distinct = _distinct(values, span, m)[0] / held

    def worst(x: np.ndarray, fn: np.ufunc = np.maximum) -> np.ndarray:
        return fn.reduceat(x, base[:-1]) if n else np.empty(0)

    assert len(home) == m
    columns = [
        np.log1p(sizes), np.log1p(count), mean, np.sqrt(np.maximum(of(total(points.astype(float) ** 2), count) - mean**2, 0)), *(of(each[k], sizes) for k in KINDS), of(total(short), count),
        of(total(points >= 10), count), of(distinct, count), of(commonest, count), of(pairs, np.maximum(count - 1, 0)), of(total(again), count), of(longest, count), of(total(shouted), count),
        of(total(table["upper"][buf[starts]] if len(starts) else again), count), of(total(letters == 0), count), of(total(last), count), of(total(odd), count), np.log1p(lines), of(count, lines), of(one, lines), of(stopped, lines),
        worst(share(again)), worst(share(odd)), worst(share(short), np.minimum), worst(share(short)), worst(span_distinct, np.minimum), worst(share(shouted)), worst(share(points)),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _runs(high: np.ndarray, below: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of each word that continue a code point."""
    c = np.concatenate(([0], np.cumsum(high & below, dtype=np.int32)))
    return c[ends] - c[starts]


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text; a text without words has zeros where nothing can be said."""
    out = [_statistics(some) for _, some in H.chunks((t.encode() for t in texts), 1 << 18)]
    return np.concatenate(out) if out else np.empty((0, len(STATISTICS)), np.float32)


class Forest(NamedTuple):
    """Trees as arrays of (tree, node): node i has the children 2 * i + 1 (at most the threshold) and 2 * i + 2; leaves are the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += value[node - len(feature)]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Boosted trees for the labels y (0 or 1) by the logistic loss. ridge: shrinks values of leaves; least: curvature that a leaf needs."""
    n, width = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    rate_1 = float(y.mean()) if n else 0.5
    base = float(np.clip(np.log((rate_1 + 1e-6) / (1 - rate_1 + 1e-6)), -12, 12))
    if rate_1 in (0.0, 1.0) or not n:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.int64)  # bin b: above cut b - 1, at most cut b
    limits = np.full((width, bins), np.inf)
    for f, c in enumerate(cuts):
        limits[f, : len(c)] = c
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    z = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 1 << level
            g, h = np.empty((width, nodes, bins)), np.empty((width, nodes, bins))
            for f in range(width):
                at = node * bins + binned[f]
                g[f] = np.bincount(at, grad, nodes * bins).reshape(nodes, bins)
                h[f] = np.bincount(at, curve, nodes * bins).reshape(nodes, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.transpose(1, 0, 2).reshape(nodes, -1)
            choice = best.argmax(axis=1)
            f, b = choice // bins, choice % bins
            split = best[np.arange(nodes), choice] > 1e-9
            first = nodes - 1
            feature[t, first : first + nodes] = np.where(split, f, 0)
            threshold[t, first : first + nodes] = np.where(split, limits[f, b], np.inf)
            right = split[node] & (binned[f[node], np.arange(n)] > b[node])
            node = 2 * node + right
        gl, hl = np.bincount(node, grad, leaves), np.bincount(node, curve, leaves)
        value[t] = -rate * gl / (hl + ridge)
        z += value[t][node]
    return Forest(feature, threshold, value, base)


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """keep (text columns), stats: the statistics of each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[list(keep)].assign(stats=list(statistics(pdf["text"].tolist())))

    return docs.select(*keep, "text").mapInPandas(sparing(run), ", ".join(f"{c} string" for c in keep) + ", stats array<float>")


def in_fold(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    """Whether labels of doc_id are held out; a null doc_id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 30_000, **settings: float) -> Forest:
    """A forest from rows that in_fold() doesn't hold out. labels(doc_id, quality, ...).

    sample: labelled documents at most, in order of a hash of doc_id. Null doc_id, null quality and labels without a document are left
    out; of several labels of one document the highest counts, equal texts of one document count once. Without labels, or with one label
    only, every score is that label's rate.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("string").alias("y"))
    chosen = chosen.where(~in_fold(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id").cast("string")).orderBy("h", "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))  # at most `sample` rows
    # a doc_id may have many texts: what meets in the one task is bounded again
    sized = described(rows, "doc_id", "h", "y").distinct().orderBy("h", "doc_id", "stats").limit(sample)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], kind="stable", ignore_index=True)
        x = np.stack(list(pdf["stats"])).astype(np.float32)
        got = fit(x, (pdf["y"] == "true").to_numpy().astype(float), **settings)
        give_back()
        return pd.DataFrame({"feature": [got.feature.astype(np.int32).tobytes()], "threshold": [got.threshold.tobytes()], "value": [got.value.tobytes()], "base": [got.base], "trees": [len(got.feature)]})

    row = sized.groupBy(F.lit(0).alias("task")).applyInPandas(run, "feature binary, threshold binary, value binary, base double, trees long").first()
    if row is None:
        return fit(np.empty((0, len(STATISTICS)), np.float32), np.empty(0))
    shape = (row.trees, -1) if row.trees else (0, 1)
    return Forest(np.frombuffer(row.feature, np.int32).reshape(shape), np.frombuffer(row.threshold, np.float64).reshape(shape), np.frombuffer(row.value, np.float64).reshape(shape), row.base)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, score (0 to 1), stats (the statistics the score is made of).

    Null texts count as empty; an empty text has the score of its statistics. Repeated rows: a row each. Null doc_id: kept. A long text
    is read whole. Empty table: no rows. Only text is read; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = statistics(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "score": sent.value.score(x), "stats": list(x)})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(sparing(run), "doc_id string, score double, stats array<float>").withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_quality": op13_quality}
