import random
import zlib

import numpy as np
import pytest

from quillmatch.llm import quality as Q


def prose(rng):
    common = ["the", "of", "and", "to", "in", "is"]
    rare = [f"{a}{b}{c}" for a in ("tre", "san", "vol") for b in ("mi", "ra", "ke") for c in ("tion", "ly", "s")]
    lines = []
    for _ in range(rng.randrange(1, 12)):
        words = [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(rng.randrange(6, 20))]
        lines.append(" ".join(words).capitalize() + ".")
    return "\n".join(lines)


def junk(rng):
    kind, words = rng.randrange(3), prose(rng).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " | ".join(w for w in words if len(w) > 3)
    return " ".join(w for w in words[:12] for _ in range(15))


def corpus(n):
    rng = random.Random(4)
    return [(i, prose(rng) if i % 5 else junk(rng), int(i % 5 > 0)) for i in range(n)]


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus(1600)
    odd = [(None, "the of and", 3, 0), (9000, None, 3, 0), (9001, "", 3, 0), (9002, "???", 3, 0), (9003, "the of ퟿ é " * 40000, 3, 0), (3, rows[3][1], 3, 0)]
    spark.createDataFrame([(i, t, 3, 0) for i, t, _ in rows] + odd, "doc_id long, text string, stats int, quality int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (99999, 1, 0), (1, None, 0), (2, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, text int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.op13_quality(spark, str(tmp_path)).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 300 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_held_out_labels_do_not_count(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    one = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    two = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, quality int")
    a, b = Q.train(docs, one), Q.train(docs, two)
    assert all(np.array_equal(x, y) for x, y in zip(a[:3], b[:3], strict=True)) and len(a.feature) == 120
    small = Q.train(docs, one, sample=50)
    assert small.feature.shape == a.feature.shape


def test_splits_and_flattened_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = Q.fit(x, y, trees=60, depth=3)
    assert np.mean((forest.score(x) >= 0.5) == y) > 0.97

    def walk(row):
        z = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            z += value[node - len(feature)]
        return 1 / (1 + np.exp(-z))

    assert np.allclose([walk(r) for r in x[:200]], forest.score(x[:200]))


def test_statistics_of_known_texts():
    names = {k: i for i, k in enumerate(Q.STATISTICS)}
    texts = ["The cat. THE CAT!!\na b b b", "", "   ", "é" * 4]
    x = Q.statistics(texts)
    at = lambda i, k: float(x[i, names[k]])
    assert np.expm1(at(0, "log_words")) == pytest.approx(8) and at(0, "repeats") == pytest.approx(2 / 8) and at(0, "longest_repeat") == pytest.approx(3 / 8)
    assert at(0, "shouted") == pytest.approx(2 / 8) and np.expm1(at(0, "log_lines")) == pytest.approx(2) and at(0, "distinct") == pytest.approx(6 / 8)
    assert at(3, "word_mean") == 4 and np.isfinite(x).all() and not x[1].any()
    assert np.array_equal(Q.statistics(texts * 3)[4:8], x)  # a document's row doesn't depend on its neighbours


def test_one_label_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert [r.score > 0.7 for r in Q.score(docs, Q.train(docs, labels)).collect()] == [True, True]
    assert [r.score for r in Q.score(docs, Q.train(docs, labels.limit(0))).collect()] == [0.5, 0.5]
    assert Q.score(docs.limit(0), Q.train(docs, labels)).count() == 0
