import random
import zlib

import numpy as np
import pytest

from quillmatch.llm import toxicity as T


def corpus(n, seed=1):
    rng = random.Random(seed)
    calm = [f"word{i}" for i in range(400)]
    bad = ["vile", "vilest", "wretch", "wretched"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        s = [[rng.choice(calm) for _ in range(rng.randrange(3, 12))] for _ in range(rng.randrange(1, 40))]
        if toxic:
            for _ in range(2):
                t = rng.choice(s)
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, ". ".join(" ".join(x) for x in s) + ".", int(toxic)))
    return rows


def test_held_out_accuracy_and_sentences(spark, tmp_path):
    rows = corpus(1500)
    docs = [(i, t, "x", 0) for i, t, _ in rows] + [(None, "vile", "x", 0), (5000, None, "x", 0), (5001, "", "x", 0), (5002, "...", "x", 0), (3, rows[3][1], "x", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, score string, toxic int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (9999, 1, 0), (1, None, 0), (2, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int, text int").write.parquet(f"{tmp_path}/labels.parquet")
    got = T.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.score == 0 for r in got if r.doc_id in (5000, 5001, 5002)) and all(0 <= r.score <= 1 for r in got)
    df = spark.createDataFrame([(1, "word1 word2 word3. you are vile indeed! word5 word6.")], "doc_id long, text string")
    weights = T.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    (row,) = T.score(df, weights).collect()
    assert [df.first().text[s.start : s.end].strip() for s in row.sentences] == ["you are vile indeed"]


def test_long_texts_do_not_starve_the_fit(spark):
    rows = corpus(400)
    size = 6 * sum(len(t) for _, t, _ in rows)
    long = [(i, "word1 word2. " * (size // 10), y) for i, y in zip(range(1000, 1008), (0, 1) * 4)]  # some come first by hash
    docs = spark.createDataFrame([r[:2] for r in rows + long], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + long], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in T.score(docs, T.train(docs, labels, sample_bytes=size)).collect()}
    assert np.mean([(scores[i] >= 0.5) == y for i, _, y in rows]) > 0.97 and len(scores) == len(rows) + len(long)


def test_a_label_none_of_whose_texts_fits_takes_part_by_sentences(spark):
    rows = corpus(400)
    calm = [r for r in rows if not r[2]]
    bad = [(i, "you vile wretch. " * 3000 + "word1 word2 word3. " * 100, 1) for i in (2001, 2002, 2003)]
    docs = spark.createDataFrame([r[:2] for r in calm + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in calm + bad], "doc_id long, toxic int")
    weights = T.train(docs, labels, sample_bytes=60_000)
    got = {r.doc_id: r.score for r in T.score(docs, weights).collect()}
    assert all(got[i] >= 0.5 for i, _, _ in bad) and np.mean([got[i] < 0.5 for i, _, _ in calm]) > 0.97
    assert T.score(docs, T.train(docs, labels, sample_bytes=10)).count() == len(calm) + len(bad)
    assert T.some_of("", 10) == "" and T.some_of("...", 10) == "" and T.some_of("Ab cd. ef", 1) in ("ab cd", "ef")
    long = " ".join(f"w{i}" for i in range(1000))
    assert 0 < len(T.some_of(long, 500)) <= 500 and set(T.some_of(long, 500).replace(".", "").split()) <= set(long.split())


def test_noisy_or():
    w = np.zeros((1 << 10) + 1, np.float32)
    w[-1] = -1.0
    p = 1 / (1 + np.exp(1.0))
    score, spans = T.Scorer(w).text("a b. c d! e")
    assert score == pytest.approx(1 - (1 - p) ** 3) and spans == []


def test_one_label_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert [r.score < 0.5 for r in T.score(docs, T.train(docs, labels)).collect()] == [True, True]
    assert [r.score < 0.5 for r in T.score(docs, T.train(docs, labels.limit(0))).collect()] == [True, True]
    assert T.score(docs.limit(0), T.train(docs, labels)).count() == 0
    assert T.drop_toxic(docs, labels).columns == docs.columns
