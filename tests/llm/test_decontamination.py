import random
import re

from quillmatch.llm import decontamination as D


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window):
    wins = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(name)
    lengths = {len(k) for k in wins}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, named = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit[i : i + n] = [True] * n
                    named |= wins[tuple(w[i : i + n])]
        named.discard(None)
        out.append((doc_id, len(w), sum(hit), sorted(map(str, named)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def fixture(letters):
    rng = random.Random(letters)
    vocab = [f"W{i}é" if i % 3 else f"x{i}" for i in range(letters)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 12, 13, 14, 30])))) for i in range(12)]
    items += [(50, None), (51, "...!"), (7, items[3][1] + " extra"), (None, " ".join(rng.choice(vocab) for _ in range(15)))]
    docs = [(0, None), (1, ""), (2, "-"), (None, items[5][1]), (4, items[0][1]), (4, items[0][1])]
    for d in range(10, 60):
        parts = []
        for _ in range(rng.randrange(6)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += w[a : a + rng.randrange(40)] + [rng.choice([*vocab, "other"]) for _ in range(rng.randrange(20))]
        docs.append((d, rng.choice([" ", ", ", "\n- "]).join(parts)))
    return docs, items


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_against_brute_force(spark, tmp_path):
    for letters, block in ((4, 10**6), (40, 10**6), (40, 60)):
        docs, items = fixture(letters)
        d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, items string")
        b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, spans string")
        got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in D.find_contamination(d, b, block_words=block).collect()]
        assert sorted(got, key=key) == sorted(brute(docs, items, 13), key=key)


def test_removal(spark):
    item = " ".join(f"q{i}" for i in range(20))
    filler = " ".join(f"z{i}" for i in range(500))
    docs = spark.createDataFrame([(1, item, 5), (2, f"{filler} {item}. {filler}", 9), (3, filler, 7), (None, None, None)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for block in (10**6, 5):
        kept = D.remove_contamination(docs, bench, block_words=block)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 2, 3}
        cut = {r.doc_id: r for r in D.remove_contamination(docs, bench, span_words=15, block_words=block).collect()}
        assert cut[2].text == f"{filler} . {filler}" and cut[2].n_chars == len(cut[2].text) and cut[3].text == filler


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.find_contamination(one, b).first().n_hit == 0


def test_removal_keeps_columns_of_any_name(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, item, "a", "b", 1), (None, "other words", "c", "d", 2), (None, "other words", "c", "d", 2), (4, None, "e", "f", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, judged string, key string, spans long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for block in (10**6, 5):
        kept = D.remove_contamination(docs, bench, block_words=block)
        assert kept.columns == docs.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, rows[1:]))
        assert D.remove_contamination(docs.limit(0), bench, block_words=block).count() == 0


def test_very_long_text(spark):
    rng = random.Random(3)
    item = [f"q{i}" for i in range(40)]
    words = [rng.choice([*item, "z"]) for _ in range(400_000)]
    words[1000:1040] = words[300_000:300_040] = item
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    r = D.find_contamination(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).first()
    assert (r.n_words, r.n_hit, r.contaminated) == (400_000, 80, False)
