import random
from collections import Counter

import numpy as np
import pytest

from quillmatch.llm import language_id as L


def slow_grams(text):
    out = []
    word = ""
    for c in [*text.lower(), " "]:
        if c.isalpha():
            word += c
        elif word:
            padded = "\1" + word + "\1"
            out += list(word) + [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]
            word = ""
    return Counter(out)


def as_number(gram):
    n = 0
    for c in gram.rjust(3, "\0"):
        n = n << 21 | ord(c)
    return n


def test_grams():
    texts = ["", "Ab, c", "  é漢字 x!y ", "...", "a", "z" * 5, "İß 1a2"]
    g = L.Grams(texts)
    for i, t in enumerate(texts):
        values, counts = np.unique(g.plain(g.grams(i)), return_counts=True)
        assert dict(zip(values.tolist(), counts.tolist())) == {as_number(k): n for k, n in slow_grams(t).items()}
        assert g.has_letters[i] == any(c.isalpha() for c in t)


def test_distance_against_plain_python():
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(300))
    known = {}
    for k, s in (("aa", "abcde"), ("bb", "cdefg")):
        g = L.Grams([make(s)])
        known[k] = g.plain(L.top(g.grams(0), 50)[0])
    text = make("bcdef")
    g = L.Grams([text])
    own = g.plain(L.top(g.grams(0), 50)[0])
    grams = sorted(((n, as_number(k)) for k, n in slow_grams(text).items()), key=lambda x: (-x[0], x[1]))[:50]
    assert own.tolist() == [k for _, k in grams]
    away = {k: sum(abs(list(p).index(x) - i) if x in p else 50 for i, x in enumerate(own)) for k, p in known.items()}
    name, score = L.Ranker(known, 50).best(own)
    assert away[name] == min(away.values()) and score == pytest.approx(1 - away[name] / (50 * len(own)))


def test_held_out_accuracy(spark, tmp_path):
    rng = random.Random(5)
    words = {"en": ["the", "and", "thing", "other", "when"], "fr": ["le", "être", "où", "quelle", "eau"], "de": ["der", "über", "schön", "nicht", "eine"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 60))), lang if i % 7 else None, "s"))
    truth = {r[0]: r[2] for r in rows}
    rows += [(700, None, "en", "s"), (701, "12 ...", "fr", "s"), (None, "über nicht eine schön", "de", "s"), (5, rows[5][1], rows[5][2], "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op2_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and truth.get(r.doc_id)]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (700, 701)} == {(700, "und", 0.0), (701, "und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.profiles(none) == {} and L.identify(none, {}).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert L.identify(one, {}).first().lang_pred == "und"
