import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmatch.llm import periodic_runs as R


def brute(w):
    """All runs from the definition: rows (start, length, period)."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(text, doc_id=None):
    """(n_runs, best, runs, kept) of one text."""
    w = (text or "").encode().split()
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, n, q)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return len(found), best, found, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(1, 12), st.integers(0, 60))
def test_runs_of_random_words(words, period, repeats):
    w = np.array(words + [words[i % period % len(words)] for i in range(repeats if words else 0)], np.int64)
    assert [tuple(r) for r in R.runs(w, len(w) // 4).tolist()] == brute(w.tolist())


@pytest.mark.parametrize("v", [8, 32])
def test_extensions(v):
    rng = np.random.default_rng(5)
    w = np.concatenate((rng.integers(0, 2, 300), np.tile(rng.integers(0, 3, 40), 6)))
    i, j = (x.ravel() for x in np.triu_indices(len(w), 1))
    got = R.Extensions(w, v).of(i, j)
    want = np.zeros((len(w) + 1, len(w) + 1), np.int64)
    for a in range(len(w) - 1, -1, -1):
        want[a, :-1] = np.where(w == w[a], want[a + 1, 1:] + 1, 0)
    assert (got == want[i, j]).all()


def test_cover_has_every_difference():
    for v in (4, 32, 64):
        c = R.difference_cover(v)
        assert {(a - b) % v for a in c.tolist() for b in c.tolist()} == set(range(v))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) + rng.choice(["", " x y z" * 7, "\n\tu u u u u u u"])) for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " \n ", "a a a a a", "a a a a a a", "é é é é é é é é é é é é", "long " * 30000 + "end"])]
    rows += [(None, "b b b b b b b"), (3, rows[3][1])]
    spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, runs string, start long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(R.op12_periodic_runs(spark, str(tmp_path)).collect(), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t in rows:
        n, best, found, kept = plain(t, k) if k != 1006 else long_run(t, k)
        start, length, period = best or (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want.append((k, n, start, length, period, None if best is None else 1000 * length // period, sha(lines), sha(kept)))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def long_run(text, doc_id):
    assert zlib.crc32(str(doc_id).encode()) % 10
    return 1, (0, 30000, 1), [(0, 30000, 1)], "long end"


def test_operator_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, None)], "doc_id long, text string")
    one, two = R.periodic_runs(df).orderBy("doc_id").collect()
    assert (one.n_words, one.n_runs, one.start, one.length, one.period, one.exponent_milli, one.collapsed) == (10, 1, 1, 8, 2, 4000, "x a b y")
    assert (two.n_words, two.n_runs, two.start, two.runs, two.collapsed) == (0, 0, None, [], "")
    assert R.periodic_runs(df.limit(0)).count() == 0
