import random

import pytest

from quillmatch.operators import nearkeys as N


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(w, rng, most):
    w = list(w)
    for _ in range(rng.randrange(most + 1)):
        i = rng.randrange(len(w) + 1)
        w[i : i + rng.randrange(2)] = rng.choice(["", "x", "a", "나"])
    return "".join(w) or "q"


@pytest.mark.parametrize("least", [0.95, 0.8, 0.7, 0.65, 0.51])
def test_near_keys_against_brute_force(spark, least):
    """Edits anywhere, the first letter included; short keys; repeated runs; null and blank keys."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 22))) for _ in range(90)] + ["aaaaaaaa", "a", "ab", "가나다라마바", "나나나나나"]
    a, b = sorted(set(base)), sorted({edited(w, rng, 4) for w in base})
    frame = lambda keys, c: spark.createDataFrame([(x, 1) for x in [*keys, *keys[:5], None, "", " "]], f"{c} string, d int")
    got = N.near_keys(frame(a, "k"), "k", frame(b, "rk"), "rk", least).collect()
    want = {(x, y): 1 - distance(x, y) / max(len(x), len(y)) for x in a for y in b}
    assert {(r.k, r.rk): pytest.approx(r.score) for r in got} == {p: s for p, s in want.items() if s >= least}
    assert N.near_keys(frame([], "k").limit(0), "k", frame(b, "rk"), "rk", least).count() == 0


def test_few_candidates_among_ten_thousand_keys(spark):
    rng = random.Random(9)
    parts = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "un", "er")]
    keys = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(3, 9))) for _ in range(10_400)})[:10_000]
    near = [edited(w, rng, 1) for w in keys[::10]]
    a, b = spark.createDataFrame([(x,) for x in near], "k string").distinct(), spark.createDataFrame([(x,) for x in keys], "rk string")
    n = N.candidate_pairs(a, "k", b, "rk", 0.8).count()
    assert n < 0.05 * a.count() * len(keys)
    found = {r.k for r in N.near_keys(a, "k", b, "rk", 0.8).collect()}
    assert all(x in found for x, y in zip(near, keys[::10], strict=True) if 1 - distance(x, y) / max(len(x), len(y)) >= 0.8)


def test_residual_partition(spark):
    stmt = [("A", "abcdefghij", 1), ("A", "abcdefghij", 2), ("A", "zzzz", 3), ("A", "exacthere", 4), ("B", "abcdefghix", 5), (None, "abcdefghij", 6), ("A", "", 7), ("A", None, 8)]
    ref = [("A", "abcdefghiX"), ("B", "exacthere"), ("A", "abcdefghij1"), ("C", "abcdefghij"), ("C", "abcdefghij"), ("A", None)]
    un = spark.createDataFrame(stmt, "ch string, k string, no int")
    got = N.residual_partition(un, spark.createDataFrame(ref, "ch string, k string"), "ch", "k", "no", 0.8, 2).collect()
    rows = {(r.ch, r.k): r for r in got}
    assert {k: (r.rows, r.kind) for k, r in rows.items()} == {
        ("A", "abcdefghij"): (2, "same_channel_fuzzy"), ("A", "zzzz"): (1, "absent"), ("A", "exacthere"): (1, "other_channel_exact"), ("B", "abcdefghix"): (1, "other_channel_fuzzy"), ("", "abcdefghij"): (1, "other_channel_exact")
    }
    best = rows["A", "abcdefghij"]
    assert [(x.key, x.same, x.channel) for x in best.nearest] == [("abcdefghij", False, "C"), ("abcdefghij1", True, "A")] and best.score == 1
    assert rows["A", "zzzz"].score is None and rows["A", "zzzz"].nearest == []
