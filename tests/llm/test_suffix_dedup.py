import random

import numpy as np

from quillmatch.llm.suffix_dedup import remove_repeated_bytes, suffix_order

SCHEMA = "doc_id long, text string, k string, t string"


def brute(rows, width):
    least = {}
    for doc_id, text in rows:
        d, t = (-1 if doc_id is None else doc_id), (text or "").encode()
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            least[w] = min(least.get(w, d), d)
    out = []
    for doc_id, text in rows:
        d, t = (-1 if doc_id is None else doc_id), (text or "").encode()
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if least[t[i : i + width]] < d:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


def texts(rng):
    base = "".join(rng.choice(["ab", "é", " the ", "of", "\n", "x"]) for _ in range(3000))
    rows = [(0, None), (1, ""), (2, "short"), (None, base[:300]), (4, "a" * 500), (5, "a" * 700), (6, base[100:400]), (6, base[100:400])]
    for i in range(10, 90):
        t = ""
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(2900)
            t += base[a : a + rng.randrange(120)] + "".join(rng.choice("uvwxyz é") for _ in range(rng.randrange(60)))
        rows.append((i, t))
    rows += [(200 + i, rows[20][1]) for i in range(4)] + [(300 + i, rows[21][1] + str(i)) for i in range(6)]
    return rows


def test_against_brute_force(spark):
    rows = texts(random.Random(2))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for size in (1 << 22, 1 << 12):
        got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_repeated_bytes(df, bytes_per_part=size).collect()]
        assert sorted(got) == brute(rows, 50)


def test_one_doc_id_with_a_copy_and_another_text(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(2, one), (5, one), (5, two), (7, two + " c"), (None, "d " * 9)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for size in (1 << 22, 1 << 6):
        got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_repeated_bytes(df, bytes_per_part=size).collect()]
        assert sorted(got) == brute(rows, 50)


def test_rows_of_one_id_in_several_parts(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(d, f"{d}{i} {base[i * 9 : i * 9 + 120]}") for i in range(25) for d in (None, 4, 9)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_repeated_bytes(df, bytes_per_part=1 << 9).collect()]
    assert sorted(got) == brute(rows, 50)


def test_very_long_text(spark):
    rng = random.Random(10)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_000_000))
    rows = [(1, long), (2, "x" * 70 + long[5000:1_500_000])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans)) for r in remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2_000_000, 0, 0), (2, 1_495_070, 1_495_000, 1)]


def test_suffix_order():
    rng = np.random.default_rng(3)
    for n, letters, width in ((400, 2, 50), (3000, 3, 50), (2000, 1, 30), (500, 200, 7)):
        buf = rng.integers(0, letters, n).astype(np.uint8)
        buf[n // 2 :] = buf[: n - n // 2]
        at = rng.permutation(n - width)
        group = rng.integers(0, 3, len(at))
        order, classes = suffix_order(buf, at, group, width)
        keys = [(group[i], buf[at[i] : at[i] + width].tobytes()) for i in order]
        assert keys == sorted(keys)
        assert [c - d for c, d in zip(classes[1:], classes)] == [int(a != b) for a, b in zip(keys, keys[1:])]


def test_empty_table(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
