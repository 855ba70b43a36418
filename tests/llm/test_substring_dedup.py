import random
import re

import numpy as np
import pytest

from quillmatch.llm import hashing as H
from quillmatch.llm import parts as P
from quillmatch.llm.substring_dedup import remove_repeated_windows

SCHEMA = "doc_id long, text string, part string, k string"


def brute(rows, width):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(60)}é" for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (None, " ".join(base[:50])), (5, "one two " * 30), (5, "one two " * 30)]
    for i in range(10, 120):
        a, b = sorted(rng.randrange(400) for _ in range(2))
        rows.append((i, " ".join(base[a:b] + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(40))]) + "\n"))
    rows += [(200 + i, rows[20][1]) for i in range(5)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for width in (4, 20):
        for size in (1 << 22, 1 << 11):
            got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(df, width, size).collect()]
            assert sorted(got, key=key) == sorted(brute(rows, width), key=key)


def test_words_that_collide_by_powers(spark):
    """Thue-Morse words and their complements have one hash for every odd base modulo 2**64; nothing repeats here."""
    thue = lambda flip: "".join("ab"[i.bit_count() % 2 ^ flip] for i in range(4096))
    shared = " ".join(f"w{i}" for i in range(19))
    for n in (1024, 2048, 4096):
        df = spark.createDataFrame([(i, f"{shared} {thue(i)[:n]}") for i in range(2)], "doc_id long, text string")
        assert [r.n_removed for r in remove_repeated_windows(df).collect()] == [0, 0]


def test_words_that_collide_by_sums(spark):
    """Two words with one sum under the key 0: windows of them don't repeat each other, ones of the same word do."""
    one, two = "aaaaaaaaaaaaaaabbabbaabaaaaababbabaabaaaaaaaaabaaaaabbab", "baaabbbbabaababaaaaaababbaaaabaaaabbabbbbbbaaaabaaabaaba"
    assert len(set(H.Words([f"{one} {two}".encode()]).hashes().tolist())) == 1 and len(set(H.Words([f"{one} {two}".encode()]).hashes(7).tolist())) == 2
    shared = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {two}"), (3, f"{shared} {two} x")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeated_windows(df).collect()} == {1: 0, 2: 0, 3: 20}


def test_equal_first_hashes():
    keys, more = np.array([5, 5, 3, 5, 3], P.U), np.array([2, 1, 9, 2, 9], P.U)
    order, new = P.in_order(keys, more)
    assert order.tolist() == [2, 4, 1, 0, 3] and new.tolist() == [True, False, True, True, False]


def test_very_long_text(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[1000:200_000])), (3, "y" * 10**6)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 300_000, 0), (2, 199_001, 199_000), (3, 1, 0)]


@pytest.mark.parametrize("ids", ["skewed", "null", "one"])
def test_parts_are_bounded_by_bytes(spark, ids):
    """Short texts under low ids and long ones under high ids; all ids null; all rows of one id."""
    rng = random.Random(8)
    rows = [(i, f"{rng.random()} short") for i in range(20_000)] + [(10**9 + i, f"{rng.random()}" + "x" * 100_000) for i in range(200)]
    df = spark.createDataFrame([({"skewed": i, "null": None, "one": 7}[ids], t) for i, t in rows], "doc_id long, text string")
    limit = 1 << 20
    parts = P.Parts(df, 0.16, limit)
    sizes = parts.rows.selectExpr("part", "octet_length(t) n").groupBy("part").sum("n").collect()
    assert max(r[1] for r in sizes) <= limit + 100_020 and sum(r[1] for r in sizes) == sum(len(t) for _, t in rows)
    assert len(parts.rows._jdf.queryExecution().analyzed().toString()) < 5000
    order = [(r.k, bytes(r.t), r.part) for r in parts.rows.collect()]
    by_part = [p for *_, p in sorted(order)]
    assert by_part == sorted(by_part)


def test_rows_of_one_id_in_several_parts(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join([f"{d}{i}", *base[i % 7 : 30 + i]])) for i in range(25) for d in (None, 4, 9)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(df, 20, 1 << 8).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 20), key=key)


def test_one_doc_id_with_a_copy_and_another_text(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(2, one), (5, one), (5, two), (7, two + " c"), (None, "d " * 9)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for size in (1 << 22, 1 << 6):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(df, 20, size).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, 20), key=key)


def test_empty_table(spark):
    assert remove_repeated_windows(spark.createDataFrame([], SCHEMA)).count() == 0
