import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import near_dedup as N
from quillmatch.llm.components import components

SCHEMA = "doc_id long, text string, n long, root string"


def sets_of(rows, width):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((doc_id, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    return out


def brute(rows, width, percent=80):
    sets = sets_of(rows, width)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets))


def corpus():
    rng = random.Random(12)
    word = lambda: rng.choice(["The", "of", "É", "a"]) + str(rng.randrange(60))
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  b\n"), (4, "b a"), (5, "one two three four"), (6, "one two three four"), (7, "x")]
    for g in range(60):
        base = [word() for _ in range(rng.choice([5, 12, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 3, 8, 40])):
            w = list(base)
            for _ in range(rng.randrange(int(1 + len(w) * rng.choice([0.01, 0.04, 0.08])))):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w)))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in N.near_duplicates(df, shingle=4).collect())
    assert got == brute(rows, 4)
    kept = N.drop_near_duplicates(df, shingle=4)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _, _, k in brute(rows, 4) if k}


def test_dense_region_goes_deeper(spark, monkeypatch):
    monkeypatch.setattr(N, "REGION", 6)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in N.near_duplicates(df, shingle=4).collect()) == brute(rows, 4)


def test_dense_regions_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "REGION", 6)
    rng = random.Random(16)
    base = [f"w{i}" for i in range(120)]

    def edited(words, n):
        w = list(words)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        return w

    # near copies at the limit; a crowd of variants that aren't links, with true links inside that are joined through nothing else
    rows = [edited(base, rng.randrange(5)) for _ in range(150)]
    crowd = [f"c{i}" for i in range(120)]
    for _ in range(150):
        variant = edited(crowd, 8)
        rows += [variant, edited(variant, 3)] if rng.random() < 0.3 else [variant]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in N.near_duplicates(df, shingle=4).collect()) == brute(rows, 4)


def crowd(n, words=200, changed=5, seed=18):
    """Copies of one text with words changed in each: similar (about 0.66), no links."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{j}" for j in range(words)]
        for at in rng.sample(range(words), changed):
            w[at] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("shingle", [4, 5])
def test_crowd_of_similar_documents_makes_few_pairs(spark, shingle):
    """Twice the crowd makes about twice the pairs that are estimated, not four times."""
    made = []
    for n in (700, 1400):
        df = spark.createDataFrame(crowd(n), "k long, t string")
        members = df.select("k", F.lit(0).alias("tree"), F.lit(0).alias("p"), F.lit(True).alias("dense"), F.col("k").alias("root"))
        ranked = N.cut(N._ranked(df, members, shingle))
        rare, parted = N._rare(ranked, 80), N._parted(ranked, 80)
        pairs = [N._sharing(rare.where(F.col("f") <= N.COMMON).withColumn("root", F.col("k")), 80), N._agreeing(parted.withColumn("root", F.col("k")), 80)]
        made.append(sum(p.count() for p in pairs))
    assert made[1] <= 2.2 * max(made[0], 50), made


def test_classes_without_links_are_not_ranked(spark):
    """Texts that share a passage but are more of their own can't be links: left out; common shingles aren't joined with their number."""
    rng = random.Random(22)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"v{rng.randrange(10**9)}" for _ in range(60)])) for i in range(100)]
    rows += [(1000 + i, t) for i, t in crowd(100, 120, 1)]
    df = spark.createDataFrame(rows, "k long, t string")
    members = df.select("k", F.lit(0).alias("tree"), F.lit(0).alias("p"), F.lit(True).alias("dense"), F.col("k").alias("root"))
    got = {r.k: r for r in N._ranked(df, members, 4).collect()}
    assert sorted(got) == [k for k, _ in rows if k >= 1000]
    for k, held in sets_of(rows, 4):
        if k >= 1000:
            hs = got[k].hs
            assert got[k].n == len(hs) == len({w.h for w in hs}) == len(held) and hs == sorted(hs)
            assert sum(w.f <= N.COMMON for w in hs) <= 8 and {w.f for w in hs if w.f > N.COMMON} == {N.COMMON + 1}


def test_part_keys_lose_no_link(monkeypatch):
    """Sets of common shingles alone, or with some of their own: every pair that is a link agrees in a key that is one's own."""
    rng = np.random.default_rng(19)
    pool = rng.integers(0, 1 << 63, 4000, np.uint64)
    often = {int(h): 100 + i for i, h in enumerate(pool)}
    links = 0
    for _ in range(4000):
        n = int(rng.choice([1, 2, 3, 5, 8, 12, 30, 80, 300]))
        base = rng.choice(pool, n, replace=False)
        sides = []
        for _ in range(2):
            own = base[rng.random(n) >= rng.choice([0, 0.03, 0.08, 0.12])]
            more = rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 8), np.uint64)
            extra = rng.choice(pool, rng.integers(0, 1 + n // 12), replace=False)
            sides.append(np.unique(np.concatenate((own, more, extra))))
        a, b = sides
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        links += 1
        found = []
        for x in sides:
            f = np.array([often.get(int(h), 1) for h in x])
            order = np.lexsort((x, f))
            keys, room, own = N._part_keys(f[order], x[order], 80)
            found.append((set(keys.tolist()), set(keys[own].tolist()), room))
        (ka, oa, ra), (kb, ob, rb) = found
        assert ra + rb >= 0 and (oa & kb or ob & ka)
    assert links > 1000


def test_ways_beyond_the_broadcast_and_below_common(spark, monkeypatch):
    """Candidates' texts by a shuffle; regions and common shingles so small that every way is taken."""
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    monkeypatch.setattr(N, "REGION", 6)
    monkeypatch.setattr(N, "COMMON", 2)
    rows = [(len(corpus()) + i, t) for i, t in crowd(60, 120, 4)] + [(1000 + i, t) for i, t in crowd(40, 120, 2, 21)] + corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in N.near_duplicates(df, shingle=4).collect()) == brute(rows, 4)


@pytest.mark.parametrize("pairs", [1, 3])
@pytest.mark.parametrize("partitions", [1, 200])
def test_any_number_of_partitions(spark, pairs, partitions):
    held = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = []
    for p in range(pairs):
        words = [f"w{p}_{i}" for i in range(150)]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join([*words[:70], "other", *words[71:]]))]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows, 4) and len({r[2] for r in got}) == pairs


def test_very_long_text(spark):
    """A text of 200,000 words, one with a word changed in a thousand places, and one word of a million letters."""
    rng = random.Random(17)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    near = list(words)
    for i in range(0, len(near), 200):
        near[i] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "x" * 10**6)]
    got = sorted(tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect())
    assert [r[2] for r in got] == [1, 1, 3] and got == sorted((d, len(s), c, d == c) for (d, s), c in zip(sets_of(rows, 4), [1, 1, 3]))


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text, 1, "x"), (4, text, 1, "x"), (4, text, 1, "x"), (9, "other words are here", 1, "x")], SCHEMA)
    got = sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in N.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (4, -1, False), (4, -1, False), (9, 9, True)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(14)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for u in near[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        assert got.pop(v) == min(seen)
    assert not got


def test_components_take_few_rounds_and_files(spark, monkeypatch):
    """Rows of a known number aren't spread over as many files as a shuffle has partitions, and ends that are reached aren't followed once more."""
    from quillmatch.llm import components as C

    files, real = [], C.cut
    monkeypatch.setattr(C, "cut", lambda *a: files.append(real(*a)) or files[-1])
    held = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        star = spark.createDataFrame([(1, i) for i in range(2, 600)], "a long, b long")
        assert {(r.v, r.root) for r in C.components(star).collect()} == {(i, 1) for i in range(1, 600)}
        of_star = len(files)
        path = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
        assert {(r.v, r.root) for r in C.components(path).collect()} == {(1, 1), (2, 1), (3, 1)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert of_star == len(files) - of_star == 5 and all(len(f.inputFiles()) <= spark.sparkContext.defaultParallelism for f in files)


def test_cut_of_a_known_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr("quillmatch.llm.checkpoints.EACH", 100)
    tasks = spark.sparkContext.defaultParallelism
    for rows, most in ((50, tasks), (100 * tasks + 1, tasks + 1), (5_000, 50)):
        out = N.cut(spark.range(0, rows, 1, 64), rows)
        assert out.count() == rows and len(out.inputFiles()) == min(64, most)


def test_minima_estimate_similarity():
    rng = np.random.default_rng(15)
    make = N.MinHash(32)
    for j in (0.5, 0.8):
        errors = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, 400, np.uint64)
            k = int(400 * (1 - j) / 2)
            a, b = (make.signature(x).view(np.uint8) for x in (both[k:], both[: 400 - k]))
            errors.append((a == b).mean() - (400 - 2 * k) / 400)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
