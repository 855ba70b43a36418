import hashlib
import random
import zlib

import pytest

from quillmatch.llm import prefix_trie as P


def brute(rows, rebuild):
    """Every node from the definition: sets of conversations for each distinct beginning."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r))):
        own.setdefault(c, []).append((role or "", text or ""))
    if rebuild:
        heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])[: heads[c]] + t[heads[c] :] for c, t in own.items()}
    members = {}
    for c, t in own.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = {}
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(cs) if len(own[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(cs), len(node), hashlib.sha256(ends.encode()).hexdigest()] = (parent, len(cs), len(children), len(leaves), saved)
    return out


def digest(r):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return hashlib.sha256((sha(r[2] or "") + sha(r[3] or "")).encode()).digest()[:16]


def random_rows(seed, ids, most=6):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "a b c"])) for t in range(rng.randrange(1, most))]
    return rows


@pytest.mark.parametrize("rebuild", [False, True])
@pytest.mark.parametrize("shard", [100, 4000])
def test_against_brute_force(spark, rebuild, shard):
    rows = random_rows(3, [*range(0, 40), *range(-130, -90), *range(95, 140), *range(390, 430), 10**12, 10**12 + 5])
    rows += [(7, None, "user", "first"), (7, None, "user", "again"), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (None, 0, "user", "nobody's")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, n long")
    got = P.prefix_trie(df, rebuild, shard).collect()
    found = {(r.conv_id, r.depth, r.ends_sha256): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got}
    assert len(got) == len({bytes(r.path) for r in got}) and found == brute(rows, rebuild)


def test_deep_and_common_conversations(spark):
    """A conversation of thousands of turns, and one that most conversations copy, over many shards."""
    rows = [(5, t, "user", f"turn {t}") for t in range(3000)] + [(c, t, "user", f"turn {t}") for c in range(100, 2100) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.depth: r for r in P.prefix_trie(df, shard=100).collect()}
    assert sorted(got) == list(range(3001)) and {got[d].n_leaves for d in got} == {1}
    assert (got[3].n_convs, got[4].n_convs, got[3].parent_conv_id) == (2001, 1, 5)
    assert got[3].ends_sha256 == hashlib.sha256(",".join(map(str, range(100, 2100))).encode()).hexdigest()
    assert got[0].saved_tokens == 2000 * 3 * len("turn 0") and got[4].saved_tokens == 0


def test_empty_table_and_turnless_conversations(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.prefix_trie(df).count() == 0
    lone = next(c for c in range(101, 200) if P.head(c) >= 2)  # its block's first conversation is absent: no turn is left
    spark.createDataFrame([(lone, 0, "user", "x"), (lone, 1, "user", "y")], df.schema).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = P.op11_prefix_trie(spark, str(tmp_path)).collect()
    assert (row.conv_id, row.depth, row.n_convs, row.n_leaves, row.parent_conv_id) == (lone, 0, 1, 1, None)
    assert row.ends_sha256 == hashlib.sha256(str(lone).encode()).hexdigest()
