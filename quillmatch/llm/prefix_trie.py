"""Operator 11: a prefix trie of conversations from vertical bitmaps.

A turn is the digest of its role and text. Conversations are dealt to shards by ranges of conv_id, SHARD ids wide, so a shard holds at most
2 * SHARD conversations whatever the table's size. A shard indexes (position, turn) to a bitset of its conversations and walks depth
first: the parent's bitset intersected with the posting of a turn that one of its members has next is a child, the bitset's population
its members, its intersection with the conversations of just that length the end list.

Shards meet by path, the chained digest of a node's turns: members add up, the smallest member is a minimum. What is summed over a subtree is
additive where each node is counted by one shard alone, the first that has it: each shard sums its own nodes' shares over ranges of its
preorder, and the shares add up by path. So no step goes level by level, whatever the depth, and a node that every conversation passes
(the root, a common first turn) costs one row a shard. The end list of a node is hashed in order of shards as a stream.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.checkpoints import cut

SHARD = 4000
#: Conversations of one block share the first turns of its first conversation in the rebuilt table.
BLOCK = 100
ROOT = bytes(16)
NODES = "shard long, ord long, size long, up long, path binary, parent binary, depth long, low long, n long, chars long, ends array<long>"


def _id(c: str) -> Column:
    return F.col(c).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text; null is empty), chars (code points of text); rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)), 1, 16)
    return conversations.select(_id("conv_id").alias("conv_id"), _id("turn").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).where("conv_id is not null")


def head(conv_id: int) -> int:
    """How many first turns a rebuilt conversation takes from the first of its block."""
    return zlib.crc32(str(conv_id).encode()) % 6


def _ordered(pdf: pd.DataFrame) -> dict[int, list[tuple[bytes, int]]]:
    """conv_id -> its turns in order: null turns first, equal turns by digest."""
    pdf = pdf.assign(null=pdf["turn"].notna(), turn=pdf["turn"].fillna(0)).sort_values(["conv_id", "null", "turn", "digest"], kind="stable")
    held: dict[int, list[tuple[bytes, int]]] = {}
    for c, d, n in zip(pdf["conv_id"].tolist(), pdf["digest"], pdf["chars"].tolist(), strict=True):
        held.setdefault(c, []).append((bytes(d), n))
    return held


def rebuilt(own: dict[int, list]) -> dict[int, list]:
    """Each conversation with the first head() turns of its block's first one in place of its own."""
    return {c: own.get(c - int(np.fmod(c, BLOCK)), [])[:h] + t[h:] for c, t in own.items() for h in (head(c),)}


def walk(conversations: dict[int, list[tuple[bytes, int]]]) -> list[list]:
    """The nodes of one shard's trie in preorder: [ord, size of the subtree, ord of the parent, path, parent's path, depth, smallest member, members, chars, end list]."""
    names = sorted(conversations)
    own = [conversations[c] for c in names]
    postings: dict[tuple[int, bytes], int] = {}
    ended: dict[int, int] = {}
    for bit, t in enumerate(own):
        mark = 1 << bit
        ended[len(t)] = ended.get(len(t), 0) | mark
        for at, (digest, _) in enumerate(t):
            postings[at, digest] = postings.get((at, digest), 0) | mark
    out: list[list] = []
    todo = [((1 << len(names)) - 1, 0, ROOT, b"", -1, 0)] if names else []
    while todo:
        members, depth, path, parent, up, chars = todo.pop()
        ends = members & ended.get(depth, 0)
        at = len(out)
        out.append([at, 1, up, path, parent, depth, names[_lowest(members)], members.bit_count(), chars, [names[b] for b in _bits(ends)]])
        rest, children = members ^ ends, []
        while rest:
            digest, n = own[_lowest(rest)][depth]
            child = members & postings[depth, digest]
            rest ^= child
            children.append((child, depth + 1, hashlib.sha256(path + digest).digest()[:16], path, at, n))
        todo += reversed(children)
    for row in reversed(out):
        if row[2] >= 0:
            out[row[2]][1] += row[1]
    return out


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _bits(bits: int) -> Iterator[int]:
    if bits:
        yield from np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()


def shard_nodes(conversations: DataFrame, rebuild: bool = False, shard: int = SHARD) -> DataFrame:
    """The nodes of each shard's trie, rows of NODES. rebuild: conversations take their block's first turns. shard: a multiple of BLOCK."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = _ordered(pdf)
        rows = walk(rebuilt(own) if rebuild else own)
        return pd.DataFrame([[int(key[0]), *r] for r in rows], columns=[x.split()[0] for x in NODES.split(", ")])

    # `div` cuts towards zero as % does: shards keep the order of ids, and a block stays in one shard
    return turns(conversations).withColumn("shard", F.expr(f"(conv_id - conv_id % {BLOCK}) div {shard}")).groupBy("shard").applyInPandas(run, NODES)


def _hash_ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (path, shard, ends) in order -> path, ends_sha256. A list goes through the hash shard by shard."""
    last, sha = None, None
    for pdf in frames:
        out = []
        for path, ends in zip(pdf["path"], pdf["ends"], strict=True):
            part = ",".join(map(str, ends.tolist())).encode()
            if path != last:
                if sha is not None:
                    out.append((last, sha.hexdigest()))
                last, sha = path, hashlib.sha256(part)
            else:
                sha.update(b"," + part)
        yield pd.DataFrame(out, columns=["path", "ends_sha256"])
    if sha is not None:
        yield pd.DataFrame([(last, sha.hexdigest())], columns=["path", "ends_sha256"])


def prefix_trie(conversations: DataFrame, rebuild: bool = False, shard: int = SHARD) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> a row for each distinct sequence of first turns: path (binary), conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn, null first; equal turns by digest of (role, text). Null role or text: empty. Rows without a conv_id are left out.
    A repeated row is one more turn. The root (depth 0) has all conversations and parent null. Empty table: no rows. Long texts are only ever
    their digest; a conversation is walked in one task, in memory (about 200 bytes a turn). Other columns are ignored.

    rebuild: first turns are those of the first conversation of the block of 100 ids, as many as head() says (all if fewer, none if absent).
    """
    parts = cut(shard_nodes(conversations, rebuild, shard))
    nodes = parts.groupBy("path").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("low").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("shard").alias("owner")
    )
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    whole = cut(nodes.join(children, "path", "left").na.fill(0, ["n_children"]))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        first, last = pdf["ord"].to_numpy(), (pdf["ord"] + pdf["size"]).to_numpy()
        mine = (pdf["owner"] == pdf["shard"]).to_numpy()

        def below(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(x)))
            return sums[last] - sums[first]

        leaves = below((mine & (pdf["n_children"] == 0)).astype(np.int64))
        saved = below((pdf["n"] - mine).to_numpy() * pdf["chars"].to_numpy())
        up = pdf["up"].to_numpy()
        parents = pd.Series(pdf["conv_id"].to_numpy()[np.maximum(up, 0)], dtype="Int64").mask(up < 0)
        return pd.DataFrame({"path": pdf["path"], "parent_conv_id": parents, "leaves": leaves, "saved": saved})

    there = parts.select("shard", "ord", "size", "up", "path", "n", "chars").join(whole.select("path", "conv_id", "n_children", "owner"), "path")
    shares = there.groupBy("shard").applyInPandas(share, "path binary, parent_conv_id long, leaves long, saved long")
    sums = shares.groupBy("path").agg(F.min("parent_conv_id").alias("parent_conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    lists = parts.where(F.size("ends") > 0).select("path", "shard", "ends").repartition("path").sortWithinPartitions("path", "shard")
    hashed = lists.mapInPandas(_hash_ends, "path binary, ends_sha256 string")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return whole.join(sums, "path").join(hashed, "path", "left").select("path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True).drop("path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_prefix_trie": op11_prefix_trie}

#: crc32 of a number's digits; a macro can't be made in one statement, so it is written out.
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS UBIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda r: CAST(0 AS UBIGINT))),
    lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, CAST(3988292384 AS UBIGINT)) ELSE y >> 1 END)), CAST(4294967295 AS UBIGINT))"""

ORACLE_SQL = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS i FROM t),
h AS (SELECT c, CAST({CRC.format(x="c")} % 6 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT h.c, i, k, n FROM h JOIN o ON o.c = h.c - h.c % 100 WHERE i <= h UNION ALL SELECT h.c, i, k, n FROM h JOIN o ON o.c = h.c WHERE i > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, k, n FROM r),
l AS (SELECT h.c, count(k) AS len FROM h LEFT JOIN s ON s.c = h.c GROUP BY h.c),
p AS (SELECT c, d, n, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS w FROM s UNION ALL SELECT c, 0, 0, '' FROM h),
a AS (SELECT w, d, min(n) AS n, min(c) AS low, count(*) AS m FROM p GROUP BY w, d),
e AS (SELECT p.w, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM p JOIN l USING (c) WHERE d = len GROUP BY p.w),
g AS (SELECT substr(w, 1, 64 * (d - 1)) AS w, count(*) AS k FROM a WHERE d > 0 GROUP BY 1),
b AS (SELECT a.*, coalesce(k, 0) AS k FROM a LEFT JOIN g USING (w)),
u AS (SELECT w, d, n, m, k, unnest(range(d + 1)) AS j FROM b),
z AS (SELECT substr(w, 1, 64 * j) AS w, count(*) FILTER (k = 0) AS leaves, sum((m - 1) * n) AS saved FROM u GROUP BY 1)
SELECT b.low AS conv_id, CAST(b.d AS BIGINT) AS depth, q.low AS parent_conv_id, CAST(b.m AS BIGINT) AS n_convs, CAST(b.k AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM b JOIN z USING (w) LEFT JOIN e USING (w) LEFT JOIN a q ON b.d > 0 AND q.w = substr(b.w, 1, 64 * (b.d - 1))
"""
}
