"""Operator 5: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A text is split by the vocabulary's pattern. The distinct words not met before form a trie, laid out as the words in order of their bytes with
the lengths of the prefixes that neighbours share; reading them in order is its depth-first walk. The walk gives every node the last
token of its prefix's encoding. A token t may end a prefix p + t if (last token of p, t) is a pair that the merges leave as it is; exactly one
token does, as any valid encoding is a sequence of such pairs. The tokens that end at a node are read, longest first, off an automaton of the
vocabulary that steps along. So the states of a prefix that many words share are computed once, and a word's encoding is read off its node by
stepping back from last token to last token.

Words known to a task stay in a memory bounded by bytes that is cleared when full; nothing grows with the corpus or outlives the
task, and nothing is shuffled. One Python worker encodes and decodes.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.workers import give_back, sparing

SPACE, REST = r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}]"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?{REST}+|{SPACE}+(?!\P{{White_Space}})|{SPACE}+"
#: The same for texts of ASCII alone, in the faster re.
BLANK = r"\t-\r "
ASCII = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{BLANK}A-Za-z0-9]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: Bytes of known words that a task remembers (WORD_COST is what one takes beside its letters and ids), and pairs of tokens.
WORD_BYTES, WORD_COST, PAIRS = 64 << 20, 200, 1 << 17
#: Letters of text, and words of a long text, that are encoded at a time.
LETTERS, WORDS = 1 << 18, 1 << 17


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary in a tokenizers JSON file, held flat."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = str.maketrans({letter: chr(b) for letter, b in byte_letters().items()})
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        ids = {k.translate(table).encode("latin-1"): v for k, v in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(itertools.chain(ids.values(), self.specials.values()))
        self.pieces = [b""] * self.size
        for k, v in itertools.chain(ids.items(), ((k.encode(), v) for k, v in self.specials.items())):
            self.pieces[v] = k
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        #: merges: rank of a pair a * size + b; rank and parts of the token that a merge makes (bytes: -1)
        self.merges: dict[int, int] = {}
        self.rank, self.left, self.right = (array("i", [-1]) * self.size for _ in range(3))
        for rank, (a, b) in enumerate(pairs):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[x * self.size + y] = self.rank[made] = rank
            self.left[made], self.right[made] = x, y
        self.length = array("i", map(len, self.pieces))
        self._automaton(ids)
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.pairs: dict[int, bool] = {}
        compiled = regex.compile(PATTERN)
        self.each, found, ascii_found = compiled.finditer, compiled.findall, re.compile(ASCII).findall
        self.find = lambda t: ascii_found(t) if t.isascii() else found(t)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else lambda t: [t]

    def _automaton(self, ids: dict[bytes, int]) -> None:
        """arcs of a trie of the vocabulary, node + byte (the node of token t is t << 8, other nodes and the root come behind), and by node >> 8:
        fail, the node of its longest other suffix, and ends, the longest token that is a suffix (none: -1); shorter, by token: the next one."""
        root = self.root = self.size << 8
        arcs: dict[int, int] = {}
        new, levels = root + 256, [[] for _ in range(max(map(len, ids)))]
        for token in sorted(ids, key=len):  # a prefix that is a token is named first
            node = root
            for depth, b in enumerate(token[:-1]):
                to = arcs.get(node + b)
                if to is None:
                    arcs[node + b] = to = new
                    levels[depth].append(node + b)
                    new += 256
                node = to
            arcs[node + token[-1]] = ids[token] << 8
            levels[len(token) - 1].append(node + token[-1])
        fail, ends = array("i", [root]) * (new >> 8), array("i", [-1]) * (new >> 8)
        for at in itertools.chain.from_iterable(levels):
            node, above, byte, to = arcs[at], at & -256, at & 255, root
            while to == root and above != root:
                above = fail[above >> 8]
                to = arcs.get(above + byte, root)
            fail[node >> 8], ends[node >> 8] = to, node >> 8 if node < root else ends[to >> 8]
        self.arcs, self.fail, self.ends = arcs, fail, ends
        self.shorter = array("i", [ends[to >> 8] for to in fail[: self.size]])

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are what the merges make of their bytes.

        Merges are undone at the border, the later one first (at equal rank the right one, as the left merge comes first): before it,
        the parts then at the border must not have had an earlier merge of their own.
        """
        size = self.size
        known = self.pairs.get(a * size + b)
        if known is not None:
            return known
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        merges, rank = self.merges, self.rank
        left, right, limit, ok = a, b, 1 << 60, True
        while True:
            if merges.get(left * size + right, limit) < limit:
                ok = False
                break
            x, y = rank[left], rank[right]
            if x < 0 and y < 0:
                break
            if x > y:
                left, limit = self.right[left], x
            else:
                right, limit = self.left[right], y + 1
        self.pairs[a * size + b] = ok
        return ok

    def learn(self, words: set[str]) -> None:
        """Encode words: one trie, one walk."""
        order = sorted([(w.encode("utf-8", "surrogatepass"), w) for w in words])
        compatible, known, arc, fail, ends, shorter, length, size, root = self.compatible, self.pairs.get, self.arcs.get, self.fail, self.ends, self.shorter, self.length, self.size, self.root
        last: list[int] = []  # the last token of the prefix of each length on the path, from 1 on
        nodes = [root]  # the automaton's node at each length of the prefix
        shared = 0
        for i, (path, word) in enumerate(order):
            beyond = _common(path, order[i + 1][0]) if i + 1 < len(order) else 0
            del last[shared:], nodes[shared + 1 :]
            node = nodes[shared]
            for depth, byte in enumerate(path[shared:], shared):
                to = arc(node + byte)
                while to is None:
                    if node == root:
                        to = root
                    else:
                        node = fail[node >> 8]
                        to = arc(node + byte)
                node = to
                token = ends[node >> 8]
                while token >= 0 and (begin := depth - length[token]) >= 0:
                    before = last[begin]
                    ok = known(before * size + token)
                    if compatible(before, token) if ok is None else ok:
                        break
                    token = shorter[token]
                last.append(token)
                nodes.append(node)
            out, at = [], len(path)
            while at:
                out.append(last[at - 1])
                at -= length[last[at - 1]]
            out.reverse()
            self.words[word] = struct.pack(f"<{len(out)}I", *out)
            self.held += WORD_COST + len(path) + 4 * len(out)
            shared = beyond

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, packed as little-endian unsigned 32-bit integers."""
        return [b"".join(self._chunks(t)) for t in texts] if any(len(t) > LETTERS for t in texts) else self._together(texts)

    def _together(self, texts: list[str]) -> list[bytes]:
        parts = [[self.find(p) if i % 2 == 0 else p for i, p in enumerate(self.split(t))] for t in texts]
        self._know(set().union(*(p for text in parts for p in text[::2])))
        look = self.words.__getitem__
        return [b"".join(b"".join(map(look, p)) if i % 2 == 0 else struct.pack("<I", self.specials[p]) for i, p in enumerate(text)) for text in parts]

    def _chunks(self, text: str) -> Iterator[bytes]:
        """The ids of a long text, some words at a time."""
        for i, p in enumerate(self.split(text)):
            if i % 2:
                yield struct.pack("<I", self.specials[p])
                continue
            every = (m[0] for m in self.each(p))
            while some := list(itertools.islice(every, WORDS)):
                self._know(set(some))
                yield b"".join(map(self.words.__getitem__, some))

    def _know(self, words: set[str]) -> None:
        new = set(itertools.filterfalse(self.words.__contains__, words))  # a difference from the keys would go through all of them
        if new and self.held > WORD_BYTES:
            self.words.clear()
            self.held, new = 0, words
        if new:
            self.learn(new)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


def _common(a: bytes, b: bytes) -> int:
    """Leading bytes that a and b share."""
    for n, (x, y) in enumerate(zip(a[:16], b)):
        if x != y:
            return n
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def batches(frames: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in smaller batches: of about `most` bytes of a text column, one row at least."""
    for frame in frames:
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(frame[column]), 0).cast("int64")).to_pylist()
        lo = before = 0
        for i, end in enumerate(ends):
            if end - before >= most or i + 1 == len(ends):
                yield frame.slice(lo, i + 1 - lo)
                lo, before = i + 1, end


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit ids), decoded (text, read back from ids).

    path: a byte-level BPE vocabulary, readable on every executor. Null and empty text: no tokens, decoded is empty. The strings of special
    tokens in a text give their ids. Repeated rows: a row each. Null doc_id: kept. A long text is encoded some words at a time. Empty table:
    no rows. Other columns are ignored. Bytes that aren't UTF-8 decode to U+FFFD.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        give_back()  # what the file took while it was read
        for part in batches(frames, "text", LETTERS):
            ids = v.encode(part["text"].to_pylist())
            columns = [part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(list(map(v.decode, ids)), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(sparing(run), "doc_id long, n_tokens long, ids binary, decoded string")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Adds decoded (string) to tokens(ids binary, ...), in place of a column of that name. Null ids: null. Bytes that aren't UTF-8: U+FFFD."""

    @F.pandas_udf("string")
    @sparing
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(path)
        for ids in batches:
            yield pd.Series([None if x is None else v.decode(x) for x in ids], dtype=object)

    return tokens.withColumn("decoded", run("ids"))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    out = encode(docs, path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_bpe": op5_bpe}
