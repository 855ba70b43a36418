"""Operator 8: benchmark decontamination by a generalised suffix automaton.

The normalised test items become one automaton over words. A training text is streamed through it, which gives the longest
run of words ending at each place that some item contains; where it reaches a window's length (13 words, or a whole shorter item)
the window's words are hit. Documents are never shuffled by a benchmark of one block. The automaton goes to every task, so it is bounded:
benchmarks of more than `block_words` words are dealt out to several automata. The texts are then read once for each, only hits are
written, by a digest of the text, and documents meet what all automata found at the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm import hashing as H
from quillmatch.llm.checkpoints import cut
from quillmatch.llm.workers import sparing

#: Everything in ASCII but digits and letters (upper case is lowered first).
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_SPLIT = bytes(0x20 if b in SEPARATORS else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPLIT).split()  # bytes.lower() changes A-Z alone


class Automaton:
    """Suffix automaton of several word sequences; no match runs from one into another."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        ids = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]) for name, text in items]
        ids = [(name, seq) for name, seq in ids if seq]
        for _, seq in ids:
            state = 0
            for c in seq:
                state = self._extend(state, c)
        self.shortest = min((min(window, len(seq)) for _, seq in ids), default=window)
        # which items hold the window that ends a match: at the state of the window's own length
        n = len(self.next)
        self.items: list[set[str]] = [set() for _ in range(n)]
        self.whole: list[tuple[tuple[int, str | None], ...]] = [()] * n  # shorter items ended here: (words, name)
        self.at = [0] * n  # the state on the suffix path whose strings have `window` words, or 0
        for name, seq in ids:
            state = 0
            for c in seq:
                state = up = self.next[state][c]
                while up > 0 and (name is not None and name not in self.items[up]):
                    self.items[up].add(name)
                    up = self.link[up]
            if len(seq) < window:
                while self.length[self.link[state]] >= len(seq):
                    state = self.link[state]
                self.whole[state] += ((len(seq), name),)
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.whole[s] += self.whole[up] if up > 0 else ()
            if self.length[s] >= window:
                self.at[s] = s if self.length[up] < window else self.at[up]

    def _new(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest string at p followed by c, on its own if it wasn't."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, c)
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words (end exclusive), and the names of the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if len(words) < self.shortest or not self.vocabulary:
            return spans, found
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        # a word that no item has takes the automaton back to its start: runs between such words are streamed
        gaps = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(ids)]))
        long = np.flatnonzero(np.diff(gaps) > self.shortest)
        follow, link, length, window = self.next, self.link, self.length, self.window
        for g in long.tolist():
            begin = int(gaps[g]) + 1
            state = matched = 0
            for i, c in enumerate(ids[begin : int(gaps[g + 1])].tolist(), begin):
                to = follow[state].get(c)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = follow[state].get(c)
                state, matched = (to, matched + 1) if to is not None else (0, 0)
                if matched >= self.shortest:
                    most = 0
                    if matched >= window:
                        most = window
                        found |= self.items[self.at[state]]
                    for n, name in self.whole[state]:
                        if n <= matched:
                            most = max(most, n)
                            if name is not None:
                                found.add(name)
                    if most:
                        lo = i - most + 1
                        while spans and spans[-1][1] >= lo:
                            lo = min(lo, spans.pop()[0])
                        spans.append((lo, i + 1))
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 100_000) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> doc_id, n_words, n_hit, items array<string> (sorted),
    spans array<struct<start, end>> of hit words, contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts: no words; items without words have no windows; an item of null id counts towards hits and is not
    named. Repeated rows of docs: a row each; rows of one item_id count as one item. Null doc_id: kept. Other columns are ignored.
    """
    items, blocks = _items(benchmark, block_words)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    if blocks == 1:
        out = _stream(rows, _automaton(items.collect(), rows.sparkSession, window))
    else:
        words = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
        out = rows.select("doc_id", words.alias("n_words"), _digest("text").alias("key")).join(_in_blocks(rows.select("text"), items, blocks, window), "key", "left")
        out = out.withColumns({"spans": F.coalesce("spans", F.array().cast(SPANS)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


SPANS = "array<struct<start:long,end:long>>"


def _automaton(items: list, spark: SparkSession, window: int):
    return spark.sparkContext.broadcast(Automaton([(r.item_id, r.text.encode()) for r in items], window))


def _digest(text: str):
    """Names a text: 256 bits and its length."""
    return F.concat_ws(":", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), F.octet_length(F.coalesce(text, F.lit(""))))


def _in_blocks(texts: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """texts(text) -> key (digest), spans, items: of the texts with hits, what all automata of `blocks` find."""
    found = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about block_words words
        hits = _stream(texts.select(F.lit(None).cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")), _automaton(mine, texts.sparkSession, window), True)
        hits = cut(hits.select(F.col("doc_id").alias("key"), F.struct(F.lit(b).alias("block"), "spans", "items").alias("part")).distinct())
        found = hits if found is None else found.union(hits)

    @F.pandas_udf(SPANS)
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in merged([(int(s["start"]), int(s["end"])) for s in p])] for p in parts])

    parts = found.groupBy("key").agg(F.collect_list("part").alias("parts"))
    return parts.select("key", joined(F.flatten("parts.spans")).alias("spans"), F.array_distinct(F.flatten("parts.items")).alias("items"))


def _items(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """item_id, text; the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # at least as many as the words: every word is followed by a separator, or ends the text
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) + 1)).first()[0] or 0
    return items, max(1, math.ceil(total / block_words))


def _stream(rows: DataFrame, automaton, hits_only: bool = False) -> DataFrame:
    """rows(doc_id, text) -> doc_id, n_words, spans, items. hits_only: rows with spans, under the digest of the text in place of doc_id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: Automaton = automaton.value
        for pdf in frames:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = words_of(text)
                spans, names = a.hits(words)
                if spans or not hits_only:
                    name = f"{hashlib.sha256(text).hexdigest()}:{len(text)}" if hits_only else doc_id
                    out.append((name, len(words), [{"start": s, "end": e} for s, e in merged(spans)], sorted(names)))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "spans", "items"])

    return rows.mapInPandas(sparing(run), f"doc_id string, n_words long, spans {SPANS}, items array<string>")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, span_words: int | None = None, block_words: int = 100_000) -> DataFrame:
    """The rows of docs that stay, all columns: contaminated ones go.

    span_words: in a document that stays, also cut the hit runs of at least so many words from text (None: leave texts as they are);
    n_chars, if there, follows. Every row is judged by itself, so rows without a doc_id and repeated rows are no case of their own. A benchmark
    of one block is met on the way, without a shuffle; one of several blocks takes find_contamination's way, by a digest of the text.
    """
    items, blocks = _items(benchmark, block_words)
    temporary, key = _free(docs, "judged"), _free(docs, "key")
    if blocks == 1:
        automaton = _automaton(items.collect(), docs.sparkSession, window)

        @F.pandas_udf("struct<out:boolean,text:string>")
        @sparing
        def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for text in batches:
                out = [_judged(t, automaton.value.hits(words_of((t or "").encode()))[0], span_words) for t in text]
                yield pd.DataFrame({"out": [o for o, _ in out], "text": pd.Series([t for _, t in out], dtype=object)})

        kept = docs.withColumn(temporary, judged("text"))
    else:

        @F.pandas_udf("struct<out:boolean,text:string>")
        def judged(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
            out = [_judged(t, [] if s is None else [(int(x["start"]), int(x["end"])) for x in s], span_words) for t, s in zip(text, spans, strict=True)]
            return pd.DataFrame({"out": [o for o, _ in out], "text": pd.Series([t for _, t in out], dtype=object)})

        found = _in_blocks(docs.select("text").where("text is not null"), items, blocks, window).select(F.col("key").alias(key), F.col("spans").alias(temporary))
        kept = docs.withColumn(key, _digest("text")).join(found, key, "left").withColumn(temporary, judged("text", temporary))
    kept = kept.where(~F.col(temporary)["out"])
    if span_words is not None:
        kept = kept.withColumn("text", F.col(temporary)["text"])
        if "n_chars" in docs.columns:
            kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """name, made longer until docs has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _judged(text: str | None, spans: list[tuple[int, int]], span_words: int | None) -> tuple[bool, str | None]:
    """Whether the document goes, and its text if it stays."""
    hit = sum(b - a for a, b in spans)
    if hit and 20 * hit >= len(words_of((text or "").encode())):
        return True, None
    return False, _shortened(text, spans, span_words) if spans else text


def _shortened(text: str, spans: list[tuple[int, int]], span_words: int | None) -> str:
    return text if span_words is None else cut_words(text, [(a, b) for a, b in spans if b - a >= span_words])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the stretches from the first to the last word of each span."""
    raw = text.encode()
    w = H.Words([raw], SEPARATORS, lower=True)
    for a, b in reversed(spans):
        raw = raw[: w.starts[a]] + raw[w.ends[b - 1] :]
    return raw.decode()


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_decontamination": op8_decontamination}

#: Windows as lists of words; hits by position.
ORACLE_SQL = {
    "op8_decontamination": r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dwin AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT r, i, d.n, item_id FROM dwin d JOIN iw ON d.n = iw.n AND d.win = iw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
}
