"""Operator 3: MinHash near-dedup over an LSH forest.

A document's set is its distinct `shingle`-word runs. Equal sets become one class with its least document; of each class, `trees`
signatures of DEPTH one-byte minima are made. Each signature order is sorted once: in every tree the classes lie in order of their signature, so
those that share the longest prefixes are neighbours.

A region is the classes of one order that share its first MIN_DEPTH minima. Round 1 takes the neighbours within regions; of these
candidates every class checks its two best (by the share of equal minima) on full sets, and the links form components. Round 2 checks the
candidates left between different components. Larger (dense) regions then take a round of stars: their classes are indexed by their rarest
shingles (prefix filter), and every class meets the one class of each of its shingles that has the fewest rare ones, the likeliest centre
of a group of near copies. These three only spare work: they make the last round, which is complete, small. It takes what can still
join two components: of a region of up to REGION classes all pairs of different components; the classes of dense regions with more than
one component meet by the shingles that few of them hold, or else by parts of the shingles that many hold (`_parted` says why no pair of the
similarity is left out), at any size of the region. All are checked on full sets, if the share of equal minima isn't five deviations below the limit (a pair at the limit fails that by chance
with probability 3e-7).

At similarity 0.8 an order shares MIN_DEPTH minima with probability 0.41, so 32 orders miss a pair with probability 5e-8. Dense regions
lose nothing more, and no result depends on how rows are dealt to tasks.

Nothing is collected but counts. Orders are split by range, so a group of copies of any size is spread evenly; a class of equal
sets takes part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.llm import hashing as H
from quillmatch.llm.checkpoints import cut
from quillmatch.llm.components import components
from quillmatch.llm.parts import NULL_ID, outward, pack, unpack
from quillmatch.llm.workers import sparing

DEPTH, MIN_DEPTH = 8, 4
REGION = 48
#: Classes of dense regions that hold a shingle, up to which all of them meet by it; a shingle of more is common.
COMMON = 48
SET_BITS = 48
#: Candidates up to which their ids (8 bytes each) are broadcast to pick their texts; beyond, texts are shuffled to meet them.
BROADCAST_IDS = 1 << 21


def shingles(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of width words (of all its words, if they are fewer)."""
    for _, some in H.chunks((t.encode() for t in texts), 1 << 18):
        words = H.Words(some, lower=True)
        values = words.hashes()
        sums = H.prefix_sums(values, H.WORD_BASE)
        every = H.fixed_hashes(sums, width, H.WORD_BASE)
        for i, n in enumerate(words.counts.tolist()):
            lo = int(words.first[i])
            if n >= width:
                yield np.unique(every[lo : lo + n - width + 1])
            elif n:
                yield H.span_hashes(sums, np.array([lo]), np.array([lo + n]), H.WORD_BASE)
            else:
                yield np.empty(0, H.U)


class MinHash:
    """trees * DEPTH minima of one byte each, packed as `trees` numbers whose high bytes come first."""

    def __init__(self, trees: int) -> None:
        rng = np.random.default_rng(20240229)
        n = trees * DEPTH
        self.trees = trees
        self.seeds = rng.integers(0, 1 << 32, n, np.uint32)[:, None]
        self.odd = rng.integers(0, 1 << 32, n, np.uint32)[:, None] | np.uint32(1)
        self.odd2 = rng.integers(0, 1 << 32, n, np.uint32)[:, None] | np.uint32(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> H.U(32)).astype(np.uint32)
        least = np.full(len(self.seeds), 0xFFFFFFFF, np.uint32)
        rows = max(1, (1 << 17) // len(x))
        for lo in range(0, len(least), rows):
            y = (x ^ self.seeds[lo : lo + rows]) * self.odd[lo : lo + rows]
            y ^= y >> np.uint32(15)
            y *= self.odd2[lo : lo + rows]
            least[lo : lo + rows] = y.min(axis=1)
        label = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        return label.reshape(self.trees, DEPTH).view(">i8").ravel().astype(np.int64)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = 32) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id (least doc_id reachable, itself included), kept (doc_id = component_id).

    Documents are linked if 100 * intersection >= percent * union of their sets. Null text, or no words: empty set, linked with nothing.
    Rows of null doc_id: judged as the others, under a component_id that is null where such a row is the least. Repeated rows: equal
    sets, so linked; both are kept where they are the least. Empty table: no rows. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    signed = cut(_signed(rows, shingle, trees))
    classes = signed.where("n > 0").groupBy("s").agg(F.min_by(F.struct("k", "n", "sig"), "k").alias("c")).select("s", "c.*")
    classes = cut(classes)  # k: the least document of each distinct set

    orders = classes.count() * trees
    members = cut(_regions(classes.select("k", F.posexplode("sig").alias("tree", "label"))), orders)
    neighbours = cut(_in_order(members).mapInPandas(sparing(_neighbours), "a long, b long").distinct(), orders)
    pairs = cut(_estimated(neighbours, classes, percent))

    sets = cut(_sets(rows, pairs, shingle))
    first = cut(_best(pairs), pairs.count())
    links = cut(_confirmed(first, sets, classes, percent))
    joined = components(links)

    second = cut(_between(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), joined))
    links = cut(links.union(_confirmed(second, sets, classes, percent)))
    joined = components(links)

    def checked(pairs: DataFrame) -> DataFrame:
        # neighbours were estimated before: those of different components that may be links have been confirmed or not in round 2
        likely = cut(_estimated(pairs.join(neighbours, ["a", "b"], "left_anti"), classes, percent))
        return cut(_confirmed(likely, cut(_sets(rows, likely, shingle)), classes, percent))

    ranked = cut(_ranked(rows, cut(_rooted(members, joined), orders), shingle, percent))
    rare = cut(_rare(ranked, percent))
    links = links.union(checked(_stars(cut(_rooted(rare, joined)), percent)))
    joined = components(links)

    dense = _sharing(_rooted(rare.where(F.col("f") <= COMMON), joined), percent).union(_agreeing(_rooted(_parted(ranked, percent), joined), percent))
    across = _across(cut(_rooted(members, joined), orders)).union(dense).distinct()
    roots = components(links.union(checked(across))).withColumnRenamed("v", "k")

    named = classes.select("s", "k").join(roots, "k", "left").select("s", F.coalesce("root", "k").alias("root"))
    out = signed.select("k", "n", "s").join(named, "s", "left").select("k", "n", F.coalesce("root", "k").alias("root"))
    return out.select(outward(), F.col("n").alias("n_shingles"), outward("root").alias("component_id"), (F.col("k") == F.col("root")).alias("kept"))


def _signed(rows: DataFrame, shingle: int, trees: int) -> DataFrame:
    """k, n (size of the set), s (digest of the set), sig."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = MinHash(trees)
        for pdf in frames:
            out = []
            for k, own in zip(pdf["k"], shingles(pdf["t"].tolist(), shingle), strict=True):
                out.append((k, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), make.signature(own).tolist() if len(own) else []))
            yield pd.DataFrame(out, columns=["k", "n", "s", "sig"])

    return rows.mapInPandas(sparing(run), "k long, n long, s binary, sig array<long>")


def _regions(orders: DataFrame) -> DataFrame:
    """tree, label, k, p (the MIN_DEPTH minima), dense (more than REGION classes) of the regions with two classes or more."""
    orders = orders.withColumn("p", F.shiftright("label", 8 * (DEPTH - MIN_DEPTH)))
    sizes = orders.groupBy("tree", "p").count().where("count > 1").select("tree", "p", (F.col("count") > REGION).alias("dense"))
    return orders.join(sizes, ["tree", "p"])


def _in_order(orders: DataFrame) -> DataFrame:
    """In tasks of Spark's choice: a pair across the edge of two is left to round 3."""
    return orders.repartitionByRange("tree", "label", "k").sortWithinPartitions("tree", "label", "k")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that two labels share."""
    x = (a ^ b).view(np.uint64)
    out = np.zeros(len(x), np.int64)
    for i in range(1, DEPTH + 1):
        out += x >> np.uint64(64 - 8 * i) == 0 if i < DEPTH else x == 0
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pd.DataFrame(both, columns=["a", "b"])


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of classes next to each other in one order with MIN_DEPTH minima in common."""
    last = None
    for pdf in frames:
        if last is not None:
            pdf = pd.concat([last, pdf], ignore_index=True)
        last = pdf.tail(1)
        tree, label, k = (pdf[c].to_numpy() for c in ("tree", "label", "k"))
        near = np.flatnonzero((tree[1:] == tree[:-1]) & (_common(label[1:], label[:-1]) >= MIN_DEPTH))
        yield _pairs(k[near], k[near + 1])


def _across(rooted: DataFrame) -> DataFrame:
    """Pairs of different components within one region that isn't dense."""
    held = rooted.where("not dense").groupBy("tree", "p").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.collect_list(F.struct("k", "root")).alias("c"))
    one = held.where("lo < hi").select("c", F.explode("c").alias("x"))
    two = one.select("x", F.explode(F.filter("c", lambda y: (y["k"] > F.col("x.k")) & (y["root"] != F.col("x.root")))).alias("y"))
    return two.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()


def _rooted(of: DataFrame, joined: DataFrame) -> DataFrame:
    """of(k, ...) with root, the component of each class (itself where it has no links)."""
    return of.join(joined.withColumnRenamed("v", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))


def _ranked(rows: DataFrame, rooted: DataFrame, shingle: int, percent: int = 80) -> DataFrame:
    """k, n, hs: the sets of the classes of dense regions that hold more than one component, as (f, h) in order.

    Shingles are ordered by f, the number of these classes that hold them, then by hash; common ones all have COMMON + 1 for f. Only shingles that
    aren't common are joined with their number: a class's common ones are what is left of its set. Classes that can't have a link are left out (`_shared`).
    """
    dense = rooted.where("dense")
    mixed = dense.groupBy("tree", "p").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("tree", "p")
    ids = cut(dense.join(mixed, ["tree", "p"], "left_semi").select("k").distinct())
    wanted = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "k")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [own.astype(np.int64) for own in shingles(pdf["t"].tolist(), shingle)]
            yield pd.DataFrame({"k": pdf["k"], "n": [len(h) for h in found], "hs": found})

    held = cut(wanted.mapInPandas(sparing(run), "k long, n long, hs array<long>").dropDuplicates(["k", "n", "hs"]).withColumn("s", F.xxhash64("hs")))
    held = cut(_shared(held, percent))
    every = held.select("k", "n", "s", F.explode("hs").alias("h"))
    few = every.groupBy("h").agg(F.count("*").alias("f")).where(F.col("f") <= COMMON)
    rare = every.join(few, "h").groupBy("k", "n", "s").agg(F.collect_list(F.struct("f", "h")).alias("rare"))
    both = held.join(rare, ["k", "n", "s"], "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<struct<f:bigint,h:bigint>>")))
    common = F.transform(F.array_except("hs", F.transform("rare", lambda w: w["h"])), lambda h: F.struct(F.lit(COMMON + 1).cast("long").alias("f"), h.alias("h")))
    return both.select("k", "n", F.sort_array(F.concat("rare", common)).alias("hs"))


def _shared(held: DataFrame, percent: int) -> DataFrame:
    """The rows of held(k, n, s, hs) that may have a link among them: a link has percent % of either set in common, so a set with more shingles of its own than the rest has none."""
    every = held.select(F.struct("k", "n", "s").alias("c"), F.explode("hs").alias("h"))
    alone = every.groupBy("h").agg(F.count("*").alias("f"), F.min("c").alias("c")).where("f = 1").groupBy("c").agg(F.count("*").alias("own"))
    own = held.join(alone.select("c.*", "own"), ["k", "n", "s"], "left")
    return own.where(F.coalesce("own", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select(*held.columns)


def _rare(ranked: DataFrame, percent: int) -> DataFrame:
    """k, n, left, f, h: the index of a prefix filter.

    A link has percent % of either set in common, so its first common shingle is among the first n - ceil(percent * n / 100) + 1 of both;
    left counts h and what follows it in the set.
    """
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    first = ranked.select("k", "n", F.posexplode(F.slice("hs", 1, length)).alias("at", "w"))
    return first.where("w.f > 1").select("k", "n", (F.col("n") - F.col("at")).alias("left"), "w.f", "w.h")


PARITIES = ("x0", "x1", "x2", "x3")


def _parted(ranked: DataFrame, percent: int) -> DataFrame:
    """k, n, room, own, h, x0 to x3: keys of which two classes share one of, if they are a link and no shingle in common is held by COMMON classes or fewer.

    A link's sets differ in at most (100 - percent) / (100 + percent) * (na + nb) shingles. If only common shingles are shared, all others
    differ, which leaves the common ones room for (room_a + room_b) / (100 + percent) differences, where room = (100 - percent) * n -
    (100 + percent) * others: at most twice the larger room's, fewer than a power of two, 2^j. Of 2^j parts of the common shingles, by hash, one
    then has no difference: its contents are the key. own marks the keys of a class for its own j; it also has keys for each larger j that a partner
    of its size and enough room can have, so pairs of which neither has that much room don't meet there. Few shingles can leave a part empty, which
    many classes share: such keys go with a common shingle of the prefix (the first one that a link shares), up to 16 parts; with more parts, a link whose
    every part without a difference is empty has a probability below 1e-9, and empty parts make no keys.

    x0 to x3 are 256 parities of the common shingles, by hash: two sets have at least as many differences as parities that aren't the same, so
    `_agreeing` leaves out pairs that have too many before it makes them.
    """

    common = COMMON

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k, n, f, h in zip(pdf["k"], pdf["n"], pdf["f"], pdf["h"], strict=True):
                h = np.asarray(h).astype(H.U)
                keys, room, own = _part_keys(np.asarray(f), h, percent, common)
                if len(keys):
                    odd = np.bincount((H.mix(h[np.asarray(f) > common]) & H.U(255)).astype(np.int64), minlength=256) & 1
                    x = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
                    yield pd.DataFrame({"k": k, "n": n, "room": room, "own": own, "h": keys.view(np.int64), **dict(zip(PARITIES, x, strict=True))})

    lists = ranked.select("k", "n", F.col("hs.f").alias("f"), F.col("hs.h").alias("h"))
    return lists.mapInPandas(sparing(run), f"k long, n long, room long, own boolean, h long, {' long, '.join(PARITIES)} long")


def _part_keys(f: np.ndarray, h: np.ndarray, percent: int, common: int = COMMON) -> tuple[np.ndarray, int, np.ndarray]:
    """The keys of one ordered set, its room, and which are its own."""
    n, differ, same = len(h), 100 - percent, 100 + percent
    others = int(np.searchsorted(f, common, "right"))
    prefix = h[others : n + (-percent * n) // 100 + 1]
    room = differ * n - same * others
    first = (2 * abs(room) // same).bit_length()  # with less than no room: the least that a partner must have
    last = (2 * differ * (100 * n // percent) // same).bit_length()
    keys, own = [], []
    if len(prefix):
        mixed = H.mix(h[others:])
        mixed.sort()
        for j in range(first, last + 1):
            at = (mixed >> H.U(64 - j)).astype(np.int64) if j else np.zeros(len(mixed), np.int64)
            begun = np.flatnonzero(np.diff(at, prepend=-1))
            tag = (H.U(j) << H.U(32)) + at[begun].astype(H.U)
            found = [H.mix(np.add.reduceat(H.mix(mixed), begun) + H.mix(tag))]
            if j <= 4:
                for part in np.setdiff1d(np.arange(1 << j), at[begun]):
                    found.append(H.mix(H.mix(prefix) + H.U((j << 32) + int(part))))
            keys += found
            own += [np.full(len(x), j == first and room >= 0) for x in found]
    return (np.concatenate(keys), room, np.concatenate(own)) if keys else (np.empty(0, H.U), room, np.empty(0, bool))


def _linkable(percent: int):
    """Whether rows (n, left) of two sides, ending in a and b, can belong to a link whose first common shingle this is."""
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((100 + percent) * F.least("lefta", "leftb") >= percent * (F.col("na") + F.col("nb")))


def _side(index: DataFrame, end: str, *more: str) -> DataFrame:
    return index.select("h", *(F.col(c).alias(c + end) for c in ("k", "root", "n", *(more or ("left",)))))


def _stars(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of each class and the one class of each of its shingles that has the fewest rare ones (most is left; ties: the least)."""
    row = F.struct("k", "root", "n", "left")
    held = rare.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by(row, F.struct("left", -F.col("k"))).alias("c")).where("lo < hi")
    met = _side(rare, "a").join(_side(held.select("h", "c.*"), "b"), "h").where((F.col("roota") != F.col("rootb")) & _linkable(percent))
    return met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def _sharing(rare: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share a row of the index, of shingles that aren't common, and can be links."""
    rare = cut(rare)
    shared = rare.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    rare = cut(rare.join(shared, "h", "left_semi"))
    one, two = _side(rare, "a"), _side(rare, "b").withColumnRenamed("h", "h_")
    met = one.join(two, (F.col("h") == F.col("h_")) & (F.col("ka") < F.col("kb")) & (F.col("roota") != F.col("rootb")) & _linkable(percent))
    return met.select(F.col("ka").alias("a"), F.col("kb").alias("b")).distinct()


def _agreeing(parted: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that agree in a part of their common shingles and can be links, one of them by its own key."""
    parted = cut(parted)
    shared = parted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("own").alias("own")).where("lo < hi and own").select("h")
    parted = cut(parted.join(shared, "h", "left_semi"))
    one, two = _side(parted.where("own"), "a", "room", *PARITIES), _side(parted, "b", "room", *PARITIES)
    odd = sum((F.bit_count(F.col(f"{x}a").bitwiseXOR(F.col(f"{x}b"))) for x in PARITIES), F.lit(0))
    sized = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("rooma") + F.col("roomb") >= (100 + percent) * odd)
    met = one.join(two, "h").where((F.col("roota") != F.col("rootb")) & sized)
    return met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, equal (share of equal minima): pairs whose sizes allow a link and whose estimate isn't five deviations below the limit."""

    @F.pandas_udf("double")
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        p, q = (np.stack(list(s)).astype(np.int64) for s in (x, y))
        return pd.Series((p.view(np.uint8) == q.view(np.uint8)).mean(axis=1))

    j = percent / 100
    floor = j - 5 * (j * (1 - j) / 256) ** 0.5
    one = classes.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = classes.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", equal("sa", "sb").alias("equal")).where(F.col("equal") >= floor)


def _between(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs of different components."""
    one, two = joined.select(F.col("v").alias("a"), F.col("root").alias("ra")), joined.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()


def _sets(rows: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """k, set (sorted hashes, packed) of the documents in pairs."""
    ids = cut(_members(pairs), 2 * pairs.count())
    wanted = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "k", "left_semi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [pack(np.unique(h >> H.U(64 - SET_BITS)), SET_BITS) for h in shingles(pdf["t"].tolist(), shingle)]
            yield pd.DataFrame({"k": pdf["k"], "set": found})

    return wanted.mapInPandas(sparing(run), "k long, set binary")


def _best(pairs: DataFrame) -> DataFrame:
    """Each class's two likeliest partners (ties: the least)."""
    both = pairs.union(pairs.select("b", "a", "equal"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("equal"), "b"))).where("r <= 2")
    return ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links by their full sets."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            a, b = unpack(p, SET_BITS), unpack(q, SET_BITS)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    # rows of one doc_id may have several texts: then any pair of them will do
    one, two = sets.select(F.col("k").alias("a"), F.col("set").alias("x")), sets.select(F.col("k").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(linked("x", "y")).select("a", "b").distinct()


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one document of each component: that of the least doc_id. Rows without a doc_id stay."""
    gone = near_duplicates(docs, shingle, percent).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_minhash_near_dedup": op3_minhash_near_dedup}

ORACLE_SQL = {
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(v, u) AS (SELECT a, b FROM link UNION SELECT v, b FROM reach JOIN link ON u = a),
root AS (SELECT v, min(u) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root ON v = d.doc_id
"""
}
