"""Keys within a few edits of each other, and what is left over after matching, by what is nearest to it.

The join of near keys is an equi-join on segments. A key of n letters that may differ by d edits from a partner is cut in d + 1 segments: d edits leave one
of them as it is, and it begins in the partner at most a few letters further on or back. So reference keys are indexed by (length, d,
number of the segment, segment), the other side looks its substrings up at just the places where that segment can be, and only pairs
that meet there are compared letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.functions.text import text

EPS = 1e-9


def _edits(length: Column, least: float) -> Column:
    """Edits that a pair may differ by if the longer key has this length."""
    return F.floor(length * (1 - least) + EPS).cast("int")


def _upto(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _cut(n: str, d: str, i: str) -> tuple[Column, Column]:
    """(first letter from 0, length) of segment i of d + 1 segments of n letters; the last ones are a letter longer where they don't come out even."""
    size = F.floor(F.col(n) / (F.col(d) + 1)).cast("int")
    even = F.col(d) + 1 - F.col(n) % (F.col(d) + 1)  # segments of the smaller length
    return F.col(i) * size + F.greatest(F.col(i) - even, F.lit(0)), size + (F.col(i) >= even).cast("int")


def segments(keys: DataFrame, key: str, least: float) -> DataFrame:
    """key, n, d, i, seg: the index. A key is cut for every number of edits that a partner of some length can bring."""
    longest = F.floor(F.length(key) / least + EPS).cast("int")
    rows = keys.select(key, F.length(key).alias("n")).withColumn("d", F.explode(_upto(_edits(F.col("n"), least), _edits(longest, least))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    start, size = _cut("n", "d", "i")
    return rows.select(key, "n", "d", "i", F.substring(key, start + 1, size).alias("seg"))


def probes(keys: DataFrame, key: str, least: float) -> DataFrame:
    """key, n, d, i, seg: what a key looks up, for partners of n letters.

    Of the segments that stay as they are one has i edits before it at most and d - i behind it, so it has moved by i at most, and by d - i
    against the ends.
    """
    length = F.length(key)
    low, high = F.greatest(F.ceil(length * least - EPS).cast("int"), F.lit(1)), F.floor(length / least + EPS).cast("int")
    rows = keys.select(key, F.explode(_upto(low, high)).alias("n")).withColumn("d", _edits(F.greatest("n", F.length(key)), least))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    start, size = _cut("n", "d", "i")
    shift, after = F.length(key) - F.col("n"), F.col("d") - F.col("i")
    first = F.greatest(F.lit(0), start - F.col("i"), start + shift - after)
    last = F.least(F.length(key) - size, start + F.col("i"), start + shift + after)
    rows = rows.withColumn("at", F.explode(_upto(first, last)))
    return rows.select(key, "n", "d", "i", F.substring(key, F.col("at") + 1, size).alias("seg")).distinct()


def candidate_pairs(a: DataFrame, key: str, b: DataFrame, other: str, least: float) -> DataFrame:
    """key, other: distinct pairs that share a segment; all near pairs are among them."""
    return probes(a, key, least).join(segments(b, other, least), ["n", "d", "i", "seg"]).select(key, other).distinct()


def near_keys(a: DataFrame, key: str, b: DataFrame, other: str, least: float = 0.8) -> DataFrame:
    """key, other, score: the pairs of a's and b's keys with score = 1 - levenshtein / longer length of at least `least` (over 0.5).

    Both sides count once a key; null and blank keys are near to nothing. Keys that share a segment at one place meet in one group of the join, so a
    segment that very many keys of one length share costs their number times its lookups; Spark splits such groups.
    """
    if not 0.5 < least <= 1:
        raise ValueError(f"least is {least}; it must be over 0.5, at most 1")
    one, two = (d.where(text(c) != "").select(c).distinct() for d, c in ((a, key), (b, other)))
    longer = F.greatest(F.length(key), F.length(other))
    away = F.levenshtein(F.col(key), F.col(other))
    return candidate_pairs(one, key, two, other, least).withColumn("score", 1 - away / longer).where(F.col("score") >= least)


def residual_partition(unmatched: DataFrame, ref: DataFrame, channel: str, key: str, row_no: str, least: float = 0.8, top: int = 3) -> DataFrame:
    """Unmatched (channel, key) groups by what is nearest to them: channel, key, rows, kind, score, nearest.

    kind: same_channel_fuzzy, other_channel_exact, other_channel_fuzzy or absent, the first that holds. score: that of the best near key (null if
    absent). nearest: the `top` best, array<struct<key, score, same (channel), channel (one that has it, the own one if it does)>>, by score, own
    channel first, then key. Blank keys are left out, a null channel is "". A near key is looked at once a group, whatever number of channels have it.
    """
    groups = unmatched.where(text(key) != "").groupBy(text(channel).alias(channel), key).agg(F.count(row_no).alias("rows"))
    keys = ref.where(text(key) != "").select(text(channel).alias("rc"), F.col(key).alias("rk")).distinct()
    held = keys.groupBy("rk").agg(F.min("rc").alias("lo"), F.max("rc").alias("hi"))
    own = keys.select(F.col("rk").alias("_rk"), F.col("rc").alias("_own"))
    near = near_keys(groups.select(key), key, keys, "rk", least).join(held, "rk")
    met = groups.select(channel, key).join(near, key)
    met = met.join(own, (F.col("rk") == F.col("_rk")) & (F.col(channel) == F.col("_own")), "left")
    same, else_ = F.col("_own").isNotNull(), (F.col("lo") != F.col(channel)) | (F.col("hi") != F.col(channel))
    met = met.select(channel, key, "rk", "score", same.alias("same"), else_.alias("other"), F.coalesce("_own", "lo").alias("rc"))
    kinds = met.groupBy(channel, key).agg(F.max("same").alias("same"), F.max(F.col("other") & (F.col("rk") == F.col(key))).alias("exact"), F.max("other").alias("other"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(channel, key).orderBy(F.desc("score"), F.desc("same"), "rk"))
    best = met.withColumn("_r", place).where(F.col("_r") <= top).groupBy(channel, key)
    listed = best.agg(F.array_sort(F.collect_list(F.struct("_r", F.col("rk").alias("key"), "score", "same", F.col("rc").alias("channel")))).alias("nearest"))
    joined = kinds.join(listed, [channel, key])
    kind = F.when(F.col("same"), "same_channel_fuzzy").when(F.col("exact"), "other_channel_exact").when(F.col("other"), "other_channel_fuzzy").otherwise("absent")
    shown = F.transform(F.coalesce("nearest", F.array()), lambda x: F.struct(x["key"].alias("key"), x["score"].alias("score"), x["same"].alias("same"), x["channel"].alias("channel")))
    return groups.join(joined, [channel, key], "left").select(channel, key, "rows", kind.alias("kind"), "score", shown.alias("nearest"))


def nearest_text(nearest: str = "nearest") -> Column:
    """key:thousandths of the score, joined."""
    return F.array_join(F.transform(nearest, lambda x: F.concat(x["key"], F.lit(":"), F.floor(x["score"] * 1000 + 1e-6).cast("string"))), " | ")
