"""Which of many words a file's name contains: one automaton over all of them instead of a test for each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import nfkc, norm_header, text
from quillmatch.operators.ranks import global_rank
from quillmatch.sources.scratch import landed

#: Words of one automaton (some 200 MB); more of them go by blocks.
MAX_WORDS = 1 << 20


def best_contained(names: DataFrame, name: str, words: DataFrame, word: str, order: Sequence[Column], payload: Sequence[str], block: int = MAX_WORDS) -> DataFrame:
    """name, and of the words in it the payload columns of the first by order; names without one are left out.

    names: distinct ones are looked at, once. words(word, *payload, ...): text columns, blank words are ignored; the order must tell its rows apart. The
    words' number is counted before they are gathered: up to `block` make one automaton, which tasks run names through in one pass each;
    more are ranked in Spark and taken block by block in order, and a name that has met its word isn't looked at again.
    """
    wanted = words.where(text(word) != "")
    n = wanted.count()
    if n <= block:
        blocks = [wanted.orderBy(*order)]
    else:
        ranked = global_rank(wanted, order, "__r")
        blocks = [ranked.where(F.col("__r").between(lo + 1, lo + block)).orderBy("__r") for lo in range(0, n, block)]
    left = names.select(F.col(name).alias(name)).where(F.col(name).isNotNull()).distinct()
    out = None
    for rows in blocks:
        got = _looked_up(left, name, [tuple(r) for r in rows.select(word, *payload).collect()], payload)  # `block` rows at most
        if len(blocks) > 1:
            got = landed(got)  # the next block's names depend on it: kept, or plans double with every block
            left = landed(left.join(got, name, "left_anti"))
        out = got if out is None else out.unionByName(got)
    return out


def _looked_up(names: DataFrame, name: str, table: list[tuple], payload: Sequence[str]) -> DataFrame:
    found = ahocorasick.Automaton()
    for i, (w, *_) in enumerate(table):
        if w not in found:  # of equal words the first counts
            found.add_word(w, i)
    found.make_automaton()
    sent = names.sparkSession.sparkContext.broadcast((found, [row[1:] for row in table]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, values = sent.value
        for pdf in frames:
            out = []
            for x in pdf[name]:
                best = min((i for _, i in automaton.iter(x)), default=-1) if values else -1
                if best >= 0:
                    out.append((x, *values[best]))
            yield pd.DataFrame(out, columns=[name, *payload])

    return names.mapInPandas(run, ", ".join(f"`{c}` string" for c in (name, *payload)))


def longest_contained(df: DataFrame, name: str, words: DataFrame, word: str, rank: Sequence[Column] = (), block: int = MAX_WORDS) -> DataFrame:
    """df with found, the best of the words that are contained in name ("" if none): by rank first, then the longest, then by text."""
    held = words.where(text(word) != "").select(F.col(word).alias("__w"), *(r.alias(f"__r{i}") for i, r in enumerate(rank))).distinct()
    order = [*(F.col(f"__r{i}") for i in range(len(rank))), -F.length("__w"), F.col("__w")]
    best = best_contained(df.select(F.col(name).alias("__n")), "__n", held.withColumn("found", F.col("__w")), "__w", order, ["found"], block)
    return df.join(best, F.col(name) == F.col("__n"), "left").select(*df.columns, F.coalesce("found", F.lit("")).alias("found"))


def channel_key(c: Column | str) -> Column:
    """Channel and file names in the form in which they are compared."""
    return norm_header(nfkc(F.translate(text(c), "_", "")))


def detect_channel(files: DataFrame, name: str, channels: DataFrame, channel: str, platform: str, block: int = MAX_WORDS) -> DataFrame:
    """files with the channel and platform their name tells ("" if none): the second of three or more parts between __, if that is a channel; else
    the longest channel in the name, ties by channel, then platform, both descending."""
    rules = channels.where(text(channel) != "").select(channel_key(channel).alias("__w"), text(channel).alias("__c"), text(platform).alias("__p")).where("__w <> ''")
    one = rules.groupBy("__w").agg(F.max(F.struct("__c", "__p")).alias("__v")).select("__w", F.col("__v.__c").alias("channel"), F.col("__v.__p").alias("platform"))
    names = files.select(F.col(name).alias("__n")).distinct().withColumn("__b", F.regexp_extract(text("__n"), r"([^/\\]*)$", 1))
    parts = F.split(F.regexp_replace("__b", r"\.[^.]*$", ""), "__")
    names = names.withColumns({"__k": channel_key("__b"), "__e": channel_key(F.when(F.size(parts) >= 3, parts[1]).otherwise(F.lit("")))})
    said = names.join(one.select(F.col("__w").alias("__e"), F.struct("channel", "platform").alias("__s")), "__e", "left")
    rest = said.where("__s is null")
    order = [-F.length("__w"), F.desc("channel"), F.desc("platform")]
    held = best_contained(rest, "__k", one, "__w", order, ["channel", "platform"], block).select(F.col("__k").alias("__h"), F.struct("channel", "platform").alias("__x"))
    both = said.join(held, said["__k"] == held["__h"], "left").select(F.col("__n"), F.coalesce("__s", "__x").alias("__v"))
    out = files.join(both, F.col(name).eqNullSafe(F.col("__n")), "left")
    return out.select(*files.columns, F.coalesce("__v.channel", F.lit("")).alias("channel"), F.coalesce("__v.platform", F.lit("")).alias("platform"))


def detect_platform(files: DataFrame, name: str, aliases: DataFrame, platforms: DataFrame, block: int = MAX_WORDS) -> DataFrame:
    """files with the platform their name tells: the first alias of aliases(platform, alias, pos) in it, else the longest of platforms(platform)."""
    words = aliases.select(channel_key("alias").alias("__w"), "platform", "pos").unionByName(platforms.select(channel_key("platform").alias("__w"), "platform", F.lit(1 << 30).alias("pos")))
    words = words.where("__w <> ''").groupBy("__w").agg(F.min(F.struct("pos", "platform")).alias("__v")).select("__w", "__v.platform", "__v.pos")
    names = files.select(F.col(name).alias("__n")).distinct().withColumn("__k", channel_key("__n"))
    best = best_contained(names, "__k", words, "__w", [F.col("pos"), -F.length("__w"), F.col("platform"), F.col("__w")], ["platform"], block)
    found = names.join(best, "__k").select("__n", F.col("platform").alias("__p"))
    return files.join(found, F.col(name).eqNullSafe(F.col("__n")), "left").select(*files.columns, F.coalesce("__p", F.lit("")).alias("platform"))
