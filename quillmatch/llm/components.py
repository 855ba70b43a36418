"""Connected components of links that never leave Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.checkpoints import cut


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> v, root: every linked vertex with the least vertex of its component.

    Each round hooks every root to its least neighbouring root, follows the hooks to their ends and contracts the links. Roots that
    stay are least among their neighbours, so chains fall together at once and the number of rounds is logarithmic in practice.
    """
    edges = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), links.count())
    count = left = edges.count()
    labels = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("root", F.col("v"))
    while left:
        both = edges.union(edges.select("b", "a"))
        hook = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")), 2 * left)
        moved = True
        while moved:
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            top = up.select(F.col("p").alias("q"), F.col("q").alias("r"))
            # where q is its own parent, the end is reached; elsewhere r may have a parent
            jumped = cut(hook.join(up, "p").join(top, "q").select("a", F.col("r").alias("p"), (F.col("q") != F.col("r")).alias("moved")), 2 * left)
            hook, moved = jumped.select("a", "p"), jumped.agg(F.max("moved")).first()[0]
        labels = cut(labels.join(hook.select(F.col("a").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root")), 2 * count)
        one, two = hook.select("a", F.col("p").alias("x")), hook.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = cut(edges.join(one, "a").join(two, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), left)
        left = edges.count()
    return labels
