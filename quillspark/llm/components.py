"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import Scratch


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Each neighbour ``v`` of ``u`` for which ``keep`` holds, joined to the least of u's neighbourhood."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    An empty table gives an empty result; loops and repeated edges change nothing.  Each round writes
    its stars to the shared folder, so no lineage grows and a lost executor costs one round.
    """
    now = scratch.cut(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.cut(_star(both, "v > u").distinct(), "large")
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = scratch.cut(out, "small")
        state = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(now, large)
        now = small
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {most} rounds")
