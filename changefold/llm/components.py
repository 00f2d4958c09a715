"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefold.llm.common import saved


def _starred(links: DataFrame) -> DataFrame:
    """Links (u, v) with u's smallest neighbour, itself included, as m."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "u2")
    return links.join(least, F.col("u") == F.col("u2")).select("u", "v", "m")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node that a link (a, b) touches; comp is the smallest node.

    Each round is two equi-joins over the links; the number of links never grows, and the
    rounds grow with the logarithm of the longest path. Each round is written to the
    shared folder. Null ends and self-links are ignored.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = saved(links, "cc")
    before = _state(links)
    if not before[0]:
        return links.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _starred(large)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        links = saved(small, "cc")
        state = _state(links)
        if state == before:
            tops = links.select(F.col("v").alias("node")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops.select("node", F.col("node").alias("comp")))
        before = state
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")


def _state(links: DataFrame) -> tuple:
    """How many links there are and a sum of their hashes."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0])


def extended(comps: DataFrame, more: DataFrame) -> DataFrame:
    """The components with further links (a, b): only components that these join are
    looked at, as one node each."""
    for end in ("a", "b"):
        known = comps.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        more = more.join(known, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c")
    tops = saved(components(more), "cc").withColumnsRenamed({"node": "_top", "comp": "_to"})
    moved = comps.join(tops, F.col("comp") == F.col("_top"), "left").select("node", F.coalesce("_to", "comp").alias("comp"))
    fresh = tops.join(comps, F.col("_top") == F.col("node"), "left_anti").select(F.col("_top").alias("node"), F.col("_to").alias("comp"))
    return moved.unionByName(fresh)
