"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Targets come from weights by water filling. The whole mix is cut into blocks of equal
token count; the blocks (seats) go to sources, and then to the shards of each source, by
highest quotients target / (2 s + 1). In a shard, documents lie in seeded order on a line
of tokens cut into blocks, and the shard's quota of blocks is chosen by a systematic
sample with a seeded start. What a source's whole blocks hold beside its target is made up
by cutting its last seats, or by a part of a block more. All steps are DataFrame functions; only token counts, never
texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changefold.llm.common import WORD, broadcast_if_small, saved


def seeded(seed: int, *parts: Column) -> Column:
    """60 bits of a digest of the seed and the parts; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """One row per source with its target in tokens.

    ``sizes``: source, source_size. Sources are ordered by code point, null last, and take
    the weights in turn. ``share`` of all tokens is dealt by weight; no target exceeds
    ``cap`` times the source's size, and what exceeds it is dealt again by weight.
    Written as water filling: with sources ordered by cap / weight, the level is the first
    one that the remaining sources can all hold. The frame has one row per source, so its
    global windows stay small.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(everything)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1),
    )
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = W.orderBy(F.col("most") / F.col("weight"), "rank")
    filled = ranked.withColumn("before", F.coalesce(F.sum("most").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    filled = filled.withColumn("rest", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    filled = filled.withColumn("level", (F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)) - F.col("before")) / F.col("rest"))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    filled = filled.withColumn("level", F.first(holds, ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return filled.select("source", "source_size", "rank", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def apportion(claims: DataFrame, group: list[str], order: list[Column], claim: str, seats: str) -> DataFrame:
    """Give each row of ``claims`` an integer ``quota``; in each group they sum to ``seats``.

    Highest quotients claim / (2 s + 1) take the seats, ties by ``order``. A row's seats
    differ from its exact share by less than (k / 2n) of the share plus one half, for k rows
    and n seats, so only quotients inside that band compete and the others are granted:
    three per row on average, not one per seat. Rows without claim get none.
    """
    over = W.partitionBy(*group) if group else W.partitionBy()
    total, rows = F.sum(claim).over(over), F.sum((F.col(claim) > 0).cast("long")).over(over)
    band = claims.withColumn(
        "_share", F.when((F.col(claim) > 0) & (F.col(seats) > 0), F.col(claim) * F.col(seats) / total),
    ).withColumn("_slack", F.col("_share") * rows / (2 * F.col(seats)))
    band = band.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_share") - F.col("_slack") - 1)).cast("long"))
    band = band.withColumn("_open", F.ceil(F.col("_share") + F.col("_slack") + 1).cast("long"))
    band = band.withColumn("_left", F.col(seats) - F.sum(F.coalesce("_sure", F.lit(0))).over(over))
    tried = band.withColumn("_s", F.explode_outer(F.when(F.col("_open") > F.col("_sure"), F.sequence("_sure", F.col("_open") - 1))))
    tried = tried.withColumn("_at", F.row_number().over(over.orderBy((F.col(claim) / (2 * F.col("_s") + 1)).desc_nulls_last(), *order, "_s")))
    won = (F.col("_s").isNotNull() & (F.col("_at") <= F.col("_left"))).cast("long")
    return tried.groupBy(*claims.columns).agg((F.max(F.coalesce("_sure", F.lit(0))) + F.sum(won)).alias("quota"))


def _chosen(block: Column) -> Column:
    """How many of a shard's blocks before this one are in its systematic sample."""
    return F.floor((block * F.col("rest") + F.col("start")) / F.col("some"))


def _sampled(place: Column, block_words: int) -> Column:
    """Words that a shard's quota takes of its line up to a place."""
    block = F.floor(place / block_words)
    part = (place - block * block_words) * (_chosen(block + 1) - _chosen(block))
    return F.col("whole") * place + _chosen(block) * block_words + part


def shard_quotas(slim: DataFrame, weights: tuple, share: float, cap: float, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(placed, shards): the rows with their source's figures and shard; and per (source, shard) its
    tokens, its quota of blocks, how these are sampled, and the words that are cut or added.

    ``slim``: source, size, key. A source has about as many shards as a shard has blocks, so that neither the
    window over a source's shards nor that over a shard's documents grows with the source. The windows over sources
    see a row or a few per source. The words of a source's sampled blocks differ from its target
    by parts of blocks; what is too much is cut from the end of its first shards' lines, and what is missing
    is added at the beginning of theirs, where a document is taken less than ``cap`` times.
    """
    per_source = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    per_source = per_source.withColumn("all_seats", F.round(F.sum("target").over(W.partitionBy()) / block_words).cast("long"))
    per_source = apportion(per_source, [], [F.col("rank")], "target", "all_seats").withColumnRenamed("quota", "seats").drop("all_seats")
    per_source = per_source.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / block_words))).cast("long"))
    per_source = broadcast_if_small(saved(per_source, "mix-sources"), 100_000)
    placed = slim.join(per_source, slim["source"].eqNullSafe(per_source["source"])).drop(per_source["source"]).withColumn("shard", F.pmod("key", "shards"))
    shards = placed.groupBy("source", "shard", "source_size", "target", "seats").agg(F.sum("size").alias("tokens"))
    shards = apportion(shards, ["source"], [F.col("shard")], "tokens", "seats")
    blocks = F.ceil(F.col("tokens") / block_words).cast("long")
    shards = shards.withColumn("quota", F.least("quota", blocks * F.lit(int(cap)))).withColumn("some", F.greatest(blocks, F.lit(1)))
    shards = shards.withColumn("whole", F.floor(F.col("quota") / F.col("some"))).withColumn("rest", F.pmod("quota", "some"))
    return placed, shards


def _corrected(shards: DataFrame, cap: float, block_words: int) -> DataFrame:
    """Add to the shards ``made``, the words their quotas take, and ``cut`` and ``more``, which bring a
    source's words to its target."""
    source = W.partitionBy("source")
    before = source.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    made = shards.withColumn("made", _sampled(F.col("tokens"), block_words)).withColumn("room", F.col("tokens") * int(cap) - F.col("made"))
    made = made.withColumn("off", F.round("target").cast("long") - F.sum("made").over(source))
    cut = F.least(F.col("made"), F.greatest(F.lit(0), -F.col("off") - so_far("made")))
    more = F.least(F.col("room"), F.greatest(F.lit(0), F.col("off") - so_far("room")))
    return made.withColumn("cut", cut).withColumn("more", more)


def mix_sources(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 256, seed: int = 17) -> DataFrame:
    """Mix all documents to target weights.

    Reads doc_id, source and text; other columns, whatever their names, are left out.
    Returns one row per input row: doc_id, source, size (words), source_size, target,
    shard, taken (words the mix takes, repeats counted; at most ``cap`` times the size). The taken
    words of a source are its target, rounded. ``cap`` is a whole number.
    Defined results: null and empty texts have size 0 and take 0; null is a source of its
    own, last in order; rows with equal doc_id count as so many documents; a null doc_id is
    kept; no rows give no rows. Reruns agree: order and block choice depend on digests of
    seed, doc_id and text alone.
    """
    slim = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seeded(seed, F.col("doc_id"), F.col("text")).alias("key"),
    )
    slim = saved(slim, "mix-sizes")
    placed, shards = shard_quotas(slim, weights, share, cap, block_words)
    shards = shards.withColumn("start", F.pmod(seeded(seed, F.col("source"), F.col("shard")), F.col("some")))
    shards = _corrected(shards, cap, block_words).select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "some", "whole", "rest", "start", "made", "cut", "more")
    by_shard = W.partitionBy("source", "shard")
    line = placed.withColumn("end", F.sum("size").over(by_shard.orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)))
    line = line.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))

    def words(place: Column) -> Column:
        sampled = _sampled(place, block_words)
        return F.least(sampled, F.col("made") - F.col("cut")) + F.least(place * int(cap) - sampled, F.col("more"))

    taken = words(F.col("end")) - words(F.col("end") - F.col("size"))
    return line.select("doc_id", "source", "size", "source_size", "target", "shard", taken.cast("long").alias("taken"))
