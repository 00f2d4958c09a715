"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Every run of ``n`` consecutive words of a benchmark item is a window. Each document emits
the hashes of short anchors at fixed strides, so that every window of the document holds a
whole anchor; anchors meet the broadcast set of benchmark anchors in one map-side join, and
the windows around each hit are compared word by word. Only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changefold.llm.common import ascii_lower, broadcast_if_small, saved

#: Bytes below 128 other than digits and letters separate words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark anchors that may be broadcast; their bytes are bounded as well.
MOST_ANCHORS = 1_000_000
#: A place and a window's length share a number; windows are shorter than this.
PLACE = 1024


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, split at ASCII characters other than letters and
    digits. Null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def bench_windows(bench: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(window, length, words) for each distinct window, and (window, item_id) members."""
    words = bench.select("item_id", words_of(F.col("text")).alias("w")).withColumn("len", F.least(F.size("w"), F.lit(n))).filter("len > 0")
    each = words.select("item_id", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda i: F.slice("w", i + 1, F.col("len")))).alias("win"))
    members = each.select("item_id", "len", "win", F.xxhash64("win").alias("h1"), F.xxhash64(F.lit(7), "win").alias("h2")).distinct()
    members = saved(members, "bench-windows")
    return members.select("h1", "h2", "len", "win").distinct(), members.select("h1", "h2", "item_id").distinct()


def met_windows(keyed: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The windows that occur in each row of ``keyed`` (doc_id, rid, w): doc_id, rid, n_words,
    h1, h2, at, len, and a row without window for each row itself.

    One scan covers all lengths: places at the stride of each length are numbers that hold place and
    length. Where the anchors are few, the join is a broadcast and windows are compared word by
    word on the spot. Otherwise only ids and places are shuffled, without words, and candidates are
    verified once per row, by the two hashes of the words at their place.
    """
    size_of = lambda length: F.floor((length + 1) / 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("len") - size_of(F.col("len"))), lambda j: F.slice("win", j + 1, size_of(F.col("len"))))
    anchors = windows.select("h1", "h2", F.col("len").alias("_len"), "win", F.posexplode(parts).alias("off", "bench_words"))
    anchors = saved(anchors.select(F.xxhash64("bench_words").alias("anchor"), "_len", "off", "h1", "h2", "win"), "bench-anchors")
    few = broadcast_if_small(anchors, MOST_ANCHORS)

    words = F.size("w").cast("long")
    # place -1 keeps one row for each document, whether hit or not
    places = [F.array(F.lit(-1).cast("long"))]
    for length in lengths:
        size = (length + 1) // 2  # of an anchor
        steps = F.sequence(F.lit(length).cast("long"), (words - size) * PLACE + length, F.lit((length - size + 1) * PLACE).cast("long"))
        places.append(F.when(words >= size, steps).otherwise(F.array().cast("array<long>")))
    tried = keyed.select("doc_id", "rid", "w", F.explode(F.concat(*places)).alias("_p"))
    tried = tried.withColumn("place", F.floor(F.col("_p") / PLACE).cast("int")).withColumn("len", (F.pmod("_p", F.lit(PLACE))).cast("int"))
    # marks carry their row's hash, so that a shuffled join doesn't gather them in one task
    tried = tried.withColumn("key", F.when(F.col("place") >= 0, F.xxhash64(F.slice("w", F.col("place") + 1, size_of(F.col("len"))))).otherwise(F.col("rid")))
    same = (F.col("key") == F.col("anchor")) & (F.col("len") == F.col("_len")) & (F.col("place") >= 0)
    start = F.col("place") - F.col("off")
    if few is not anchors:
        met = tried.join(few, same, "left").filter("place < 0 or anchor is not null")
        hit = (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
        met = met.filter((F.col("place") < 0) | hit)
        return met.select("doc_id", "rid", words.alias("n_words"), "h1", "h2", start.alias("at"), "len")
    slim = tried.filter("place >= 0").select("doc_id", "rid", "place", "len", "key").distinct()
    met = slim.join(anchors.drop("win"), same).filter(start >= 0).select("doc_id", "rid", F.struct(start.alias("at"), "len", "h1", "h2").alias("c")).distinct()
    met = saved(met.groupBy(F.col("doc_id").alias("_d"), F.col("rid").alias("_r")).agg(F.collect_list("c").alias("cs")), "bench-candidates")
    both = keyed.join(met, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rid") == F.col("_r")), "left")

    def holds(c: Column) -> Column:
        there = F.slice("w", c["at"] + 1, c["len"])
        return (F.xxhash64(there) == c["h1"]) & (F.xxhash64(F.lit(7), there) == c["h2"]) & (c["at"] + c["len"] <= F.size("w"))

    mark = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2")))
    good = F.coalesce(F.filter("cs", holds), F.array().cast("array<struct<at:int,len:int,h1:bigint,h2:bigint>>"))
    rows = both.select("doc_id", "rid", words.alias("n_words"), F.explode(F.concat(mark, good)).alias("c"))
    return rows.select("doc_id", "rid", "n_words", "c.h1", "c.h2", "c.at", "c.len")


def find_hits(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """Per distinct (doc_id, text) row key: copies, n_words, n_hit, n_items, items_sha256.

    A document word is hit if it lies inside an occurrence of any window of an item; an item
    of fewer than ``n`` words is one window. ``n`` is less than ``PLACE``.
    """
    if not 1 <= n < PLACE:
        raise ValueError(f"n must be from 1 to {PLACE - 1}")
    windows, members = bench_windows(bench, n)
    lengths = [r[0] for r in windows.select("len").distinct().orderBy("len").collect()]  # n values at most
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), words_of(F.col("text")).alias("w"))
    found = met_windows(keyed, windows, lengths)
    found = saved(found, "bench-hits")
    copies = found.filter("h1 is null").groupBy("doc_id", "rid").agg(F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
    hits = found.filter("h1 is not null")
    spans = hits.groupBy("doc_id", "rid", "at").agg(F.max(F.col("at") + F.col("len")).alias("to"))
    by_doc = W.partitionBy("doc_id", "rid").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("to") - F.greatest("at", F.coalesce(F.max("to").over(by_doc), F.lit(0)))))
    spans = spans.groupBy("doc_id", "rid").agg(F.sum("new").cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("at", "to"))).alias("spans"))
    of_window = members.withColumnsRenamed({"h1": "g1", "h2": "g2"})
    items = hits.select("doc_id", "rid", "h1", "h2").distinct().join(of_window, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    items = items.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    for side, names in ((spans, ("n_hit", "spans")), (items, ("items",))):
        side = side.withColumnsRenamed({"doc_id": "_d", "rid": "_r"})
        copies = copies.join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rid") == F.col("_r")), "left").select(*copies.columns, *names)
    return copies


def report(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; repeated rows each give a row; an item
    with null or empty text has no window, and a null item_id reads as an empty string;
    empty tables are fine on either side.
    """
    hits = find_hits(docs, bench, n)
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    hits = hits.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return hits.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """Remove what the benchmark contains, with the columns of ``docs`` unchanged.

    ``remove="documents"`` drops rows with any hit; ``"spans"`` cuts the hit words, with the
    separators after each, out of the text. Rows without hits come back as they are.
    """
    bad = find_hits(docs, bench, n).filter("n_hit > 0").select(F.col("doc_id").alias("__bench_d"), F.col("rid").alias("__bench_r"), F.col("spans").alias("__bench_spans"))
    bad = saved(bad, "bench-bad")
    keyed = docs.withColumn("__bench_rid", F.xxhash64("doc_id", "text"))
    same = F.col("doc_id").eqNullSafe(F.col("__bench_d")) & (F.col("__bench_rid") == F.col("__bench_r"))
    if remove == "documents":
        return keyed.join(broadcast_if_small(bad.drop("__bench_spans"), MOST_ANCHORS), same, "left_anti").drop("__bench_rid")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all("text", F.lit(f"{word}{GAP[:-1]}*"), F.lit(0))
    lead = F.regexp_extract("text", f"^{GAP[:-1]}*", 0)
    left = F.filter(pieces, lambda x, i: ~F.exists("__bench_spans", lambda s: (s["at"] <= i) & (i < s["to"])))
    cut = F.concat(lead, F.array_join(left, ""))
    return keyed.join(bad, same, "left").withColumn("text", F.when(F.col("__bench_spans").isNull(), F.col("text")).otherwise(cut)).drop("__bench_rid", "__bench_d", "__bench_r", "__bench_spans")
