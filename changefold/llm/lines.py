"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed table sorted by the 128-bit line hash. A new batch is aggregated and
merge-joined with the fresh rows of the runs on disk: hashes that none of them holds (the anti-join) enter as
fresh rows of the batch's own run; held ones enter as increments beside them. So each hash
is fresh in one run only, and what only one batch holds is never aggregated again. When a level holds
``fanout`` runs they are merged into one run of the next level, so every row is rewritten a
logarithmic number of times and a batch meets few runs. Runs are bucketed alike and have a
sorted file a bucket, so joins with them neither move nor sort their rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changefold.llm.common import SPACES, ascii_lower, broadcast_if_small, delete, saved, shared_dir

#: Stands for a null doc_id, which counts as the smallest.
NO_ID = -(2**63)
#: Hashes of common lines that may be broadcast, 24 bytes each.
MOST_COMMON = 1_000_000
#: Lines of the corpus per bucket of a run, and buckets at most, as Spark takes no more than
#: 100,000: beyond 5 billion lines the buckets grow, and are sorted on disk when written.
BUCKET_LINES, MOST_BUCKETS = 250_000, 20_000
#: Lets a scan give the order of a bucket that is one file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_hashes(text: Column, min_chars: int) -> Column:
    """An array with, for each line of the text, its two hashes; null if its key is short."""
    def hashed(key: Column) -> Column:
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")))

    # a transform for each step, as what a lambda names twice is computed twice
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACES)))
    return F.transform(F.transform(stripped, ascii_lower), hashed)


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder, as tables of ``buckets``
    buckets: h1, h2, n (documents that hold the line), top (the largest doc_id among them)
    and held, which parts increments from the fresh rows of the run that held the line first.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, path: str | None = None, buckets: int = 8):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.path = path or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        out = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").partitionBy("held")
        out.option("path", f"{self.path}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _parts(self, held: bool) -> list[DataFrame]:
        names = [n for level in self.levels for n in level]
        return [self.spark.table(n).filter(F.col("held") == held).select("h1", "h2", "n", "top") for n in names]

    def runs(self) -> DataFrame:
        """All rows of all runs, with ``fresh``."""
        both = [p.withColumn("fresh", F.lit(not held)) for held in (False, True) for p in self._parts(held)]
        return reduce(DataFrame.unionByName, both)

    def unseen(self, own: DataFrame) -> DataFrame:
        """Add ``held``, which is false for hashes that no run holds yet."""
        held = F.lit(False)
        for k, run in enumerate(self._parts(False)):
            run = run.select(F.col("h1").alias(f"_a{k}"), F.col("h2").alias(f"_b{k}"))
            own = own.join(run.hint("merge"), (F.col("h1") == F.col(f"_a{k}")) & (F.col("h2") == F.col(f"_b{k}")), "left")
            held = held | F.col(f"_a{k}").isNotNull()
        return own.select("h1", "h2", "n", "top", held.alias("held"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, did), one row per line and document."""
        own = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("did").alias("top"))
        # where a cluster deals out to more partitions than there are buckets, tasks are joined,
        # so that a run has no more files than buckets times buckets
        before = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")
        try:
            self._write(self.unseen(own.repartition(self.buckets, "h1", "h2")).coalesce(self.buckets), 0)
        finally:
            self.spark.conf.set(ORDERED, before)
        self._compact()

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                rows = reduce(DataFrame.unionByName, [self.spark.table(n) for n in names])
                # a hash is fresh once, so only increments add up
                merged = rows.filter("not held").unionByName(_summed(rows.filter("held")).withColumn("held", F.lit(True)))
                self._write(merged.repartition(self.buckets, "h1", "h2").coalesce(self.buckets), level + 1)
                self.levels[level] = []
                self._drop(names)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Drop all runs and their folder."""
        self._drop([n for level in self.levels for n in level])
        self.levels = [[]]
        delete(self.spark, self.path)

    def totals(self) -> DataFrame:
        """(h1, h2, n, top) over all batches: the fresh rows with their increments."""
        more = _summed(reduce(DataFrame.unionByName, self._parts(True))).toDF("_h1", "_h2", "_n", "_top")
        fresh = [p.join(more, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left") for p in self._parts(False)]
        each = reduce(DataFrame.unionByName, fresh)
        return each.select("h1", "h2", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("top", "_top").alias("top"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__line_did", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__line_rid", F.xxhash64("doc_id", "text"))


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """Per distinct (doc_id, text) that loses lines: __line_did, __line_rid and their positions ``__line_drop``."""
    hashed = _keyed(docs.select("doc_id", "text")).select("__line_did", "__line_rid", line_hashes(F.col("text"), min_chars).alias("_h"))
    # whole lines are hashed once; everything else reads this table
    hashed = hashed.withColumn("batch", F.pmod(F.xxhash64("__line_did"), F.lit(batches)).cast("int"))
    hashed = saved(hashed, "line-hashes", by="batch")
    keys = F.array_compact("_h")
    n_lines = hashed.agg(F.sum(F.size(keys).cast("long"))).collect()[0][0] or 0
    runs = LineRuns(docs.sparkSession, fanout, buckets=min(MOST_BUCKETS, max(8, -(-n_lines // BUCKET_LINES))))
    for b in range(batches):
        # outer generators: the others make Spark test the array's size first, computing it twice
        lines = hashed.filter(F.col("batch") == b).select(F.col("__line_did").alias("did"), F.explode_outer(F.array_distinct(keys)).alias("_l"))
        runs.add(lines.filter("_l is not null").select("did", "_l.h1", "_l.h2"))
    common = runs.totals().filter(F.col("n") >= min_docs).withColumnsRenamed({"h1": "g1", "h2": "g2"})
    common = broadcast_if_small(saved(common.select("g1", "g2", "top"), "line-common"), MOST_COMMON)
    runs.close()
    lines = hashed.select("__line_did", "__line_rid", F.posexplode_outer("_h").alias("_pos", "_l")).filter("_l is not null").select("__line_did", "__line_rid", "_pos", "_l.h1", "_l.h2")
    losing = lines.join(common, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(F.col("__line_did") != F.col("top"))
    return losing.groupBy("__line_did", "__line_rid").agg(F.collect_set("_pos").alias("__line_drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop lines that recur across documents; all columns stay, ``text`` is replaced, and
    ``n_lines`` and ``n_dropped`` are added (existing columns of these names give way).

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of
    ``min_chars`` code points or more that ``min_docs`` documents hold lose all their lines
    except in the largest doc_id. Every row counts as a document; rows that repeat a doc_id
    all keep their lines if it is the largest. A null doc_id is the smallest; a null text
    is one empty line and stays null. An empty table gives an empty one.
    """
    drop = dropped_lines(docs, min_chars, min_docs, batches, fanout).withColumnsRenamed({"__line_did": "__line_did2", "__line_rid": "__line_rid2"})
    rows = _keyed(docs.drop("n_lines", "n_dropped"))
    rows = rows.join(drop, (F.col("__line_did") == F.col("__line_did2")) & (F.col("__line_rid") == F.col("__line_rid2")), "left")
    rows = rows.withColumn("__line_all", F.split(F.coalesce("text", F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__line_all") - 1), "__line_drop")
    kept = F.array_join(F.transform(stay, lambda i: F.get("__line_all", i)), "\n")
    rows = rows.withColumn("n_lines", F.size("__line_all").cast("long")).withColumn("n_dropped", F.coalesce(F.array_size("__line_drop"), F.lit(0)).cast("long"))
    return rows.withColumn("text", F.when(F.col("__line_drop").isNull(), F.col("text")).otherwise(kept)).drop("__line_did", "__line_rid", "__line_did2", "__line_rid2", "__line_drop", "__line_all")
