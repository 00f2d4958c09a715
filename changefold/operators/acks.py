"""What sinks have acknowledged, as runs of sequence numbers that grow with each batch.

A state has rows (sink, span, start, end): numbers start to end are in the set, all of them in
one span of ``SPAN`` numbers. A batch of new numbers touches its spans alone, runs that meet are
joined there, and no window crosses a span. So work follows the new acknowledgements, and a prefix
that is acknowledged whole is a row per span, whatever its messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers of a span.
SPAN = 1_000_000
STATE = "sink string, span long, start long, end long"


def runs_of(numbers: DataFrame, span: int = SPAN) -> DataFrame:
    """The runs of (sink, seq); null numbers are left out and repeated ones count once."""
    rows = numbers.filter("seq is not null").select(F.col("sink").cast("string").alias("sink"), F.floor(F.col("seq") / span).alias("span"), F.col("seq").cast("long").alias("seq")).distinct()
    placed = rows.withColumn("_run", F.col("seq") - F.row_number().over(W.partitionBy("sink", "span").orderBy("seq")))
    return placed.groupBy("sink", "span", "_run").agg(F.min("seq").alias("start"), F.max("seq").alias("end")).drop("_run")


def extend_runs(state: DataFrame, numbers: DataFrame, span: int = SPAN) -> DataFrame:
    """The state with new (sink, seq) in it. ``state`` has been made with the same span."""
    new = runs_of(numbers, span)
    touched = new.select(F.col("sink").alias("_sink"), F.col("span").alias("_span")).distinct()
    same = F.col("sink").eqNullSafe(F.col("_sink")) & (F.col("span") == F.col("_span"))
    both = state.join(touched, same, "left_semi").unionByName(new)
    spans = W.partitionBy("sink", "span").orderBy("start", "end")
    reached = F.max("end").over(spans.rowsBetween(W.unboundedPreceding, -1))
    begun = both.withColumn("_new", F.coalesce((F.col("start") > reached + 1).cast("long"), F.lit(1))).withColumn("_run", F.sum("_new").over(spans))
    joined = begun.groupBy("sink", "span", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
    return state.join(touched, same, "left_anti").unionByName(joined)


def info_of_runs(log: DataFrame, delivered: DataFrame, acked: DataFrame, *sinks: str) -> DataFrame:
    """``explorer.consumer_info`` from runs: of the log (any sink name), of what was delivered to
    each sink, and of what each acknowledged, which is of the log.

    The first span in which a sink has acknowledged fewer messages than the log holds has the first open
    one: the number behind an acknowledged run, or the first of a run of the log.
    """
    length = F.col("end") - F.col("start") + 1
    held = log.groupBy("span").agg(F.sum(length).alias("n"))
    named = log.sparkSession.createDataFrame([(s,) for s in sinks], "sink string")
    counts = F.broadcast(named).crossJoin(held.withColumnRenamed("span", "_span"))  # a row per sink asked for and span
    done = acked.groupBy(F.col("sink").alias("_sink"), F.col("span").alias("_at")).agg(F.sum(length).alias("m"))
    open_ = counts.join(done, (F.col("sink") == F.col("_sink")) & (F.col("_span") == F.col("_at")), "left").filter(F.coalesce("m", F.lit(0)) < F.col("n"))
    first = open_.groupBy("sink").agg(F.min("_span").alias("span"))
    there = first.select(F.col("sink").alias("_s"), F.col("span").alias("_p"))
    mine = acked.join(there, (F.col("sink") == F.col("_s")) & (F.col("span") == F.col("_p"))).select("sink", F.col("start").alias("a"), F.col("end").alias("b"))
    runs = first.join(log.select(F.col("span").alias("_p"), F.col("start").alias("x"), F.col("end").alias("y")), F.col("span") == F.col("_p")).select("sink", "x", "y")
    tried = mine.select("sink", (F.col("b") + 1).alias("at")).unionByName(runs.select("sink", F.col("x").alias("at")))
    inside = tried.join(runs.withColumnRenamed("sink", "_s"), (F.col("sink") == F.col("_s")) & F.col("at").between(F.col("x"), F.col("y")), "left_semi")
    free = inside.join(mine.withColumnRenamed("sink", "_s"), (F.col("sink") == F.col("_s")) & F.col("at").between(F.col("a"), F.col("b")), "left_anti")
    floors = free.groupBy("sink").agg((F.min("at") - 1).alias("floor"))
    got = delivered.groupBy("sink").agg(F.sum(length).alias("got"))
    whole = log.agg(F.max("end").alias("last"), F.coalesce(F.sum(length), F.lit(0)).alias("total"))
    out = named.join(floors, "sink", "left").join(got, "sink", "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("sink", F.coalesce("floor", "last", F.lit(0)).cast("long").alias("ack_floor"), (F.col("total") - F.coalesce("got", F.lit(0))).cast("long").alias("pending"))
