"""Counters, histograms and series over logs, deliveries and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of batch sizes and of seconds.
BATCH_BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)
SECOND_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)


def component_stats(results: DataFrame) -> DataFrame:
    """Per component: events, batches, success and failure counts and the last error, from
    rows (component, pos, events, ok, error)."""
    failed = ~F.col("ok")
    return results.groupBy("component").agg(
        F.sum("events").cast("long").alias("events"), F.count("*").alias("batches"), F.count_if("ok").alias("success_count"),
        F.count_if(failed).alias("failure_count"), F.max_by("error", F.when(failed, F.col("pos"))).alias("last_error"),
    )


def batch_offsets(df: DataFrame, *by: str) -> DataFrame:
    """Per instance, and per any further columns: the last offset in order and the highest lsn."""
    return df.groupBy("instance_id", *by).agg(F.max_by("offset", "seq").alias("last_offset"), F.max("lsn").alias("max_lsn"))


def flushed_position(acks: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Per instance the highest acknowledged lsn, never below what was held before."""
    rows = acks.select("instance_id", "lsn")
    rows = rows.unionByName(held.select("instance_id", F.col("flushed").alias("lsn"))) if held is not None else rows
    return rows.groupBy("instance_id").agg(F.max("lsn").alias("flushed"))


def counters(df: DataFrame, *labels: str) -> DataFrame:
    """Rows per combination of labels."""
    return df.groupBy(*labels).agg(F.count("*").alias("total"))


def histogram(df: DataFrame, value: str, bounds: tuple, *labels: str) -> DataFrame:
    """Cumulative buckets of a value per labels: le (text, +Inf last), n, total, sum.

    One pass of conditional counts, turned into rows after aggregation.
    """
    tests = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    agg = df.groupBy(*labels).agg(*tests, F.count(value).alias("total"), F.sum(value).cast("double").alias("sum"))
    cells = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n"))]
    return agg.select(*labels, F.explode(F.array(*cells)).alias("c"), "total", "sum").select(*labels, "c.le", "c.n", "total", "sum")


def backlog_ratio(progress: DataFrame) -> DataFrame:
    """Fill of each buffer (name, pending, capacity); those without capacity are left out."""
    return progress.filter("capacity > 0").select("name", (F.col("pending") / F.col("capacity")).alias("ratio"))


def series_sum(samples: DataFrame, name: str, *labels: str) -> DataFrame:
    """Sum of a metric's samples per labels, from (name, labels, value)."""
    return samples.filter(F.col("name") == name).groupBy(*[F.try_element_at("labels", F.lit(x)).alias(x) for x in labels]).agg(F.sum("value").alias("value"))


def sink_latency_ms(samples: DataFrame, name: str = "cdc_sink_write_duration_seconds_sum") -> DataFrame:
    """Per sink the summed duration in milliseconds, to two places."""
    return series_sum(samples, name, "sink").select("sink", F.round(F.col("value") * 1000, 2).alias("latency_ms"))


def throughput_delta(samples: DataFrame, by: str, at: str, value: str, span: int = 1_000_000) -> DataFrame:
    """Growth of a counter since the sample before it, per series; null for the first.

    ``at`` is a number. A series is cut into spans of it, each of which looks back inside
    itself; only the first sample of a span takes the last of the span before, from a table
    with one row per span, so that a long series isn't ordered by one task.
    """
    slot = F.floor(F.col(at) / span)
    rows = samples.withColumn("_slot", slot)
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(W.partitionBy(by, "_slot").orderBy(at))
    ends = rows.groupBy(F.col(by).alias("_by"), F.col("_slot").alias("_s")).agg(F.max_by(F.struct(F.col(value).alias("v")), at).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(W.partitionBy("_by").orderBy("_s"))).drop("_end")
    rows = rows.withColumn("_last", inside).join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slot") == F.col("_s")), "left")
    return rows.withColumn("delta", F.col(value) - F.coalesce("_last", "_before")["v"]).drop("_slot", "_last", "_by", "_s", "_before")


def recent_history(samples: DataFrame, by: str, at: str, n: int = 20) -> DataFrame:
    """The last n samples of each series, which is the report itself."""
    return samples.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col(at).desc()))).filter(F.col("rank") <= n)


def dashboard_totals(deliveries: DataFrame) -> DataFrame:
    """One row: how many sources and sinks took part, and how many deliveries succeeded."""
    return deliveries.agg(F.count_distinct("instance_id").alias("sources"), F.count_distinct("sink").alias("sinks"), F.count_if("acked").alias("processed"))


def of_total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")
