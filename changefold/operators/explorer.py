"""Looking into a message log: topics, partitions, cursors, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefold.operators.filters import subject_filter
from changefold.operators.routing import status_filter


def consumer_info(log: DataFrame, deliveries: DataFrame, *sinks: str) -> DataFrame:
    """One row for each sink: ack_floor, the end of the acknowledged prefix of the log, and
    pending, the messages never delivered to it.

    The prefix ends before the first message that isn't acknowledged, so the floor is a
    minimum and no window over the log is needed. Deliveries are added up by message for all
    sinks at once, so the log is joined once.
    """
    acked = [F.max(F.when(F.col("sink") == s, F.col("acked"))).alias(f"_{i}") for i, s in enumerate(sinks)]
    mine = deliveries.filter(F.col("sink").isin(*sinks)).groupBy(F.col("seq").alias("_seq")).agg(*acked)
    rows = log.select("seq").join(mine, F.col("seq") == F.col("_seq"), "left")

    def of(i: int, sink: str) -> Column:
        open_ = F.min(F.when(~F.coalesce(f"_{i}", F.lit(False)), F.col("seq")))
        floor = F.coalesce(open_ - 1, F.max("seq"), F.lit(0)).cast("long")
        return F.struct(F.lit(sink).alias("sink"), floor.alias("ack_floor"), F.count_if(F.col(f"_{i}").isNull()).alias("pending"))

    return rows.agg(F.array(*[of(i, s) for i, s in enumerate(sinks)]).alias("s")).select(F.inline("s"))


def stream_stats(log: DataFrame, deliveries: DataFrame) -> DataFrame:
    """messages, bytes, first_seq, last_seq of the log and its number of consumers."""
    consumers = deliveries.agg(F.count_distinct("sink").alias("consumers"))
    totals = log.agg(
        F.count("*").alias("messages"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )
    return totals.join(F.broadcast(consumers))  # one row each


def list_topics(log: DataFrame) -> DataFrame:
    return log.groupBy("topic").agg(F.count("*").alias("message_count"), F.count_distinct("subject").alias("partition_count"))


def list_partitions(log: DataFrame, topic: str | None = None) -> DataFrame:
    rows = log.filter(F.col("topic") == topic) if topic is not None else log
    return rows.groupBy("topic", "subject").agg(F.count("*").alias("message_count"))


def order_changes(log: DataFrame) -> DataFrame:
    """The log in strict order within each source: by instance, position and sequence. Spark
    deals it out by ranges, which also cut a large instance."""
    return log.orderBy("instance_id", "lsn", "seq")


def sort_spec(df: DataFrame, spec: list[tuple[str, str]], tie: str = "seq") -> DataFrame:
    """Order by (field, asc, desc or unspecified, which is asc), ties by sequence."""
    return df.orderBy(*[F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in spec], tie)


def paginate(df: DataFrame, limit: int, page: int) -> DataFrame:
    """A page of an ordered frame, counted from 1; no positive limit or page gives all."""
    return df if limit <= 0 or page <= 0 else df.offset((page - 1) * limit).limit(limit)


def page_info(df: DataFrame, limit: int, page: int) -> DataFrame:
    """total, total_pages, has_next, has_prev of a listing."""
    n = df.agg(F.count("*").alias("total"))
    pages = F.when(F.lit(limit) > 0, F.ceil(F.col("total") / max(limit, 1))).otherwise(1).cast("long")
    return n.select("total", pages.alias("total_pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev"))


def list_messages(
    log: DataFrame, floor: DataFrame | None = None, status: str = "all", topic: str | None = None, subject: str | None = None,
    sort: list[tuple[str, str]] | None = None, limit: int = 20, page: int = 1, most: int = 100, scan: int | None = None,
) -> DataFrame:
    """A page of messages by status, topic and subject pattern. ``most`` caps the page size,
    as the listing's own feature; ``scan`` optionally bounds how many matches are looked at."""
    rows = log if topic is None else log.filter(F.col("topic") == topic)
    rows = rows if subject is None else subject_filter(rows, subject)
    rows = status_filter(rows, floor, status) if floor is not None else rows
    rows = rows.orderBy("seq").limit(scan) if scan else rows
    return paginate(sort_spec(rows, sort or []), min(limit, most), page)
