"""Sinks of streaming queries: each reads the log on its own checkpoint, in micro-batches.

A sink's ``write`` gets a batch and its number and must be safe to repeat: a batch counts as
done only when the checkpoint moves on after it. Batches are numbered anew by each new
checkpoint, so what a sink remembers of a batch is kept under the query's own id.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changefold.operators.actions import REQUEST_BYTES, webhook_batches
from changefold.operators.filters import subject_match
from changefold.operators.merge import split_keyless, split_ops
from changefold.streaming.log import BASE_MS, CAP_MS, MAX_RETRIES, PERMANENT, DeliveryError, dead_letters, error_kind
from changefold.streaming.tables import MergeTable


class Sink(Protocol):
    name: str
    subjects: list[str]

    def write(self, batch: DataFrame, epoch: int) -> None: ...


def query_id(spark: SparkSession) -> str:
    """The id of the query whose batch is being written; it changes with the checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


class FunctionSink:
    """A sink from a plain function of (batch, epoch)."""

    def __init__(self, name: str, function: Callable[[DataFrame, int], None], subjects: list[str] | None = None):
        self.name, self.function, self.subjects = name, function, subjects or []

    def write(self, batch: DataFrame, epoch: int) -> None:
        self.function(batch, epoch)


class AppendSink:
    """Writes each batch, in the given shape, to a folder of its query and number, so that a
    repeated batch replaces itself."""

    def __init__(
        self, name: str, path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, subjects: list[str] | None = None, by: tuple[str, ...] = (),
        form: str = "parquet",
    ):
        self.name, self.path, self.shape, self.subjects, self.by, self.form = name, path, shape, subjects or [], by, form

    def write(self, batch: DataFrame, epoch: int) -> None:
        out = self.shape(batch).write.format(self.form).mode("overwrite")
        (out.partitionBy(*self.by) if self.by else out).save(f"{self.path}/query={query_id(batch.sparkSession)}/batch={epoch}")


class WebhookSink:
    """Posts each batch as JSON arrays of at most ``size`` changes and ``max_bytes`` bytes, from the
    tasks that hold them. A status outside 200 to 299 fails the batch, which is then tried again as a whole."""

    def __init__(
        self, name: str, url: str, size: int = 100, include_payload: bool = False, headers: dict[str, str] | None = None, timeout: float = 10.0,
        subjects: list[str] | None = None, shape: Callable[[DataFrame], DataFrame] = lambda df: df, max_bytes: int = REQUEST_BYTES,
    ):
        self.name, self.url, self.size, self.payload, self.timeout, self.subjects, self.shape = name, url, size, include_payload, timeout, subjects or [], shape
        self.headers, self.max_bytes = {"Content-Type": "application/json"} | (headers or {}), max_bytes

    def write(self, batch: DataFrame, epoch: int) -> None:
        url, headers, timeout = self.url, self.headers, self.timeout

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                statuses = []
                for body in rows.column(0).to_pylist():
                    try:
                        with urllib.request.urlopen(urllib.request.Request(url, body.encode(), headers), timeout=timeout) as answer:
                            statuses.append(answer.status)
                    except urllib.error.HTTPError as e:
                        statuses.append(e.code)
                    except OSError:
                        statuses.append(0)
                yield pa.RecordBatch.from_arrays([pa.array(statuses, pa.int32())], ["status"])

        posts = webhook_batches(self.shape(batch), self.size, self.payload, self.max_bytes).select("value").mapInArrow(post, "status int")
        failed = posts.filter("status not between 200 and 299").agg(F.count("*").alias("n"), F.min("status").alias("s")).collect()[0]
        if failed["n"]:
            raise DeliveryError(f"{failed['n']} posts failed, with status {failed['s']}", "network")


class TableSink:
    """Keeps a current table (see ``MergeTable``): changes count by their position, in
    whatever order they arrive. Rows that can't be applied go to dead letters."""

    def __init__(
        self, name: str, path: str, key: str, position: list[str], empty: DataFrame, subjects: list[str] | None = None, dlq: str | None = None,
        keys: dict[str, str] | None = None, compact: int = 8, shape: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 16,
        evolve: bool = False,
    ):
        self.name, self.subjects, self.dlq, self.keys, self.shape = name, subjects or [], dlq or f"{path}/dlq", keys or {}, shape
        self.table = MergeTable(path, key, empty.schema, position, buckets, compact, evolve=evolve)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.table.read(spark)

    def write(self, batch: DataFrame, epoch: int) -> None:
        query = query_id(batch.sparkSession)
        rows = self.shape(batch).withColumn("image", F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")))
        known, unknown = split_ops(rows)
        empty = known.filter("image is null").withColumn("reason", F.lit("missing image"))
        kind = self.table.schema[self.table.key].dataType.simpleString()
        keyed, keyless = split_keyless(known.filter("image is not null"), self.keys, self.table.key, kind)
        rejected = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [unknown, empty, keyless]).drop("image")
        dead_letters(rejected, F.col("reason")).write.mode("overwrite").parquet(f"{self.dlq}/sink={self.name}/query={query}/batch={epoch}-rejected")
        self.table.add(keyed, query, epoch)


#: What an error says if a query was stopped while it wrote a batch.
STOPPED = ("InterruptedException", "ClosedByInterruptException", "InterruptedIOException", "SPARK_JOB_CANCELLED", "cancelled part of cancelled job group")


def was_stopped(error: BaseException) -> bool:
    """Whether an error comes from the end of its query, whose batch will be done again."""
    while error is not None:
        if any(s in f"{type(error).__name__} {error}" for s in STOPPED):
            return True
        error = error.__cause__
    return False


def with_retries(write: Callable[[], None], retries: int = MAX_RETRIES, base: int = BASE_MS, cap: int = CAP_MS) -> None:
    """Call once, and up to ``retries`` times more after errors that aren't permanent, waiting
    base, twice base, ... up to cap milliseconds between; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return write()
        except Exception as e:
            if attempt == retries or error_kind(e) in PERMANENT or was_stopped(e):
                raise
            time.sleep(min(base * 2**attempt, cap) / 1000)


def run_sink(log: DataFrame, sink: Sink, checkpoint: str, trigger: dict | None = None, tries: int = 1, dlq: str | None = None, base: int = BASE_MS) -> StreamingQuery:
    """Start a sink's query over a log stream, on a cursor of its own under ``checkpoint``.

    A batch that fails ``tries`` times, or for good, goes to the dead letters at ``dlq`` and the sink
    goes on with the next, unless the query is being stopped; without ``dlq`` the query ends with the error, and takes the same batch up again
    when it is started anew.
    """
    rows = log.filter(subject_match(F.col("subject"), sink.subjects)) if sink.subjects else log

    def each(batch: DataFrame, epoch: int) -> None:
        try:
            with_retries(lambda: sink.write(batch, epoch), max(0, tries - 1), base)
        except Exception as e:
            if dlq is None or was_stopped(e):
                raise
            reason = F.lit(f"{error_kind(e)}: {str(e)[:500]}")
            dead_letters(batch, reason).write.mode("overwrite").parquet(f"{dlq}/sink={sink.name}/query={query_id(batch.sparkSession)}/batch={epoch}-failed")

    return rows.writeStream.queryName(sink.name).foreachBatch(each).option("checkpointLocation", f"{checkpoint}/{sink.name}").trigger(**(trigger or {"availableNow": True})).start()


def query_stats(queries: list[StreamingQuery]) -> list[dict]:
    """Progress of queries: name, batches, rows, seconds of the last batch, running."""
    out = []
    for q in queries:
        seen = [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in q.recentProgress]
        out.append({"name": q.name, "batches": len(seen), "rows": sum(p["numInputRows"] for p in seen), "running": q.isActive})
    return out
