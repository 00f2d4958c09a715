"""Pipeline definitions: sources and sinks by type name, filters, transformers, defaults."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from changefold.operators.actions import REQUEST_BYTES, append_rows, bulk_actions, bulk_requests, console_lines, kv_commands
from changefold.operators.filters import Predicate, Transformer, apply_filters, apply_transformers, compute_fields, rename_fields, select_image, table_allowed
from changefold.operators.routing import build_key, route_target, value_fields
from changefold.plans.scratch import Marker, scratch_root
from changefold.sources.changes import fan_in, read_changes
from changefold.sources.decode import binlog_rows_to_events, poll_rows_to_events, wal_rows_to_events
from changefold.sources.poll import PollSource
from changefold.sources.snapshot import digest, hand_off, place, place_number, snapshot_to_events
from changefold.streaming.log import KEEP_DAYS, PARTITIONS, dedup_stream, message_id, publish_log, to_messages
from changefold.streaming.seek import SeekIndex
from changefold.streaming.sinks import AppendSink, FunctionSink, Sink, TableSink, WebhookSink, run_sink

logger = logging.getLogger(__name__)


@dataclass
class SourceSpec:
    """A source: its type names the builder, options go to it."""

    instance_id: str
    type: str = "parquet"
    tables: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    topic: str = "cdc"


@dataclass
class SinkSpec:
    """A sink: its type names the builder, options go to it.

    ``mapping`` renames fields of its images, ``expressions`` set fields to SQL expressions over
    ``data``. ``routes`` name targets by instance.table or table, else ``index`` or ``prefix``
    does. ``keys`` are key columns by table; ``key`` is an expression for the keys of a store.
    Batches that fail ``max_retries`` times after the first go to the pipeline's dead letters.
    """

    name: str
    type: str = "append"
    subjects: list[str] = field(default_factory=lambda: ["cdc.>"])
    options: dict = field(default_factory=dict)
    max_retries: int = 3
    retry_base_ms: int = 1000
    batch_size: int | None = None
    flush_ms: int | None = None
    mapping: dict[str, str] = field(default_factory=dict)
    expressions: dict[str, str] = field(default_factory=dict)
    routes: dict[str, str] = field(default_factory=dict)
    index: str | None = None
    prefix: str | None = None
    keys: dict[str, str] = field(default_factory=dict)
    key: str | None = None

    def shaped(self, df: DataFrame) -> DataFrame:
        """Both images with this sink's fields."""
        for image in ("before", "after"):
            df = df.withColumn(image, rename_fields(F.col(image), self.mapping))
            df = compute_fields(df, self.expressions, image)
        return df

    def routed(self, df: DataFrame) -> DataFrame:
        return route_target(select_image(self.shaped(df)), self.routes, self.index, self.prefix)


@dataclass
class PipelineSpec:
    """``log`` is the path of the message log between sources and sinks; without one each sink
    reads the sources. ``dlq`` is the path of the dead letters; without one a batch that keeps
    failing ends its sink. ``batch_size`` and ``flush_ms`` hold for sinks that name none: how many
    changes a request has, and how often batches start."""

    sources: list[SourceSpec] = field(default_factory=list)
    sinks: list[SinkSpec] = field(default_factory=list)
    filters: list[Predicate] = field(default_factory=list)
    transformers: list[Transformer] = field(default_factory=list)
    batch_size: int = 100
    flush_ms: int = 1000
    keep_days: int = KEEP_DAYS
    log: str | None = None
    dlq: str | None = None

    def check(self) -> None:
        """Each type says which options it needs; nothing is asked of others."""
        names = [s.name for s in self.sinks]
        if len(set(names)) != len(names):
            raise ValueError("sink names must differ")
        for spec, kinds in [(s, SOURCES) for s in self.sources] + [(s, SINKS) for s in self.sinks]:
            builder(kinds, spec.type)
            if spec.type == "handoff" and not self.log:
                raise ValueError("handoff: needs a log")
            missing = [o for o in NEEDED.get(spec.type, ()) if o not in spec.options]
            if missing:
                raise ValueError(f"{spec.type}: missing options {', '.join(missing)}")


# --- sources: a spec becomes change envelopes, as a table or a stream --------------------


def _rows(spark: SparkSession, path: str, stream: bool, spec: SourceSpec) -> DataFrame:
    """A Parquet table, or a stream of the files that are added to it."""
    if not stream:
        return spark.read.parquet(path)
    return read_changes(spark, path, stream=True, schema=spark.read.parquet(path).schema, files_per_trigger=spec.options.get("files_per_trigger"))


def _parquet(spark: SparkSession, spec: SourceSpec, stream: bool) -> DataFrame:
    return read_changes(spark, spec.options["path"], stream=stream, files_per_trigger=spec.options.get("files_per_trigger"))


def _json(spark: SparkSession, spec: SourceSpec, stream: bool) -> DataFrame:
    return read_changes(spark, spec.options["path"], stream=stream, form="json", files_per_trigger=spec.options.get("files_per_trigger"))


def _snapshot(spark: SparkSession, spec: SourceSpec, stream: bool) -> DataFrame:
    """A row's identity is its place, file and row, so keys need not tell rows apart, and a
    restart gives the same."""
    o = spec.options
    row_id = place(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    events = snapshot_to_events(_rows(spark, o["path"], stream, spec), o["table"], spec.instance_id, row_id=row_id)
    return events.withColumn("seq", place_number(F.col("row_id"))).withColumn("ts", F.current_timestamp())


def _handoff(spark: SparkSession, spec: SourceSpec, stream: bool) -> DataFrame:
    """A snapshot and the changes beyond its position. As a stream these are two of one query, and
    with ``only_snapshot`` the changes' files aren't seen yet, see ``Pipeline.publish``."""
    o = spec.options
    hidden = "*.not-yet" if o.get("only_snapshot") else None
    changes = read_changes(spark, o["changes"], stream=stream, files_per_trigger=o.get("files_per_trigger"), names=hidden)
    return hand_off(_snapshot(spark, spec, stream), changes, o["lsn"]).drop("phase")


def _told_apart(events: DataFrame) -> DataFrame:
    """Events with a digest of what they say, as rows of one transaction may share a position; the
    same event delivered twice has the same."""
    sorted_image = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    return events.withColumn("row_id", digest(F.col("op"), sorted_image("before"), sorted_image("after"))).withColumn("seq", F.col("lsn"))


def _wal(spark: SparkSession, spec: SourceSpec, stream: bool) -> DataFrame:
    relations = spark.read.parquet(spec.options["relations"])
    return _told_apart(wal_rows_to_events(_rows(spark, spec.options["path"], stream, spec), relations, spec.instance_id))


def _binlog(spark: SparkSession, spec: SourceSpec, stream: bool) -> DataFrame:
    return _told_apart(binlog_rows_to_events(_rows(spark, spec.options["path"], stream, spec), spec.instance_id))


def _poll(spark: SparkSession, spec: SourceSpec, stream: bool) -> DataFrame:
    """Polls of the addresses ``url``, whose responses are kept in ``keep`` until they are done, or a
    table of responses kept at a path."""
    o = spec.options
    if "path" in o:
        responses = _rows(spark, o["path"], stream, spec)
    else:
        spark.dataSource.register(PollSource)
        responses = spark.readStream.format("poll").options(urls=o["url"], keep=o.get("keep") or f"{scratch_root(spark)}/polls-{spec.instance_id}").load()
    return poll_rows_to_events(responses, spec.instance_id, o["table"]).withColumn("seq", F.col("lsn"))


# --- sinks -------------------------------------------------------------------------------


def _append(spark: SparkSession, spec: SinkSpec) -> Sink:
    return AppendSink(spec.name, spec.options["path"], spec.shaped, spec.subjects)


def _routed(spark: SparkSession, spec: SinkSpec) -> Sink:
    columns = spec.options["columns"]
    return AppendSink(spec.name, spec.options["path"], lambda df: append_rows(spec.routed(df), columns), spec.subjects, by=("target",))


def _table(spark: SparkSession, spec: SinkSpec) -> Sink:
    o = spec.options
    empty, position = spark.createDataFrame([], o["schema"]), o.get("position", ["lsn", "seq", "instance_id"])
    more = {"buckets": o.get("buckets", 16), "evolve": o.get("evolve", False)}
    return TableSink(spec.name, o["path"], o.get("key", "id"), position, empty, spec.subjects, o.get("dlq"), spec.keys, shape=spec.shaped, **more)


def _console(spark: SparkSession, spec: SinkSpec) -> Sink:
    """Lines printed by the tasks that hold them, to their executors' logs."""

    def show(rows) -> None:
        for row in rows:
            print(row["line"])

    return FunctionSink(spec.name, lambda batch, epoch: console_lines(spec.shaped(batch)).foreachPartition(show), spec.subjects)


def _bulk(spark: SparkSession, spec: SinkSpec) -> Sink:
    """Requests of a document index as text, of at most ``batch_size`` actions and ``max_bytes`` bytes each."""
    size, clean, most = spec.batch_size or 100, spec.options.get("clean", False), spec.options.get("max_bytes", REQUEST_BYTES)
    return AppendSink(spec.name, spec.options["path"], lambda df: bulk_requests(bulk_actions(spec.routed(df), clean), size, most).select("value"), spec.subjects, form="text")


def _kv(spark: SparkSession, spec: SinkSpec) -> Sink:
    o = spec.options

    def commands(df: DataFrame) -> DataFrame:
        rows = build_key(select_image(spec.shaped(df)), spec.key, o.get("key_prefix", "cdc"))
        return kv_commands(rows, o.get("command", "hset"), o.get("ttl", 0), value_fields(F.col("image"), o.get("value_fields", [])))

    return AppendSink(spec.name, o["path"], commands, spec.subjects)


def _webhook(spark: SparkSession, spec: SinkSpec) -> Sink:
    o = spec.options
    settings = (o.get("payload", False), o.get("headers"), o.get("timeout", 10.0))
    return WebhookSink(spec.name, o["url"], spec.batch_size or 100, *settings, spec.subjects, spec.shaped, o.get("max_bytes", REQUEST_BYTES))


SOURCES: dict[str, Callable] = {"parquet": _parquet, "json": _json, "snapshot": _snapshot, "wal": _wal, "binlog": _binlog, "poll": _poll, "handoff": _handoff}
SINKS: dict[str, Callable] = {"append": _append, "routed": _routed, "table": _table, "console": _console, "bulk": _bulk, "kv": _kv, "webhook": _webhook}
NEEDED = {
    "parquet": ("path",), "json": ("path",), "snapshot": ("path", "table"), "handoff": ("path", "table", "changes", "lsn"), "wal": ("path", "relations"), "binlog": ("path",), "poll": ("table",),
    "append": ("path",), "routed": ("path", "columns"), "table": ("path", "schema"), "bulk": ("path",), "kv": ("path",), "webhook": ("url",),
}


def register(kinds: dict[str, Callable], name: str, build: Callable) -> None:
    kinds[name] = build


def list_types() -> dict[str, list[str]]:
    return {"sources": sorted(SOURCES), "sinks": sorted(SINKS)}


def builder(kinds: dict[str, Callable], name: str) -> Callable:
    if name not in kinds:
        raise ValueError(f"unknown type {name}; known are {', '.join(sorted(kinds))}")
    return kinds[name]


class Pipeline:
    """Runs a definition as streaming queries, one per sink and one that publishes to the
    log if there is one, or as one batch."""

    def __init__(self, spark: SparkSession, spec: PipelineSpec, checkpoint: str):
        spec.check()
        self.spark, self.spec, self.checkpoint = spark, spec, checkpoint
        self.queries: dict[str, StreamingQuery] = {}

    def changes(self, stream: bool = False, only_snapshots: bool = False) -> DataFrame:
        """All sources' changes after filters and transformers, with their topics and without what messages add."""
        parts = []
        for s in self.spec.sources:
            s = replace(s, options=s.options | {"only_snapshot": True}) if only_snapshots and s.type == "handoff" else s
            changes = builder(SOURCES, s.type)(self.spark, s, stream)
            if stream and s.options.get("files_per_trigger"):  # a batch of few files is read by few tasks
                changes = changes.repartition(self.spark.sparkContext.defaultParallelism)
            changes = table_allowed(changes, s.tables)
            changes = apply_transformers(apply_filters(changes, self.spec.filters), self.spec.transformers)
            parts.append(changes.withColumn("topic", F.lit(s.topic)).drop("subject", "headers", "msg_id"))
        return fan_in(*parts)

    def messages(self, stream: bool = False) -> DataFrame:
        """All sources' changes as messages."""
        return to_messages(self.changes(stream), F.col("topic"))

    def log(self, stream: bool = False) -> DataFrame:
        """What sinks read: the message log, or the sources' messages where there is none."""
        if not self.spec.log:
            return self.messages(stream)
        return read_changes(self.spark, self.spec.log, stream=stream, schema=self._log_schema())

    def _log_schema(self) -> T.StructType:
        fields = [f for f in self.messages().schema if f.name not in PARTITIONS]
        return T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in PARTITIONS]])

    def index(self) -> SeekIndex:
        """The seek index of the log, kept beside the cursors: ``follow`` brings it up to date, ``page`` shows
        messages, and ``expire`` takes files off the disk that the log no longer shows."""
        if not self.spec.log:
            raise ValueError("an index needs a log")
        return SeekIndex(self.spark, f"{self.checkpoint}/_seek", self.spec.log, self._log_schema())

    def _publish(self, trigger: dict | None, only_snapshots: bool = False) -> StreamingQuery:
        changes = self.changes(True, only_snapshots)
        messages = to_messages(dedup_stream(changes, message_id(changes)), F.col("topic"))  # what follows from a change takes no part in the dedup
        return publish_log(messages, self.spec.log, f"{self.checkpoint}/_publish", trigger, self.spec.keep_days)

    def snapshots(self, trigger: dict | None = None) -> StreamingQuery:
        """Start publishing what there is before the changes of hand-offs: their snapshots, ``files_per_trigger`` files
        at a time. A restart goes on behind the last batch that is done."""
        return self._publish(trigger, only_snapshots=True)

    def publish(self, trigger: dict | None = None) -> StreamingQuery:
        """Start publishing: messages without their duplicates go to the log, which shows
        them for ``keep_days``. Snapshots of hand-offs are published whole before; the query then goes on
        from the same checkpoint, with the changes' files in view, as a log has one writer."""
        done = Marker(self.spark, f"{self.checkpoint}/_snapshots-done")
        if any(s.type == "handoff" for s in self.spec.sources) and not done.exists():
            self.snapshots().awaitTermination()
            done.set()
        query = self._publish(trigger)
        self.queries["_publish"] = query
        return query

    def add_sink(self, spec: SinkSpec, trigger: dict | None = None) -> StreamingQuery | None:
        """Start one sink; a faulty one is skipped with a warning and the others run on."""
        try:
            spec = replace(spec, batch_size=spec.batch_size or self.spec.batch_size)
            sink = builder(SINKS, spec.type)(self.spark, spec)
        except Exception as e:
            logger.warning("sink %s skipped: %s", spec.name, e)
            return None
        usual = {"processingTime": f"{spec.flush_ms or self.spec.flush_ms} milliseconds"}
        query = run_sink(self.log(stream=True), sink, self.checkpoint, trigger or usual, spec.max_retries + 1, self.spec.dlq, spec.retry_base_ms)
        self.queries[spec.name] = query
        return query

    def remove_sink(self, name: str) -> None:
        query = self.queries.pop(name, None)
        if query:
            query.stop()

    def start(self, trigger: dict | None = None) -> list[StreamingQuery]:
        if self.spec.log:
            first = self.publish(trigger or {"processingTime": f"{self.spec.flush_ms} milliseconds"})
            if trigger and "availableNow" in trigger:
                first.awaitTermination()
        return [q for q in (self.add_sink(s, trigger) for s in self.spec.sinks) if q]

    def run_once(self) -> None:
        """Process what is there now, then end."""
        for q in self.start({"availableNow": True}):
            q.awaitTermination()

    def stop(self) -> None:
        for name in list(self.queries):
            self.remove_sink(name)
