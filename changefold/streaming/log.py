"""The message log: publishing, dedup, retention, batches, retries and dead letters."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from changefold.functions.scalars import dlq_subject, msg_id
from changefold.operators.filters import Predicate, Transformer, apply_filters, apply_transformers
from changefold.operators.routing import build_subject
from changefold.plans.scratch import scratch_dir

#: Seconds in which a message id is a duplicate; days kept; retry settings.
DUPLICATE_SECONDS, KEEP_DAYS, DLQ_KEEP_DAYS = 120, 7, 30
#: Seconds for which a stream remembers an id, if no other time is named.
LAG_SECONDS = 3600
#: Folders of a log that a task writes to at once; rows of more are sorted by folder first, on the disk where they don't fit.
OPEN_FOLDERS = 4
MAX_RETRIES, BASE_MS, CAP_MS, ACK_SECONDS, MAX_DELIVERIES = 3, 100, 1000, 30, 10
PERMANENT = ("validation", "configuration", "schema", "serialization", "unsupported")
PARTITIONS = ("topic", "instance_id", "schema", "tbl")


def message_id(df: DataFrame, ordinals: tuple[str, ...] | None = None) -> Column:
    """The message id of envelopes, null where the offset is empty.

    Rows of a snapshot, a poll or a rows event share one offset. Where a row has an
    ``ordinal`` or a ``row_id``, its id therefore has its table and these in it too, unless
    ``ordinals`` names other columns (none for the bare id). A row has the same id in a union with rows of other columns.
    """
    if ordinals is not None:
        more = [F.col(o) for o in ordinals]
    else:
        own = [F.col(c) for c in ("ordinal", "row_id") if c in df.columns]
        more = [F.when(F.coalesce(*[c.cast("string") for c in own]).isNotNull(), F.concat_ws(".", "schema", "tbl")), *own] if own else []
    return msg_id(F.col("instance_id"), F.col("offset"), *more)


def to_messages(df: DataFrame, topic: str | Column = "cdc", ordinals: tuple[str, ...] | None = None) -> DataFrame:
    """Envelopes as messages: subject, headers and message id (see ``message_id``). The lsn header is there only
    if positive, offset and id only if the offset isn't empty.
    """
    rows = df.withColumn("topic", F.coalesce(F.nullif(F.lit(topic), F.lit("")), F.lit("cdc")))
    has = F.coalesce("offset", F.lit("")) != ""
    always = [x for name, c in (("instance", "instance_id"), ("schema", "schema"), ("table", "tbl"), ("op", "op")) for x in (F.lit(name), F.col(c))]
    lsn, offset = F.when(F.col("lsn") > 0, F.col("lsn").cast("string")), F.when(has, F.col("offset"))
    all_, unplaced = F.create_map(*always, F.lit("lsn"), lsn, F.lit("offset"), offset), F.create_map(*always, F.lit("offset"), offset)
    known = has & reduce(lambda a, b: a & b, [c.isNotNull() for c in always[1::2]])
    headers = F.when(known & lsn.isNotNull(), all_).when(known, unplaced).otherwise(F.map_filter(all_, lambda k, v: v.isNotNull()))  # few rows need the filter, which is slow
    rows = rows.withColumn("subject", build_subject(F.col("topic"), F.col("instance_id"), F.col("schema"), F.col("tbl")))
    rows = rows.withColumn("headers", headers)
    return rows.withColumn("msg_id", message_id(df, ordinals))


def publish_log(messages: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None, keep_days: int | None = None):
    """Append messages to the log, in folders by topic, instance, schema and table. With a
    checkpoint the frame is a stream and the started query is returned; after ``keep_days``
    the log no longer shows the files it wrote. Images are text, which zstd keeps in fewer bytes than Spark's usual codec."""
    if checkpoint is None:
        return messages.write.mode("append").option("compression", "zstd").partitionBy(*PARTITIONS).parquet(path)
    conf = messages.sparkSession.conf
    if int(conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 0:
        conf.set("spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FOLDERS))
    out = messages.writeStream.format("parquet").option("compression", "zstd").partitionBy(*PARTITIONS).option("path", path).option("checkpointLocation", checkpoint)
    if keep_days:
        out = out.option("retention", f"{keep_days}d")
    return out.trigger(**(trigger or {"availableNow": True})).start()


def dedup_messages(df: DataFrame, key: str = "msg_id", at: str = "ts", seconds: int = DUPLICATE_SECONDS, tie: str = "seq") -> DataFrame:
    """Drop messages whose id was accepted less than the window before; the window starts
    anew with each accepted message. Messages without id or time are never duplicates; of
    rows equal in id, time and ``tie`` one is accepted.

    Ids are counted first, and only those that occur more than once are kept, in a scratch
    table, and take the ordered pass, in which acceptance depends on the message before: a task
    holds one id and one time, never a group. Whole messages are met by joins with the repeated
    ids, and aren't shuffled where these are few.
    """
    slim = df.select(F.col(key).cast("string").alias("_k"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(tie).alias("_s"))
    slim = slim.filter("_k is not null and _t is not null")
    kept = scratch_dir(df.sparkSession, "repeated-ids")
    slim.groupBy("_k").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("_k").alias("_rk")).write.parquet(kept)
    repeated = df.sparkSession.read.schema("_rk string").parquet(kept)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_at = None, None
        for batch in batches:
            ok = []
            for k, t in zip(batch.column("_k").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                new = k != last_key or t - last_at >= seconds * 1_000_000
                if new:
                    last_key, last_at = k, t
                ok.append(new)
            yield batch.filter(pa.array(ok, pa.bool_()))

    near = slim.join(repeated, F.col("_k") == F.col("_rk"), "left_semi").repartition("_k").sortWithinPartitions("_k", "_t", "_s")
    accepted = near.mapInArrow(accept, near.schema).toDF("_rk", "_rt", "_rs")
    mine = df.withColumn("_k", F.col(key).cast("string")).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    timed = F.col("_t").isNotNull()
    once = mine.join(repeated, timed & (F.col("_k") == F.col("_rk")), "left_anti")
    again = mine.filter(timed).join(accepted, (F.col("_k") == F.col("_rk")) & (F.col("_t") == F.col("_rt")) & F.col(tie).eqNullSafe(F.col("_rs")), "left_semi")
    again = again.dropDuplicates(["_k", "_t", tie])
    return once.unionByName(again).select(*df.columns)


#: The columns of a block's ids: two hashes of the id, its event time in microseconds, the order of messages of one
#: time, and whether a message has no id or no time. Bytes of messages of which a task makes blocks at once.
IDS, PACK_BYTES = ("m_a", "m_b", "m_t", "m_tie", "m_plain"), 32 << 20
#: Bytes of accepted blocks that are handed on at once.
HAND_ON_BYTES = 8 << 20


def _stream_bytes(table: pa.Table) -> bytes:
    """Rows as an Arrow stream, compressed as a whole."""
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "zstd") as packed, pa.ipc.new_stream(packed, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _stream_rows(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(stream), "zstd")).read_all()


def _row_bytes(table: pa.Table) -> bytes:
    """Rows as a Parquet file: they lie on the disk between the tasks, and take a quarter of the bytes of an Arrow stream,
    which keeps where each text begins."""
    out = pa.BufferOutputStream()
    pq.write_table(table, out, compression="zstd", use_dictionary=False, write_statistics=False, store_schema=False)
    return out.getvalue().to_pybytes()


def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages as blocks, each of one bucket: its ids and, apart from these, its rows. Some megabytes are dealt out
    at once, so a task holds no more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield from _blocks(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from _blocks(pa.Table.from_batches(held))


def _blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
    order = np.argsort(table["m_bucket"].to_numpy(), kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    bucket = table["m_bucket"].to_numpy()
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    ids, rows = table.select(IDS), table.drop_columns(["m_bucket", "m_arrived", *IDS])
    for start, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
        at = slice(start, end)
        parts = [_stream_bytes(ids.slice(start, end - start)), _row_bytes(rows.slice(start, end - start))]
        yield pa.RecordBatch.from_arrays(
            [table["m_bucket"][at][:1].combine_chunks(), table["m_arrived"][at][:1].combine_chunks(), *[pa.array([x], pa.binary()) for x in parts]],
            ["m_bucket", "m_arrived", "m_ids", "m_rows"],
        )


def unpack_blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of blocks that are accepted, in batches of some thousands, with the types of ``schema`` where Parquet
    has others."""
    held, size = [], 0
    for batch in batches:
        for rows, ok in zip(batch.column("rows"), batch.column("ok"), strict=True):
            table = pq.ParquetFile(pa.BufferReader(rows.as_buffer())).read(use_threads=False)
            table = table.cast(schema) if schema else table
            if ok.is_valid:
                table = table.filter(pa.array(np.frombuffer(ok.as_buffer(), dtype=bool)))
            held.append(table)
            size += table.num_rows
            if size >= 10_000:
                yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=10_000)
                held, size = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=10_000)


def accept_ids(ids: pa.Table, known: np.ndarray, window: int) -> np.ndarray:
    """Which messages of a batch are accepted, in order of time and then of ``m_tie``, where ``known`` (two hashes of
    an id and a time) were accepted before: those that no accepted message of their id is less than the window before.

    Ids whose messages all lie in one window are decided at once, by their first; the others one by one.
    """
    a, b, t, plain = (ids[c].to_numpy() for c in ("m_a", "m_b", "m_t", "m_plain"))
    ok = plain.astype(bool)
    mine = np.flatnonzero(~ok)
    tie = pc.rank(ids["m_tie"].combine_chunks(), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    keys = [np.concatenate([known[:, i], c[mine]]) for i, c in enumerate((a, b, t))]
    at = np.concatenate([np.full(len(known), -1), mine])  # the message, or that it was accepted before
    order = np.lexsort((np.concatenate([np.zeros(len(known), np.int64), tie[mine]]), keys[2], keys[1], keys[0]))
    (a, b, t), at = (k[order] for k in keys), at[order]
    if not len(at):
        return ok
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    ends = np.r_[starts[1:], len(at)]
    wide = t[ends - 1] - t[starts] >= window
    first = at[starts]
    ok[first[first >= 0]] = True  # nothing is before it
    for start, end in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
        last = None
        for time, i in zip(t[start:end].tolist(), at[start:end].tolist(), strict=True):
            if i < 0 or last is None or time - last >= window:
                last = time
                if i >= 0:
                    ok[i] = True
    return ok


class AcceptedIds(StatefulProcessor):
    """Per bucket of ids, when each was accepted, as one block of numbers: two hashes of the id, the
    event time and the time of arrival, all in microseconds. A bucket is looked up and stored once a
    batch, whatever its ids; entries go when they arrived longer ago than ``lag``.

    Of a batch the ids alone are held in memory; the messages' blocks wait in a file."""

    def __init__(self, seconds: int, lag: int):
        self.window, self.lag = seconds * 1_000_000, lag * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("accepted", T.StructType([T.StructField("block", T.BinaryType())]))

    def _known(self, now: int) -> np.ndarray:
        block = self.held.get()[0] if self.held.exists() else b""
        known = np.frombuffer(block, dtype=np.int64).reshape(-1, 4)
        return known[known[:, 3] > now - self.lag]

    def _keep(self, known: np.ndarray, now: int) -> None:
        if len(known):
            self.held.update((np.ascontiguousarray(known).tobytes(),))
            self.handle.registerTimer((now + self.lag) // 1000 + 1)
        else:
            self.held.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tables, sizes, now = [], [], 0
        with tempfile.TemporaryFile() as file:
            for frame in rows:
                now = max(now, int(frame["m_now"].max()))
                tables += [_stream_rows(x) for x in frame["m_ids"]]
                for block in frame["m_rows"]:
                    sizes.append(file.write(block))
            known, counts, ids = self._known(now), [t.num_rows for t in tables], pa.concat_tables(tables)
            del tables
            ok = accept_ids(ids, known, self.window)
            new = ok & ~ids["m_plain"].to_numpy().astype(bool)
            if new.any():
                fresh = [ids[c].to_numpy()[new] for c in ("m_a", "m_b", "m_t")]
                self._keep(np.concatenate([known, np.column_stack([*fresh, np.full(len(fresh[0]), now)])]), now)
            del ids
            file.seek(0)
            out, held, start = [], 0, 0
            for count, size in zip(counts, sizes, strict=True):
                block, mask = file.read(size), ok[start : start + count]
                start += count
                if mask.any():
                    out.append((block, None if mask.all() else mask.tobytes()))
                    held += size
                if held >= HAND_ON_BYTES:
                    yield pd.DataFrame(out, columns=["rows", "ok"], dtype=object)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["rows", "ok"], dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        known = self._known(now)
        self.held.update((np.ascontiguousarray(known).tobytes(),)) if len(known) else self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def empty_values(schema: T.StructType) -> dict[int, Column]:
    """By place, the empty map or array for columns of such types.

    Null ones are dear on the way to Python: as the size of an Arrow batch is taken after each row, the offsets of a run of
    nulls are filled in anew for each row of it. So they travel as empty ones beside a flag.
    """
    kinds = {T.MapType: F.create_map, T.ArrayType: F.array}
    return {i: kinds[type(f.dataType)]().cast(f.dataType) for i, f in enumerate(schema) if type(f.dataType) in kinds}


def dedup_stream(
    df: DataFrame, key: str | Column = "msg_id", at: str = "ts", seconds: int = DUPLICATE_SECONDS, tie: str = "seq", lag: int = LAG_SECONDS, buckets: int = 256,
) -> DataFrame:
    """Drop messages of a stream whose id was accepted less than the window before, by event time; the
    window starts anew with each accepted message, as in ``dedup_messages``, and the results are the same
    where the messages of an id come in order of time, or in one batch.

    An id is remembered for ``lag`` seconds after a message of it was accepted, by time of arrival, so a source that lags behind
    others is never too late and none is lost; a message that comes before an accepted one in time is accepted
    unless one less than the window before it was. Messages without id or time always pass.
    State is kept by ``buckets`` of ids, 32 bytes an id; a checkpoint keeps the number that it began with. Messages travel
    as blocks by bucket: a task holds one bucket's ids of one batch, some 100 bytes each, while the messages themselves pass
    by block. So columns that follow from others are best made of what comes out, and ``key`` may be an expression. The state store is RocksDB, as such operators need.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    key = F.col(key) if isinstance(key, str) else key
    plain = key.isNull() | micros.isNull()
    empty = empty_values(df.schema)
    rows = df.select(
        F.pmod(F.xxhash64(key, F.when(plain, F.col(tie))), F.lit(buckets)).cast("int").alias("m_bucket"), F.xxhash64(key).alias("m_a"), F.xxhash64(F.lit(1), key).alias("m_b"),
        F.coalesce(micros, F.lit(0).cast("long")).alias("m_t"), F.col(tie).alias("m_tie"), plain.alias("m_plain"), F.unix_micros(F.current_timestamp()).alias("m_arrived"),
        *[(F.coalesce(F.col(f"`{f.name}`"), empty[i]) if i in empty else F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema)],
        *[F.col(f"`{df.columns[i]}`").isNull().alias(f"n{i}") for i in empty],
    )
    blocks = rows.mapInArrow(pack_blocks, "m_bucket int, m_arrived long, m_ids binary, m_rows binary")
    arrived = blocks.select("m_bucket", F.col("m_arrived").alias("m_now"), "m_ids", "m_rows", F.timestamp_micros("m_arrived").alias("_arrived")).withWatermark("_arrived", "0 seconds")
    accepted = arrived.groupBy("m_bucket").transformWithStateInPandas(AcceptedIds(seconds, max(lag, seconds)), "rows binary, ok binary", "Append", "EventTime")
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)] + [T.StructField(f"n{i}", T.BooleanType()) for i in empty]
    arrow = to_arrow_schema(T.StructType(fields))
    out = accepted.mapInArrow(lambda batches: unpack_blocks(batches, arrow), T.StructType(fields))
    return out.select(*[(F.when(~F.col(f"n{i}"), F.col(f"c{i}")) if i in empty else F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)])


def expire_log(log: DataFrame, now: str, days: int = KEEP_DAYS, at: str = "ts") -> DataFrame:
    """Messages no older than the log's age limit."""
    return log.filter(F.col(at) >= F.lit(now).cast("timestamp_ntz").cast(log.schema[at].dataType) - F.expr(f"interval {days} days"))


def assign_batches(df: DataFrame, size: int, order: str = "seq", span: int = 1_000_000) -> DataFrame:
    """Number the rows' micro-batches of ``size`` rows in order.

    Rows are counted per span of the order column, spans are summed up, and rows are ranked
    within their span, so no task orders the whole log.
    """
    slot = F.floor(F.col(order) / span)
    counts = df.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n"))
    base = counts.select(F.col("_slot").alias("_b"), (F.sum("_n").over(W.orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    ranked = df.withColumn("_slot", slot).withColumn("_r", F.row_number().over(W.partitionBy("_slot").orderBy(order)))
    out = ranked.join(base, F.col("_slot") == F.col("_b"))
    return out.withColumn("batch", F.floor((F.col("_base") + F.col("_r") - 1) / size).cast("long")).drop("_slot", "_b", "_base", "_r")


def classify_error(kind: Column) -> Column:
    """Whether a failure may be retried: permanent kinds may not, network and unknown ones may."""
    return ~F.coalesce(F.lower(kind).isin(*PERMANENT), F.lit(False))


class DeliveryError(Exception):
    """A failed delivery of a known kind, one of PERMANENT or any other."""

    def __init__(self, message: str, kind: str):
        super().__init__(message)
        self.kind = kind


def error_kind(error: Exception) -> str:
    """The kind of an error: its own, or schema for what Spark can't resolve."""
    return getattr(error, "kind", "schema" if isinstance(error, AnalysisException) else "unknown")


def route_failures(deliveries: DataFrame, max_retries: int = MAX_DELIVERIES) -> DataFrame:
    """Add ``route`` to failed deliveries: dlq at the retry limit or beyond, else redeliver."""
    return deliveries.withColumn("route", F.when(F.col("attempts") >= max_retries, "dlq").otherwise("redeliver"))


def retry_delay_ms(attempt: Column, base: int = BASE_MS, factor: float = 2.0, cap: int = CAP_MS) -> Column:
    """Delay before the next attempt, growing by the factor up to the cap; attempts count from 1."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt - 1), F.lit(float(cap)))


def retry_schedule(failures: DataFrame, base: int = BASE_MS, factor: float = 2.0, cap: int = CAP_MS, jitter: bool = False) -> DataFrame:
    """Add ``delay_ms``; with jitter, a hash of the row adds up to half of it."""
    delay = retry_delay_ms(F.col("attempts"), base, factor, cap)
    extra = F.pmod(F.xxhash64("seq", "attempts"), F.lit(1000)) / 2000 * delay if jitter else F.lit(0.0)
    return failures.withColumn("delay_ms", delay + extra)


def pending_redelivery(deliveries: DataFrame, now: str, ack_wait: int = ACK_SECONDS, max_deliveries: int = MAX_DELIVERIES) -> DataFrame:
    """Deliveries neither acknowledged nor out of tries whose wait is over."""
    due = F.col("last_attempt") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ack_wait))
    return deliveries.filter(~F.col("acked") & (F.col("attempts") < max_deliveries) & due)


def dead_letters(failed: DataFrame, reason: Column, now: Column | None = None) -> DataFrame:
    """Failed messages with reason, original subject, dead-letter subject and time; the
    envelope and its id stay."""
    return failed.withColumn("reason", reason).withColumn("original_subject", F.col("subject")).withColumn("dlq_subject", dlq_subject(F.col("subject"))).withColumn("dlq_ts", now if now is not None else F.current_timestamp())


def write_dlq(failed: DataFrame, path: str, reason: Column) -> None:
    dead_letters(failed, reason).write.mode("append").parquet(path)


def first_dead_letters(dlq: DataFrame, n: int = 100) -> DataFrame:
    """The first n dead letters by seq, which is the report itself."""
    return dlq.orderBy("seq").limit(n)


def reprocess_dlq(
    dlq: DataFrame, predicates: list[Predicate] = (), transformers: list[Transformer] = (), decodable: Column | None = None,
    valid: Callable[[DataFrame], Column] | None = None, first: int = 100,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(replayed, left, ended) of the first dead letters: those that filters and transformers
    pass and that are valid again; those that stay; those that can't be decoded and go.

    A letter is known by its sink and message id, if there are such columns, and its seq."""
    key = [c for c in ("sink", "msg_id") if c in dlq.columns] + ["seq"]
    batch = dlq.orderBy("seq", *key[:-1]).limit(first)
    decodable = decodable if decodable is not None else F.coalesce("before", "after").isNotNull()
    ended = batch.filter(~F.coalesce(decodable, F.lit(False)))
    alive = batch.filter(F.coalesce(decodable, F.lit(False)))
    replayed = apply_transformers(apply_filters(alive, list(predicates)), list(transformers))
    if valid is not None:
        replayed = replayed.filter(F.coalesce(valid(replayed), F.lit(False)))
    gone = replayed.select(*key).unionByName(ended.select(*key)).toDF(*[f"_{c}" for c in key])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return replayed, dlq.join(gone, same, "left_anti"), ended


def save_offsets(state: DataFrame, new: DataFrame) -> DataFrame:
    """Offsets per sink and instance: the new ones, and those of others."""
    return state.join(new, ["sink", "instance_id"], "left_anti").unionByName(new.select(*state.columns))


def source_offsets(state: DataFrame) -> DataFrame:
    """Per instance the least position that all its sinks have reached."""
    return state.groupBy("instance_id").agg(F.min("lsn").alias("lsn"))
