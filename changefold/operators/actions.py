"""What sinks would do, as tables: lines, rows, index actions, commands, posts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefold.functions.scalars import sanitize_doc
from changefold.operators.routing import extract_id

#: Bytes of a request, if no other bound is named.
REQUEST_BYTES = 5 << 20


def payload_size(before: Column, after: Column) -> Column:
    """Bytes of the images as JSON."""
    return F.octet_length(F.coalesce(F.to_json(before), F.lit(""))) + F.octet_length(F.coalesce(F.to_json(after), F.lit("")))


def console_lines(df: DataFrame) -> DataFrame:
    """One line per change: instance, op, schema, table, lsn, offset and payload size."""
    return df.select(
        "seq",
        F.format_string(
            "[%s] %s %s.%s lsn=%d offset=%s size=%d", "instance_id", "op", "schema", "tbl", "lsn", "offset",
            payload_size(F.col("before"), F.col("after")).cast("long"),
        ).alias("line"),
    )


def append_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows to append per ``target``: the image's columns, typed; absent ones are null; a
    delete appends its image before."""
    return df.select("seq", "target", "op", *[F.try_element_at(F.col("image"), F.lit(c)).try_cast(t).alias(c) for c, t in columns.items()])


def image_columns(df: DataFrame) -> list[str]:
    """Names of all image columns of a batch; they are few, being columns of tables."""
    return sorted(r[0] for r in df.select(F.explode(F.map_keys("image"))).distinct().collect())


def bulk_actions(df: DataFrame, clean: bool = False) -> DataFrame:
    """Actions of a document index: seq, action, target, doc_id, doc.

    A change with an id indexes under it, one without adds a document, a delete with an id
    deletes and one without does nothing.
    """
    doc = sanitize_doc(F.col("image")) if clean else F.col("image")
    rows = df.withColumn("doc_id", extract_id(F.col("image"))).withColumn("action", F.when(F.col("op") == "d", "delete").otherwise("index"))
    rows = rows.filter("action = 'index' or doc_id is not null")
    return rows.select("seq", "action", "target", "doc_id", F.when(F.col("action") == "index", doc).alias("doc"))


def bulk_text(actions: DataFrame) -> DataFrame:
    """Actions as lines of newline-delimited JSON: a head, and for index a document."""
    head = F.to_json(F.create_map("action", F.struct(F.col("target").alias("_index"), F.col("doc_id").alias("_id"))))
    return actions.select("seq", "target", "doc_id", F.concat_ws("\n", head, F.to_json("doc")).alias("value"))


def pack_requests(
    rows: DataFrame, size: int, max_bytes: int, order: list[str], by: list[Column] | None = None, frame: tuple[str, str, str] = ("", "\n", "\n"),
) -> DataFrame:
    """Pack the texts ``value`` into requests: task, request (from 0 in each task), n, bytes, value.

    A request has at most ``size`` texts and ``max_bytes`` bytes, with what ``frame`` puts before, between
    and after them; a text that is longer is a request of its own. Rows are packed where they
    are, in ``order`` within their partition, or dealt by ``by`` first, so that what shares
    these columns is posted in order by one task. A task holds one request, whatever its rows; rows without text are left out.
    """
    begin, between, end = (f.encode() for f in frame)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, parts, held, done, waiting = TaskContext.get().partitionId(), 0, [], len(begin) + len(end), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if parts and (len(parts) >= size or held + len(between) + len(text) > max_bytes):
                    done.append((task, made, len(parts), held, begin + between.join(parts) + end))
                    waiting += held
                    made, parts, held = made + 1, [], len(begin) + len(end)
                    if waiting >= max_bytes:
                        yield _requests(done)
                        done, waiting = [], 0
                held += len(text) + (len(between) if parts else 0)
                parts.append(text)
        if parts:
            done.append((task, made, len(parts), held, begin + between.join(parts) + end))
        if done:
            yield _requests(done)

    rows = rows.filter("value is not null")
    rows = rows.repartition(*by) if by else rows
    return rows.sortWithinPartitions(*order).select("value").mapInArrow(pack, "task int, request long, n long, bytes long, value string")


def _requests(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], ["task", "request", "n", "bytes", "value"])


def bulk_requests(actions: DataFrame, size: int = 100, max_bytes: int = REQUEST_BYTES) -> DataFrame:
    """Requests of at most ``size`` actions and ``max_bytes`` bytes (see ``pack_requests``). Actions on
    one document are in one task, in order of seq; new documents without an id go anywhere."""
    return pack_requests(bulk_text(actions), size, max_bytes, ["seq"], [F.col("target"), F.coalesce("doc_id", F.col("seq").cast("string"))])


def bulk_item_errors(responses: DataFrame) -> DataFrame:
    """Failed items of index responses: action, doc_id, status, type, reason."""
    item = "struct<_index:string,_id:string,status:int,error:struct<type:string,reason:string>>"
    parsed = responses.select(F.from_json("body", f"errors boolean, items array<map<string,{item}>>").alias("r")).filter("r.errors")
    each = parsed.select(F.explode("r.items").alias("i")).select(F.explode("i").alias("action", "x")).filter("x.error is not null")
    return each.select("action", F.col("x._id").alias("doc_id"), F.col("x.status").alias("status"), F.col("x.error.type").alias("type"), F.col("x.error.reason").alias("reason"))


def kv_commands(df: DataFrame, command: str = "hset", ttl: int = 0, value: Column | None = None) -> DataFrame:
    """Commands of a key-value store: seq, command, key, args, ttl.

    Upserts follow the setting: set stores a value, sadd and bf_add (or bf.add) add a member,
    hset, and any other name, sets fields. A delete removes the member for sadd, does nothing
    for bf_add, and else drops the key. ``value`` is what set, sadd and bf_add store. A ttl
    counts if positive, and not for deletes.
    """
    name = command.lower()
    value = value if value is not None else F.to_json("image")
    kind = {"set": "SET", "sadd": "SADD", "bf_add": "BF.ADD", "bf.add": "BF.ADD"}.get(name, "HSET")
    gone = F.col("op") == "d"
    rows = df.filter(~gone) if name == "bf_add" else df
    drop = "SREM" if name == "sadd" else "DEL"
    one = F.create_map(F.lit("value" if kind == "SET" else "member"), value)
    args = F.when(gone, one if drop == "SREM" else F.create_map().cast("map<string,string>")).otherwise(F.col("image") if kind == "HSET" else one)
    return rows.select("seq", F.when(gone, drop).otherwise(kind).alias("command"), "key", args.alias("args"), F.when(~gone & F.lit(ttl > 0), F.lit(ttl)).alias("ttl"))


def webhook_batches(df: DataFrame, size: int = 100, include_payload: bool = False, max_bytes: int = REQUEST_BYTES, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Posts of at most ``size`` changes and ``max_bytes`` bytes, as JSON arrays (see
    ``pack_requests``): the changes of a partition, in ``order``."""
    fields = ["instance_id", "schema", F.col("tbl").alias("table"), "op", "offset", "lsn", *(["before", "after"] if include_payload else [])]
    return pack_requests(df.select(*order, F.to_json(F.struct(*fields)).alias("value")), size, max_bytes, [*order], frame=("[", ",", "]"))


def failed_batches(posts: DataFrame) -> DataFrame:
    """Posts whose status is outside 200 to 299."""
    return posts.filter(~F.coalesce(F.col("status").between(200, 299), F.lit(False)))


def infer_sink_schema(df: DataFrame, data: str = "data") -> DataFrame:
    """Column types of each target from JSON records: target, column, type (BOOLEAN, DOUBLE
    PRECISION, TEXT or JSONB); where values differ in type, the widest that holds all."""
    kinds = df.select("target", F.try_parse_json(data).alias("v")).select("target", F.explode(F.map_entries(F.expr("try_cast(v as map<string, variant>)"))).alias("e"))
    kind = F.schema_of_variant("e.value")
    ranked = F.when(kind == "BOOLEAN", 1).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), 2).when(kind == "STRING", 3).when(kind.rlike("^(OBJECT|ARRAY)"), 4).otherwise(0)
    wide = kinds.select("target", F.col("e.key").alias("column"), ranked.alias("k")).groupBy("target", "column").agg(F.collect_set("k").alias("ks"))
    ks = F.array_remove("ks", 0)
    name = F.element_at(F.array(F.lit("BOOLEAN"), F.lit("DOUBLE PRECISION"), F.lit("TEXT"), F.lit("JSONB")), F.element_at(ks, 1))
    return wide.select("target", "column", F.when(F.size(ks) == 1, name).otherwise("TEXT").alias("type"))


def table_ddl(columns: DataFrame, key: str = "id") -> DataFrame:
    """(target, ddl) for each target of ``infer_sink_schema``."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(quote(F.col("column")), F.lit(" "), F.col("type"), F.when(F.col("column") == key, " PRIMARY KEY").otherwise(""))
    cols = columns.groupBy("target").agg(F.sort_array(F.collect_list(line)).alias("c"))
    return cols.select("target", F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), quote(F.col("target")), F.lit(" ("), F.array_join("c", ", "), F.lit(")")).alias("ddl"))

