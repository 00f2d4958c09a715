"""Decoded rows of replication feeds and polls, turned into change envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefold.functions.scalars import parse_oid


def decode_tuple(columns: Column, cells: Column) -> Column:
    """An image from a relation's columns (array of name, oid) and a tuple's cells (array of
    kind, value): text cells are parsed by type, null cells set null, unchanged cells and
    cells beyond the columns leave no entry. A null tuple gives a null image."""
    pairs = F.arrays_zip(columns.alias("c"), F.slice(cells, F.lit(1), F.least(F.size(cells), F.size(columns))).alias("v"))
    used = F.filter(pairs, lambda p: p["c"].isNotNull() & p["v"]["kind"].isin("null", "text"))
    entries = F.transform(
        used,
        lambda p: F.struct(p["c"]["name"].alias("key"), F.when(p["v"]["kind"] == "text", parse_oid(p["v"]["value"], p["c"]["oid"])["value"]).alias("value")),
    )
    return F.when(cells.isNotNull(), F.map_from_entries(entries))


def wal_rows_to_events(rows: DataFrame, relations: DataFrame, instance: str) -> DataFrame:
    """Insert, update and delete messages with old and new tuples, as envelopes. Relations
    describe tables, so they are few; rows of an unknown relation are dropped. A missing old
    tuple leaves ``before`` null."""
    latest = relations.groupBy("relation_id").agg(F.max_by(F.struct("namespace", "name", "columns"), "seen").alias("r")) if "seen" in relations.columns else relations.select("relation_id", F.struct("namespace", "name", "columns").alias("r"))
    met = rows.join(latest, "relation_id")
    op = F.element_at(F.create_map(F.lit("insert"), F.lit("c"), F.lit("update"), F.lit("u"), F.lit("delete"), F.lit("d")), F.col("kind"))
    columns = F.col("r.columns")
    return met.select(
        F.lit(instance).alias("instance_id"), F.col("r.namespace").alias("schema"), F.col("r.name").alias("tbl"), op.alias("op"), F.col("lsn").cast("string").alias("offset"), "lsn",
        F.timestamp_millis("ts").alias("ts"), decode_tuple(columns, F.col("old")).alias("before"), decode_tuple(columns, F.col("new")).alias("after"),
    )


def binlog_row_map(names: Column, values: Column) -> Column:
    """An image from column names and values, paired by place; extra ones are left out."""
    n = F.least(F.size(names), F.size(values))
    return F.map_from_arrays(F.slice(names, F.lit(1), n), F.transform(F.slice(values, F.lit(1), n), lambda v: v.cast("string")))


def binlog_rows_to_events(rows: DataFrame, instance: str) -> DataFrame:
    """Row events, as envelopes: inserts and deletes one per row; updates one per pair of rows,
    before then after; a row left without partner still gives an event, with no images."""
    row = lambda x: binlog_row_map(F.col("columns"), x)
    none = F.lit(None).cast("map<string,string>")
    n = F.size("rows")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(
        F.when(2 * i + 1 < n, row(F.try_element_at("rows", 2 * i + 1))).alias("before"), F.when(2 * i + 1 < n, row(F.try_element_at("rows", 2 * i + 2))).alias("after")))
    singles = F.transform(
        "rows",
        lambda r: F.struct(F.when(F.col("action") == "delete", row(r)).otherwise(none).alias("before"), F.when(F.col("action") == "insert", row(r)).otherwise(none).alias("after")),
    )
    images = F.when(n == 0, F.array().cast("array<struct<before:map<string,string>,after:map<string,string>>>")).when(F.col("action") == "update", pairs).otherwise(singles)
    op = F.element_at(F.create_map(F.lit("insert"), F.lit("c"), F.lit("update"), F.lit("u"), F.lit("delete"), F.lit("d")), F.col("action"))
    each = rows.withColumn("_op", op).select("*", F.posexplode(images).alias("ordinal", "_i"))
    return each.select(
        F.lit(instance).alias("instance_id"), F.col("db").alias("schema"), F.col("table").alias("tbl"), F.col("_op").alias("op"), F.concat_ws(":", "file", "pos").alias("offset"),
        F.col("pos").alias("lsn"), "ordinal", F.timestamp_seconds("ts").alias("ts"), F.col("_i.before").alias("before"), F.col("_i.after").alias("after"),
    )


def poll_rows_to_events(responses: DataFrame, instance: str, table: str) -> DataFrame:
    """Polled JSON arrays (poll_ts in ms, status, body): a create per element. Other statuses
    and bodies that are no array give nothing; see ``poll_errors``. Where responses have an
    address, it is each element's ``row_id``, so that answers of one moment stay apart."""
    items = F.from_json("body", "array<string>")
    own = [F.md5(F.col("address").cast("binary")).alias("row_id")] if "address" in responses.columns else []
    each = responses.filter("status = 200").select("poll_ts", *own, F.posexplode(items).alias("ordinal", "item"))
    return each.select(
        *["row_id"][: len(own)],
        F.lit(instance).alias("instance_id"), F.lit("public").alias("schema"), F.lit(table).alias("tbl"), F.lit("c").alias("op"), F.col("poll_ts").cast("string").alias("offset"),
        F.col("poll_ts").alias("lsn"), "ordinal", F.timestamp_millis("poll_ts").alias("ts"), F.lit(None).cast("map<string,string>").alias("before"), F.from_json("item", "map<string,string>").alias("after"),
    )


def poll_errors(responses: DataFrame) -> DataFrame:
    bad = F.when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"))).when(F.from_json("body", "array<string>").isNull(), "not an array")
    return responses.withColumn("reason", bad).filter("reason is not null")


def parse_binlog_offset(offset: Column) -> Column:
    """(file, pos) of ``file:pos``; null, which is the start, unless it has exactly these two
    parts and the second is an unsigned 32-bit integer."""
    parts = F.split(offset, ":")
    pos = F.try_element_at(parts, F.lit(2)).try_cast("bigint")
    return F.when((F.size(parts) == 2) & pos.between(0, 2**32 - 1), F.struct(F.element_at(parts, 1).alias("file"), pos.alias("pos")))
