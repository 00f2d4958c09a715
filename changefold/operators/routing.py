"""Subjects, targets, keys and ids of change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_NAMES = ("id", "ID", "uuid", "uid", "guid")


def build_subject(topic: Column, instance: Column, schema: Column, table: Column) -> Column:
    """``topic.instance.schema.table``; an empty topic is cdc; dots inside schema and table
    become underscores, so that each stays one token."""
    plain = lambda c: F.replace(c, F.lit("."), F.lit("_"))
    return F.concat_ws(".", F.coalesce(F.nullif(topic, F.lit("")), F.lit("cdc")), instance, plain(schema), plain(table))


def route_target(df: DataFrame, mapping: DataFrame | dict[str, str] | None = None, fixed: str | None = None, prefix: str | None = None) -> DataFrame:
    """Add ``target``: the mapping of instance.table, else of table, else the fixed name, else
    prefix + instance_table with dots replaced, or the bare table without a prefix.

    A mapping given as a frame (name, to) is joined twice, in whatever way Spark picks;
    otherwise it becomes a literal map.
    """
    usual = F.concat(F.lit(prefix), F.replace(F.concat_ws("_", "instance_id", "tbl"), F.lit("."), F.lit("_"))) if prefix is not None else F.col("tbl")
    last = F.lit(fixed) if fixed else usual
    both = F.concat_ws(".", "instance_id", "tbl")
    if isinstance(mapping, DataFrame):
        one, two = mapping.toDF("_n1", "_t1"), mapping.toDF("_n2", "_t2")
        joined = df.join(one, both == F.col("_n1"), "left").join(two, F.col("tbl") == F.col("_n2"), "left")
        return joined.withColumn("target", F.coalesce("_t1", "_t2", last)).drop("_n1", "_t1", "_n2", "_t2")
    if not mapping:
        return df.withColumn("target", last)
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn("target", F.coalesce(F.try_element_at(pairs, both), F.try_element_at(pairs, F.col("tbl")), last))


def value_fields(image: Column, fields: list[str]) -> Column:
    """What a record is stored as: all of it as JSON (no field, or ``*``), one field's bare
    value, or JSON of those fields that it has."""
    if not fields or fields == ["*"]:
        return F.to_json(image)
    if len(fields) == 1:
        return F.try_element_at(image, F.lit(fields[0]))
    return F.to_json(F.map_filter(image, lambda k, v: k.isin(fields)))


def extract_id(image: Column) -> Column:
    """The record's id: the first of id, ID, uuid, uid, guid that it has."""
    return F.coalesce(*[F.try_element_at(image, F.lit(n)) for n in ID_NAMES])


def bytes_id(raw: Column) -> Column:
    """Text of an id given as bytes: 16 bytes as a dashed UUID, others as hex."""
    text = F.lower(F.hex(raw))
    return F.when(F.octet_length(raw) == 16, F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(text)


def build_key(df: DataFrame, expression: str | None = None, prefix: str = "cdc", image: str = "image") -> DataFrame:
    """Add ``key``: a SQL expression over ``data`` (the image), or where it is absent or null
    ``prefix:instance:table:id``, with the offset for a missing id."""
    usual = F.concat_ws(":", F.lit(prefix), "instance_id", "tbl", F.coalesce(extract_id(F.col(image)), F.col("offset")))
    if not expression:
        return df.withColumn("key", usual)
    return df.withColumn("data", F.col(image)).withColumn("key", F.coalesce(F.expr(expression).cast("string"), usual)).drop("data")


def status_filter(log: DataFrame, floor: DataFrame, status: str = "all") -> DataFrame:
    """Messages by whether a consumer is past them. ``floor`` has one row, ack_floor."""
    if status == "all":
        return log
    # one row, by contract of consumer_info
    joined = log.join(F.broadcast(floor.select(F.col("ack_floor").alias("_floor"))))
    test = {"sent": F.col("seq") <= F.col("_floor"), "unsent": F.col("seq") > F.col("_floor")}[status]
    return joined.filter(test).drop("_floor")
