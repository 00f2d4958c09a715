"""Filters and reshaping of change rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefold.model import HEADERS

Predicate = Callable[[DataFrame], Column] | str
Transformer = Callable[[DataFrame], DataFrame]


def table_allowed(df: DataFrame, tables: list[str]) -> DataFrame:
    """Rows whose table, bare or with its schema, is listed; an empty list passes all. The
    list is a setting, which Spark looks up as a hash set whatever its length."""
    if not tables:
        return df
    return df.filter(F.col("tbl").isin(tables) | F.concat_ws(".", "schema", "tbl").isin(tables))


def table_regex_allowed(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose ``schema.table`` is one of the names, all characters taken literally."""
    return df.filter(F.concat_ws(".", "schema", "tbl").rlike("|".join(f"^{re.escape(n)}$" for n in names)) if names else F.lit(True))


def apply_filters(df: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """Rows that pass every predicate; null counts as false."""
    tests = [F.expr(p) if isinstance(p, str) else p(df) for p in predicates]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def apply_transformers(df: DataFrame, transformers: list[Transformer]) -> DataFrame:
    """Frames put through the functions in order; a function drops rows by filtering."""
    return reduce(DataFrame.transform, transformers, df)


def subject_pattern(pattern: str) -> str:
    """Regular expression of a subject pattern: ``*`` is one token, a last ``>`` one or more."""
    tokens = pattern.split(".")
    parts = [r"[^.]+" if t == "*" else r"[^.]+(\.[^.]+)*" if t == ">" and i == len(tokens) - 1 else re.escape(t) for i, t in enumerate(tokens)]
    return "^" + r"\.".join(parts) + "$"


def subject_match(subject: Column, patterns: list[str]) -> Column:
    """Whether a subject matches any pattern; no pattern matches all."""
    return subject.rlike("|".join(map(subject_pattern, patterns))) if patterns else F.lit(True)


def subject_filter(df: DataFrame, pattern: str) -> DataFrame:
    """Rows of the log that match a pattern. Literal tokens also become equalities on the
    columns that the log is partitioned by, with dots replaced as in subjects, so that files
    of other tables aren't read. Topics and instances keep their dots, and nulls are left out,
    which shifts the tokens, so rows that have such are told by their subject alone."""
    places = ("topic", "instance_id", "schema", "tbl")
    df = df.filter(subject_match(F.col("subject"), [pattern]))
    if not set(places) <= set(df.columns):
        return df
    shifted = F.coalesce(F.contains("topic", F.lit(".")), F.lit(False)) | F.coalesce(F.contains("instance_id", F.lit(".")), F.lit(True))
    shifted = shifted | F.col("schema").isNull() | F.col("tbl").isNull()
    for place, token in zip(places, pattern.split("."), strict=False):
        if token == ">":
            break
        if token != "*":
            value = F.coalesce(F.nullif(F.col(place), F.lit("")), F.lit("cdc")) if place == "topic" else F.replace(F.col(place), F.lit("."), F.lit("_"))
            df = df.filter(shifted | (value == token))
    return df


def select_image(df: DataFrame) -> DataFrame:
    """Rows with their image: before for deletes, after for all others; without one they go."""
    return df.withColumn("image", F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))).filter("image is not null")


def rename_fields(image: Column, names: dict[str, str]) -> Column:
    """An image with keys renamed at once. A target that exists already is overwritten; names
    that map to themselves, chain into each other or share a target are refused."""
    if any(a == b for a, b in names.items()) or set(names) & set(names.values()):
        raise ValueError("renames must not chain or map a field to itself")
    if len(set(names.values())) < len(names):
        raise ValueError("renames must not share a target")
    if not names:
        return image
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    back = F.create_map(*[F.lit(x) for pair in names.items() for x in reversed(pair)])
    # a key goes if it is the target of a rename whose source is there
    stays = lambda k, v: ~F.coalesce(F.map_contains_key(image, F.coalesce(F.try_element_at(back, k), F.lit("\0"))), F.lit(False))
    return F.transform_keys(F.map_filter(image, stays), lambda k, v: F.coalesce(F.try_element_at(pairs, k), k))


def compute_fields(df: DataFrame, fields: dict[str, str], image: str = "image") -> DataFrame:
    """Set fields of the image to SQL expressions over ``data``, the image itself. All read
    the image as it was; without fields the frame stays. Texts that must fail softly use
    try_ functions."""
    if not fields:
        return df
    seen = df.withColumn("data", F.col(image))
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[F.expr(e).cast("string") for e in fields.values()]))
    old = F.map_filter(F.col(image), lambda k, v: ~k.isin(*fields))
    return seen.withColumn(image, F.map_concat(old, entries)).drop("data")


def headers_to_event(df: DataFrame) -> DataFrame:
    """The envelope without its payload; the scan never reads the images."""
    return df.select("seq", "topic", "subject", *HEADERS)


def build_envelope(df: DataFrame, connector: str, version: str = "1.0") -> DataFrame:
    """Add ``payload``: op, before, after, source and ts_ms as one struct."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    source = F.struct(
        F.lit(version).alias("version"), F.lit(connector).alias("connector"), F.col("instance_id").alias("name"), ms.alias("ts_ms"),
        F.when(F.col("op") == "r", "true").otherwise("false").alias("snapshot"), F.col("instance_id").alias("db"), F.col("schema"), F.col("tbl").alias("table"), F.col("lsn"),
    )
    return df.withColumn("payload", F.struct("op", "before", "after", source.alias("source"), ms.alias("ts_ms")))


def split_valid(df: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose payload is a JSON object with the image its op needs, as maps,
    and the others with a reason."""
    parsed = F.from_json(F.col(data), "op string, before map<string,string>, after map<string,string>", {"mode": "PERMISSIVE"})
    rows = df.withColumn("_p", F.when(F.try_parse_json(F.col(data)).isNotNull(), parsed))
    image = F.when(F.col("_p.op") == "d", F.col("_p.before")).otherwise(F.col("_p.after"))
    rows = rows.withColumn("image", image)
    good = rows.filter("image is not null").withColumn("op", F.col("_p.op")).drop("_p")
    bad = rows.filter("image is null").withColumn("reason", F.when(F.col("_p").isNull(), "bad json").otherwise("missing image")).drop("_p", "image")
    return good, bad
