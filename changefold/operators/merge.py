"""Folding a change log into current tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.model import OPS


def split_ops(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, rejected): rows by whether their op is one of c, u, d, r."""
    known = F.coalesce(F.col("op").isin(*OPS), F.lit(False))
    return df.filter(known), df.filter(~known).withColumn("reason", F.lit("unknown op"))


def split_keyless(df: DataFrame, keys: dict[str, str] | None = None, default: str = "id", kind: str = "string") -> tuple[DataFrame, DataFrame]:
    """(keyed, dead): rows with ``key``, the image's value of the table's key column as the
    given type, and rows that have none or one that doesn't cast."""
    name = F.lit(default)
    if keys:
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in keys.items() for x in pair]), F.col("tbl")), name)
    rows = df.withColumn("key", F.try_element_at(F.col("image"), name).try_cast(kind))
    return rows.filter("key is not null"), rows.filter("key is null").drop("key").withColumn("reason", F.lit("missing key"))


def latest_rows(changes: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """Current rows of a log whose changes carry whole records: the last change of each key,
    unless it is a delete. One shuffle, reduced before it."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*position)).alias("_last"))
    return last.select(*key, "_last.*").filter("op <> 'd'")


def fold(changes: DataFrame, columns: list[str], position: list[str]) -> DataFrame:
    """One row per key: key, gone (position of the last delete), alive (position of the last
    other change) and, per column, its last value set and where, as (at, value).

    Every column is decided by one pass of partial aggregates: a value set before the last
    delete is told from one set after it by its position, so no second look is needed.
    """
    at = F.struct(*position)
    live = F.col("op") != "d"

    def last(c: str) -> Column:
        return F.max(F.when(live & F.map_contains_key("image", F.lit(c)), F.struct(at.alias("at"), F.col("image")[c].alias("value")))).alias(f"_{c}")

    return changes.groupBy("key").agg(F.max(F.when(~live, at)).alias("gone"), F.max(F.when(live, at)).alias("alive"), *[last(c) for c in columns])


def merge_folds(folds: DataFrame) -> DataFrame:
    """One row per key of several folds: everything in a fold is a maximum, so folds add up."""
    return folds.groupBy("key").agg(*[F.max(c).alias(c) for c in folds.columns if c != "key"])


def apply_changes(changes: DataFrame, base: DataFrame, key: str, position: list[str]) -> DataFrame:
    """Apply a log to a table: c, u and r set the columns that their image has, d removes the
    record, in the order of ``position``; later changes of a removed record start afresh.

    ``changes``: key, op, image, position columns; rows without image, key or known op must
    have been split off, and keys must cast to the type in ``base``. The result has the columns
    and types of ``base``; values that don't cast give null. The key is cast before the fold, so
    that the join finds both sides dealt by it: the changes are shuffled once, reduced before,
    and the base once.
    """
    columns = [c for c in base.columns if c != key]
    return apply_fold(fold(changes.withColumn("key", F.col("key").cast(dict(base.dtypes)[key])), columns, position), base, key)


def apply_fold(folded: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Apply a fold, one row per key, to a table."""
    types = dict(base.dtypes)
    both = base.join(folded.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "full")
    dead = F.col("gone").isNotNull() & (F.col("alive").isNull() | (F.col("alive") < F.col("gone")))

    def value(c: str) -> Column:
        cell = F.col(f"_{c}")
        is_set = cell.isNotNull() & (F.col("gone").isNull() | (cell["at"] > F.col("gone")))
        return F.when(is_set, cell["value"].try_cast(types[c])).when(F.col("gone").isNull(), F.col(c)).alias(c)

    return both.filter(~dead).select(F.coalesce(F.col(key), F.col("_key")).alias(key), *[value(c) for c in base.columns if c != key])


def live_rows(folded: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """The rows that a fold, one row per key, leaves of nothing, typed as the table is."""
    dead = F.col("gone").isNotNull() & (F.col("alive").isNull() | (F.col("alive") < F.col("gone")))
    cell = lambda c: F.when(F.col("gone").isNull() | (F.col(f"_{c}")["at"] > F.col("gone")), F.col(f"_{c}")["value"])
    return folded.filter(~dead).select(*[
        F.col("key").cast(f.dataType).alias(f.name) if f.name == key else cell(f.name).try_cast(f.dataType).alias(f.name) for f in schema
    ])


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Whole records of ``rows`` replace or join those of ``base``."""
    kept = base.join(rows.select(key).distinct(), key, "left_anti")
    return kept.unionByName(rows.select(*base.columns))


def delete_keys(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(key).distinct(), key, "left_anti")


def missing_tables(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """Target names that are no table yet."""
    return targets.select("target").distinct().join(existing.select(F.col("name").alias("target")), "target", "left_anti")


def kv_entries(commands: DataFrame) -> DataFrame:
    """What the commands of ``kv_commands`` leave in a key-value store, a row per entry: key,
    kind, field, value. A string has one entry without field, a hash one per field, a set one
    per member, which is the field.

    A key's state follows its last del and the kind that was written last: strings keep the
    last value, hashes merge fields, sets hold what was added and not removed after. Entries are
    folded one by one, so no key is gathered.
    """
    kind = F.when(F.col("command") == "SET", "string").when(F.col("command") == "HSET", "hash").when(F.col("command").isin("SADD", "SREM"), "set")
    keys = commands.groupBy("key").agg(F.max(F.when(F.col("command") == "DEL", F.col("seq"))).alias("_cut"), F.max_by("command", "seq").alias("_last"))
    keys = keys.filter("_last <> 'DEL'").select(
        F.col("key").alias("_k"), "_cut", F.when(F.col("_last") == "SET", "string").when(F.col("_last") == "HSET", "hash").otherwise("set").alias("_kind"),
    )
    pairs = F.when(kind == "hash", F.col("args")).otherwise(F.create_map(
        F.when(kind == "set", F.col("args")["member"]).otherwise(F.lit("")), F.when(kind == "string", F.col("args")["value"]),
    ))
    each = commands.filter("command <> 'DEL'").select("key", "seq", "command", kind.alias("kind"), F.explode(pairs).alias("field", "value"))
    last = each.groupBy("key", "kind", "field").agg(F.max_by(F.struct("command", "value"), "seq").alias("e"), F.max("seq").alias("at"))
    met = last.join(keys, (F.col("key") == F.col("_k")) & (F.col("kind") == F.col("_kind"))).filter("(_cut is null or at > _cut) and e.command <> 'SREM'")
    return met.select("key", "kind", F.when(F.col("kind") != "string", F.col("field")).alias("field"), "e.value")


def kv_state(commands: DataFrame) -> DataFrame:
    """``kv_entries`` with the fields (sorted, as text) and members (sorted) of each key
    together: key, kind, value, fields, members. For keys that fit in a row."""
    packed = kv_entries(commands).groupBy("key", "kind").agg(F.sort_array(F.collect_list(F.struct(F.col("field").alias("f"), F.col("value").alias("v")))).alias("_e"))
    of = lambda k, c: F.when(F.col("kind") == k, c)
    return packed.select("key", "kind", of("string", F.col("_e")[0]["v"]).alias("value"), of("hash", F.col("_e")).alias("fields"), of("set", F.col("_e.f")).alias("members"))
