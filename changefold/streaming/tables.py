"""Current tables as folds on files: merged when read, compacted bucket by bucket.

A row of a fold is a key with the position of its last delete, of its last other change and,
per column, the last value set and where. All of these are maxima, so folds add up in any
order: which change counts is decided by positions, never by the order of arrival, and
deletes stay as rows of their own (tombstones) for changes that come late.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.model import ENVELOPE
from changefold.operators.merge import fold, live_rows, merge_folds


class MergeTable:
    """A table of ``schema`` with one row per ``key``, in ``buckets`` by the key's hash.

    Each bucket has a base and deltas of its own. A batch adds deltas to the buckets it
    touches. Where a bucket's deltas reach ``share`` of its base, both become a new base, and
    where they are ``compact`` many but few in rows, they become one delta; other buckets
    stay as they are. So what a batch costs follows the batch: per changed row, about 1 / ``share``
    rows are rewritten in time. A pointer, moved last, names the files
    that count and the last batch of each query. Files that it no longer names are deleted
    at the next batch, so that readers of the pointer before can end.

    With ``evolve`` the schema follows the changes: a field that no column has becomes a column, and a column
    whose values don't cast becomes as wide as they need (integers, numbers, truth values, then text). Folds
    hold text, so that no row is rewritten for it; ``alterations`` tells what changed and when.

    A bucket is written by as many tasks as its size needs (adaptive execution splits it, and puts small ones
    into one task). One writer at a time.
    """

    def __init__(self, path: str, key: str, schema: T.StructType, position: list[str], buckets: int = 16, compact: int = 8, share: float = 0.25, evolve: bool = False):
        self.evolve = evolve
        self.path, self.key, self.schema, self.position = path, key, schema, position
        self.buckets, self.compact, self.share = buckets, compact, share

    # --- files -------------------------------------------------------------------------

    def _at(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _delete(self, spark: SparkSession, name: str) -> None:
        files, path = self._at(spark, name)
        files.delete(path, True)

    def _pointers(self, spark: SparkSession) -> list[str]:
        files, root = self._at(spark, "")
        found = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted(x for x in found if x.startswith("pointer="))

    def pointer(self, spark: SparkSession) -> dict:
        """The state that counts: version, buckets, the folds' schema, ``parts`` (per bucket a base
        and deltas, each as version and rows), ``done`` (last batch by query), ``dropped``."""
        for name in reversed(self._pointers(spark)):
            files, done = self._at(spark, f"{name}/_SUCCESS")
            if files.exists(done):
                return json.loads(spark.read.text(f"{self.path}/{name}").collect()[0][0])
        return {"version": -1, "buckets": self.buckets, "schema": None, "parts": {}, "done": {}, "dropped": [], "columns": self.schema.json(), "alterations": []}

    def _write(self, folded: DataFrame, version: str, buckets: int) -> dict[str, int]:
        """Write folds by bucket; how many rows each bucket that has any got."""
        path = f"{self.path}/data/version={version}"
        dealt = folded.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        dealt.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        counts = folded.sparkSession.read.schema(T.StructType([*folded.schema, T.StructField("bucket", T.IntegerType())])).parquet(path).groupBy("bucket").count()
        return {str(r[0]): r[1] for r in counts.collect()}  # a row per bucket

    def _folds(self, spark: SparkSession, at: dict, names: list[tuple[str, str]]) -> DataFrame:
        """The folds at (bucket, version) places."""
        schema = T.StructType.fromJson(json.loads(at["schema"]))
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in names]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    # --- reading -----------------------------------------------------------------------

    def read(self, spark: SparkSession) -> DataFrame:
        """The current rows. Buckets without deltas aren't shuffled."""
        at = self.pointer(spark)
        schema = T.StructType.fromJson(json.loads(at["columns"]))
        if not at["schema"]:
            return spark.createDataFrame([], schema)
        clean = [(b, p["base"][0]) for b, p in at["parts"].items() if p["base"] and not p["deltas"]]
        mixed = [(b, v) for b, p in at["parts"].items() if p["deltas"] for v, _ in [*([p["base"]] if p["base"] else []), *p["deltas"]]]
        rows = [self._folds(spark, at, clean), *([merge_folds(self._folds(spark, at, mixed))] if mixed else [])]
        return live_rows(reduce(DataFrame.unionByName, rows), schema, self.key)

    def alterations(self, spark: SparkSession) -> DataFrame:
        """(version, column, type, ddl) for each column that a batch added or widened."""
        rows = [(v, c, t, f"ALTER TABLE ADD COLUMN `{c}` {t}" if new else f"ALTER TABLE ALTER COLUMN `{c}` TYPE {t}") for v, c, t, new in self.pointer(spark)["alterations"]]
        return spark.createDataFrame(rows, "version long, column string, type string, ddl string")

    # --- writing -----------------------------------------------------------------------

    def seed(self, rows: DataFrame) -> None:
        """Begin with the rows of a table: they have no position, so that every change comes
        after them. Only for a table that has nothing yet."""
        spark, at = rows.sparkSession, self.pointer(rows.sparkSession)
        if at["schema"]:
            raise ValueError(f"{self.path} has rows already")
        kind = position_type(self.position)
        none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind])
        cells = [F.struct(none.alias("at"), F.col(c).cast("string").alias("value")).alias(f"_{c}") for c in self.schema.names if c != self.key]
        folded = rows.select(F.col(self.key).alias("key"), F.lit(None).cast(kind).alias("gone"), none.alias("alive"), *cells)
        got = self._write(folded, "000000", at["buckets"])
        parts = {b: {"base": ["000000", n], "deltas": []} for b, n in got.items()}
        self._move(spark, at, at | {"version": 0, "schema": folded.schema.json(), "parts": parts})

    def add(self, changes: DataFrame, query: str = "batch", epoch: int | None = None) -> None:
        """Add a batch: key, op, image and position columns, as ``apply_changes`` takes them. A
        batch of a query that is done already changes nothing."""
        spark = changes.sparkSession
        at = self.pointer(spark)
        if epoch is not None and at["done"].get(query, -1) >= epoch:
            return
        for name in at["dropped"]:
            self._delete(spark, name)
        version = at["version"] + 1
        schema, altered = T.StructType.fromJson(json.loads(at["columns"])), []
        if self.evolve:
            schema, altered = widened(schema, changes, self.key)
        columns = [c for c in schema.names if c != self.key]
        typed = {"key": F.col("key").cast(self.schema[self.key].dataType)} | {f.name: F.col(f.name).cast(f.dataType) for f in position_type(self.position)}
        folded = fold(changes.withColumns(typed), columns, self.position)
        evolved = {"columns": schema.json(), "alterations": at["alterations"] + [[version, *a] for a in altered]}
        new = at | evolved | {"version": version, "schema": folded.schema.json(), "done": at["done"] | ({query: epoch} if epoch is not None else {})}
        parts = {b: {"base": p["base"], "deltas": [*p["deltas"]]} for b, p in at["parts"].items()}
        for b, n in self._write(folded, f"{version:06d}", at["buckets"]).items():
            parts.setdefault(b, {"base": None, "deltas": []})["deltas"].append([f"{version:06d}", n])
        self._compact(spark, new, parts, f"{version:06d}m")
        self._move(spark, at, new | {"parts": parts})

    def _compact(self, spark: SparkSession, at: dict, parts: dict, version: str) -> None:
        """Rewrite the buckets that are due, and only these."""
        whole, deltas = [], []
        for b, p in parts.items():
            n, held = sum(r for _, r in p["deltas"]), p["base"][1] if p["base"] else 0
            if n and (len(p["deltas"]) >= self.compact if not p["base"] else n >= self.share * held):
                whole.append(b)
            elif len(p["deltas"]) >= self.compact:
                deltas.append(b)
        names = [(b, v) for b in whole + deltas for v, _ in parts[b]["deltas"]] + [(b, parts[b]["base"][0]) for b in whole if parts[b]["base"]]
        if not names:
            return
        got = self._write(merge_folds(self._folds(spark, at, names)), version, at["buckets"])
        for b in whole:
            parts[b] = {"base": [version, got[b]], "deltas": []}
        for b in deltas:
            parts[b]["deltas"] = [[version, got[b]]]

    def _move(self, spark: SparkSession, at: dict, new: dict) -> None:
        """Move the pointer; what it names no longer is deleted at the next batch."""
        old_names, names = _names(at["parts"]), _names(new["parts"])
        gone = {v for _, v in old_names} - {v for _, v in names}
        new["dropped"] = [f"data/version={v}" for v in sorted(gone)] + [f"data/version={v}/bucket={b}" for b, v in sorted(old_names - names) if v not in gone]
        line = spark.createDataFrame([(json.dumps(new),)], "value string").coalesce(1)
        line.write.mode("overwrite").text(f"{self.path}/pointer={new['version']:012d}")
        for name in self._pointers(spark)[:-2]:
            self._delete(spark, name)


def position_type(position: list[str]) -> T.StructType:
    """The type of a position."""
    return T.StructType([T.StructField(p, ENVELOPE[p].dataType if p in ENVELOPE.names else T.LongType()) for p in position])


#: Types of columns from narrow to wide; a truth value and a number have only text above them.
WIDER = {"bigint": {"bigint", "double", "string"}, "double": {"double", "string"}, "boolean": {"boolean", "string"}, "string": {"string"}}


def widened(schema: T.StructType, changes: DataFrame, key: str) -> tuple[T.StructType, list[tuple[str, str, bool]]]:
    """(schema, altered): a schema that holds the fields of a batch's images, and (column, type, whether it is
    new) for what differs. One pass over the batch; a row per field comes back, and fields are few, being columns of tables.

    A field gets the narrowest type that all of its values cast to; a declared column of another type than these is
    widened to text if one of its values doesn't cast. A field that is null everywhere is text.
    """
    cells = changes.filter("image is not null").select(F.explode("image").alias("c", "v")).filter(F.col("c") != key)
    declared = {f.name: f for f in schema}
    fits = [F.every(F.col("v").isNull() | F.col("v").try_cast(t).isNotNull()).alias(t) for t in ("bigint", "double", "boolean")]
    own = [F.every(F.col("v").isNull() | (F.col("c") != f.name) | F.col("v").try_cast(f.dataType).isNotNull()).alias(f"own{i}") for i, f in enumerate(schema)]
    fields, altered = {f.name: f.dataType for f in schema}, []
    for row in sorted(cells.groupBy("c").agg(F.count("v").alias("n"), *fits, *own).collect()):
        c, held = row["c"], fields.get(row["c"])
        if held is not None and (not row["n"] or row[f"own{schema.names.index(c)}"]):
            continue
        narrow = {t for t in WIDER if row["n"] and (t == "string" or row[t])} | {"string"}
        known = WIDER.get(held.simpleString(), {"string"}) if held is not None else set(WIDER)
        kind = next(t for t in ("bigint", "double", "boolean", "string") if t in narrow & known)
        fields[c] = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}[kind]
        altered.append((c, kind, c not in declared))
    return T.StructType([T.StructField(n, t) for n, t in fields.items()]), altered


def _names(parts: dict) -> set[tuple[str, str]]:
    return {(b, v) for b, p in parts.items() for v, _ in [*([p["base"]] if p["base"] else []), *p["deltas"]]}
