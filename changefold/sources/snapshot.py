"""Snapshots of tables: as changes, in chunks, and handed over to the log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.streaming.log import assign_batches

#: Rows of a chunk, seconds after which a claim lapses.
CHUNK_ROWS, CLAIM_SECONDS = 8000, 30
#: Copies up to which equal rows are written out where they were counted.
FEW_COPIES = 8


def digest(*columns: Column) -> Column:
    """128 bits of some values, as text; null and the empty text differ."""
    return F.md5(F.to_json(F.array(*[c.cast("string") for c in columns])).cast("binary"))


def whole_row(df: DataFrame) -> list[Column]:
    """Columns that tell rows apart, those that don't cast to text as JSON."""
    plain = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, plain) else F.col(f"`{f.name}`") for f in df.schema]


def tasks_for(df: DataFrame, most: int = 400_000) -> int:
    """Tasks of which each has some ``most`` rows. A table of files tells its number of rows without being read."""
    return -(-df.count() // most) or 1


def number_copies(df: DataFrame, name: str = "row_id", most: int = 100_000) -> DataFrame:
    """The rows with a column ``name``: a digest of the row and, for equal rows, which copy it is.

    Equal rows are counted, not gathered: counts are added up before the shuffle, and a row is written out as often
    as it was counted. Rows with more than a few copies are so in runs of at most ``most``, which are dealt out
    evenly over as many tasks as the table has rows for: what a task writes out doesn't follow from the bytes of its
    runs, by which adaptive execution would put all into one.
    """
    copies = df.withColumn("_d", digest(*whole_row(df))).groupBy("_d").agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_r"), F.count("*").alias("_n"))
    few, many = copies.filter(F.col("_n") <= FEW_COPIES), copies.filter(F.col("_n") > FEW_COPIES)
    span = lambda a, b: F.explode(F.sequence(a, b))
    runs = many.select("_d", "_r", "_n", span(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / most)).alias("_run")).repartition(tasks_for(df, 4 * most))
    ends = F.least(F.col("_n"), (F.col("_run") + 1) * most) - 1
    each = few.select("_d", "_r", span(F.lit(0).cast("long"), F.col("_n") - 1).alias("_c")).unionByName(runs.select("_d", "_r", span(F.col("_run") * most, ends).alias("_c")))
    return each.select("_r.*", F.concat_ws(".", "_d", F.col("_c").cast("string")).alias(name))


def snapshot_to_events(df: DataFrame, name: str, instance: str, key: str | list[str] | None = None, row_id: Column | None = None) -> DataFrame:
    """A whole table as read events: op r, lsn 0, the row as image, and ``row_id``, which goes
    into the message id, as all rows of a snapshot share an offset. The schema is public unless the name has one.

    ``row_id`` is the given column, else a digest of the key columns' names and of the row, so that rows
    which a key that isn't one doesn't tell apart stay apart; without a key (and on a batch
    only) equal rows are numbered. A key of one whole-number column is the events' ``ordinal`` too.
    """
    schema, _, table = name.rpartition(".") if name.count(".") == 1 else ("public", "", name)
    columns, place = df.columns, []
    if isinstance(key, str) and isinstance(df.schema[key].dataType, T.IntegralType):
        place = [F.col(f"`{key}`").cast("long").alias("ordinal")]
    if row_id is not None:
        rows = df.withColumn("_row_id", row_id)
    elif key is None:
        rows = number_copies(df, "_row_id")
    else:
        keys = [key] if isinstance(key, str) else key
        rows = df.withColumn("_row_id", digest(F.lit(",".join(keys)), *[F.col(f"`{k}`") for k in keys], *whole_row(df)))
    image = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))
    return rows.select(
        F.lit(instance).alias("instance_id"), F.lit(schema).alias("schema"), F.lit(table).alias("tbl"), F.lit("r").alias("op"), F.lit("0").alias("offset"), F.lit(0).cast("long").alias("lsn"),
        *place, F.col("_row_id").alias("row_id"), F.lit(None).cast("map<string,string>").alias("before"), image.alias("after"),
    )


def place(file: Column, row: Column) -> Column:
    """Identity of a row by its file and its place there: a digest of the file, then the place. Rows that lie side by side
    have nearly the same, so messages hold it in few bytes, which a digest of each row would not allow."""
    return F.concat_ws(".", F.md5(file.cast("binary")), row.cast("string"))


def place_number(place: Column) -> Column:
    """28 bits of the file and 35 of the place, as ``seq`` of rows that have no number of their own."""
    file, row = F.pmod(F.xxhash64(F.substring(place, 1, 32)), F.lit(1 << 28)), F.substring_index(place, ".", -1)
    return F.shiftleft(file, 35) + row.cast("long")


def should_snapshot(instances: DataFrame, offsets: DataFrame) -> DataFrame:
    """Whether each instance (instance_id, mode) needs a snapshot: always does; initial, or no
    mode, does without a saved offset; any other mode doesn't. Letter case is ignored."""
    held = offsets.select(F.col("instance_id").alias("_i"), F.col("offset").alias("_o"))
    rows = instances.join(held, F.col("instance_id") == F.col("_i"), "left")
    mode = F.lower(F.coalesce("mode", F.lit("")))
    need = F.when(mode == "always", True).when(mode.isin("initial", ""), F.coalesce("_o", F.lit("")) == "").otherwise(False)
    return rows.select("instance_id", "mode", need.alias("snapshot"))


def plan_chunks(tables: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of tables (tbl, n_rows): tbl, chunk_index, chunk_start, chunk_size, is_last_chunk;
    an empty table has one empty chunk."""
    n = F.greatest(F.ceil(F.col("n_rows") / size), F.lit(1)).cast("long")
    each = tables.withColumn("_n", n).select("tbl", "n_rows", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * size
    return each.select(
        "tbl", "chunk_index", start.alias("chunk_start"), F.least(F.lit(size), F.col("n_rows") - start).cast("long").alias("chunk_size"),
        (F.col("chunk_index") == F.col("_n") - 1).alias("is_last_chunk"),
    )


def chunk_strategy(df: DataFrame, key: str) -> str:
    """The strategy of auto: ranges of an integer key, else blocks of a ctid, else offsets."""
    kind = dict(df.dtypes)[key]
    return "integer_range" if kind in ("tinyint", "smallint", "int", "bigint") else "ctid_block" if key == "ctid" else "offset"


def ctid_block(ctid: Column) -> Column:
    """The block of a row's place, written (block,item)."""
    return F.regexp_extract(ctid, r"^\((\d+),", 1).try_cast("long")


def read_chunks(df: DataFrame, key: str, width: int, strategy: str = "integer_range") -> DataFrame:
    """All rows with the chunk they belong to.

    integer_range: chunk i holds keys from i * width to below (i + 1) * width; ctid_block: the
    same with blocks; offset: chunk i holds the rows from place i * width in order of the key, which
    is a number. Ranges follow from the row alone, so no join with the plan is needed, and
    places come from counts per span, so no task orders the table.
    """
    strategy = chunk_strategy(df, key) if strategy == "auto" else strategy
    if strategy == "offset":
        return assign_batches(df, width, key).withColumnRenamed("batch", "chunk_index")
    value = {"integer_range": F.col(key), "ctid_block": ctid_block(F.col(key))}[strategy]
    return df.withColumn("chunk_index", F.floor(value / width).cast("long"))


def read_chunk(df: DataFrame, key: str, start: int, end: int | None, strategy: str = "integer_range") -> DataFrame:
    """One chunk's rows: start <= value < end, open-ended without end. The value is the key,
    which is pushed to the scan, the block of a ctid, or the place in order of the key."""
    strategy = chunk_strategy(df, key) if strategy == "auto" else strategy
    if strategy == "offset":
        placed = assign_batches(df, 1, key)
        rows = placed.filter(F.col("batch") >= start)
        return (rows if end is None else rows.filter(F.col("batch") < end)).drop("batch")
    value = {"integer_range": F.col(key), "ctid_block": ctid_block(F.col(key))}[strategy]
    rows = df.filter(value >= start)
    return rows if end is None else rows.filter(value < end)


def claimable_chunks(chunks: DataFrame, now: str, seconds: int = CLAIM_SECONDS) -> DataFrame:
    """Chunks that may be claimed, lowest first: pending ones, and those in progress whose
    heartbeat is older than the limit."""
    stale = F.col("heartbeat_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
    free = (F.col("status") == "pending") | ((F.col("status") == "in_progress") & stale)
    return chunks.filter(free).orderBy("tbl", "chunk_index")


def snapshot_progress(chunks: DataFrame) -> DataFrame:
    """Per slot: chunks in all and completed, rows processed, and whether the job is complete."""
    done = F.col("status") == "completed"
    agg = chunks.groupBy("slot_name").agg(
        F.count("*").alias("total_chunks"), F.count_if(done).alias("completed_chunks"),
        F.coalesce(F.sum("rows_processed"), F.lit(0)).cast("long").alias("rows_processed"),
    )
    return agg.withColumn("completed", (F.col("total_chunks") > 0) & (F.col("total_chunks") == F.col("completed_chunks")))


def handle_rows(df: DataFrame, handler: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """Put snapshot rows through a Python handler, a batch of rows at a time."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(handler, batches)

    return df.mapInPandas(each, schema or df.schema)


def hand_off(snapshot: DataFrame, changes: DataFrame, snapshot_lsn: int) -> DataFrame:
    """The snapshot's events, placed first, then the changes beyond its position. ``phase``
    and then lsn order them."""
    first = snapshot.withColumn("phase", F.lit(0))
    later = changes.filter(F.col("lsn") > snapshot_lsn).withColumn("phase", F.lit(1))
    return first.unionByName(later, allowMissingColumns=True)
