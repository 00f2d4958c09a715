"""What messages take on the disk: between the tasks of the dedup, and in the log."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.plans.pipeline import Pipeline, PipelineSpec, SourceSpec
from changefold.streaming import log as logs

ROWS = 20_000


def one_file(spark, tmp_path):
    rows = spark.range(0, ROWS, 1, 1).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10**i)).alias(f"a_column_{i}") for i in range(1, 6)])
    rows.toPandas().to_parquet(f"{tmp_path}/t.parquet")
    return PipelineSpec([SourceSpec("crm", "snapshot", options={"path": f"{tmp_path}/t.parquet", "table": "t"})], log=f"{tmp_path}/log")


def test_a_snapshot_takes_few_bytes_in_the_log(spark, tmp_path):
    """A single file is read where it lies; identities of its rows don't fill the log."""
    spec = one_file(spark, tmp_path)
    for _ in range(2):
        Pipeline(spark, spec, f"{tmp_path}/cp").run_once()
    files = list(tmp_path.glob("log/**/*.parquet"))
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == log.select("msg_id").distinct().count() == log.select("seq").distinct().count() == ROWS
    sums = lambda df, c: df.agg(*[F.sum(c(f"a_column_{i}").cast("long")) for i in range(1, 6)]).collect()
    assert sums(log, lambda n: F.col("after")[n]) == sums(spark.read.parquet(f"{tmp_path}/t.parquet"), F.col)
    assert sum(f.stat().st_size for f in files) < 40 * ROWS
    assert all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files)


def test_numbers_follow_the_places_of_a_file(spark, tmp_path):
    got = Pipeline(spark, one_file(spark, tmp_path), f"{tmp_path}/cp").messages().orderBy("seq").select("seq", "row_id", "msg_id").collect()
    assert [int(r["row_id"].split(".")[1]) for r in got] == list(range(ROWS))
    assert got[-1]["seq"] - got[0]["seq"] == ROWS - 1 and 0 <= got[0]["seq"] and got[7]["msg_id"] == f"crm-0-public.t-{got[7]['row_id']}"


def test_blocks_of_messages_are_small(spark, tmp_path):
    messages = Pipeline(spark, one_file(spark, tmp_path), f"{tmp_path}/cp").changes().drop("before").toArrow()
    ids = [pa.array([i % 40 for i in range(ROWS)], pa.int32()), *[pa.array(range(ROWS), pa.int64())] * 4, pa.array([False] * ROWS), pa.array([7] * ROWS, pa.int64())]
    table = pa.Table.from_arrays([*[pa.chunked_array([x]) for x in ids], *messages.columns], ["m_bucket", "m_a", "m_b", "m_t", "m_tie", "m_plain", "m_arrived", *messages.column_names])
    blocks = list(logs.pack_blocks(table.to_batches()))
    assert sum(len(b.column("m_rows")[0].as_py()) for b in blocks) < 45 * ROWS
    accepted = (pa.RecordBatch.from_arrays([b.column("m_rows"), pa.array([None], pa.binary())], ["rows", "ok"]) for b in blocks)
    out = pa.Table.from_batches(logs.unpack_blocks(accepted, messages.schema))
    assert sorted(map(str, out.to_pylist())) == sorted(map(str, messages.to_pylist()))


def test_ids_take_little_more_than_their_hashes():
    rng, n = np.random.default_rng(4), 4000
    numbers = [rng.integers(-(2**62), 2**62, n), rng.integers(-(2**62), 2**62, n), np.full(n, 1_700_000_000_000_000), 2**60 + 7 * np.arange(n)]
    columns = [pa.array(np.arange(n) % 10, pa.int32()), *map(pa.array, numbers), pa.array([False] * n), pa.array([7] * n, pa.int64()), pa.array(["x"] * n)]
    blocks = list(logs.pack_blocks([pa.RecordBatch.from_arrays(columns, ["m_bucket", *logs.IDS, "m_arrived", "c0"])]))
    assert sum(len(b.column("m_ids")[0].as_py()) for b in blocks) < 21 * n


def test_all_types_pass(spark, tmp_path):
    """Types that Parquet has not come out as they went in."""
    row = (
        1, "a", dt.datetime(2024, 1, 1, 0, 0, 0, 5), 1, 2, 1.5, Decimal("12.50"), dt.date(2024, 2, 29), dt.timedelta(days=1, microseconds=3),
        dt.datetime(1969, 1, 1), [{"x": None, "y": [1, None]}], {"k": {"n": 1}}, bytearray(b"\0\xff"),
    )
    schema = (
        "seq long, msg_id string, ts timestamp, b byte, s short, f float, d decimal(9,2), day date, gap interval day to second, n timestamp_ntz, "
        "nested array<struct<x: string, y: array<int>>>, m map<string, struct<n: int>>, raw binary"
    )
    rows = spark.createDataFrame([row, (2, "b", None, *[None] * 10), (3, None, *row[2:]), row], schema).withColumn("v", F.parse_json(F.lit('{"a": [1, null]}')))
    rows.drop("gap", "v").coalesce(1).write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(rows.drop("gap", "v").schema).parquet(f"{tmp_path}/src")
    stream = stream.withColumn("gap", F.when(F.col("seq") != 2, F.make_dt_interval(F.lit(1), secs=F.lit("0.000003").cast("decimal(8,6)")))).withColumn("v", F.parse_json(F.lit('{"a": [1, null]}')))
    out = logs.dedup_stream(stream.select(*rows.columns), buckets=2)
    assert out.schema.simpleString() == rows.schema.simpleString()
    seen = []
    keep = lambda df, _: seen.extend(df.withColumn("v", F.to_json("v")).collect())
    out.writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    want = rows.withColumn("v", F.to_json("v")).collect()[:3]  # the fourth is the first again
    assert sorted(map(str, seen)) == sorted(map(str, want)) and isinstance(rows.schema["gap"].dataType, T.DayTimeIntervalType)
