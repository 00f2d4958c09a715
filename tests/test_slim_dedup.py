"""What takes part in the dedup of streams, and in what form."""

from pyspark.sql import functions as F

from changefold.model import ENVELOPE
from changefold.plans import pipeline
from changefold.sources.changes import fan_in
from changefold.streaming import log as logs


def envelopes(spark):
    rows = [
        (1, "cdc", "", "i", "s.x", "t", "c", "1", 1, None, None, {"id": "1", "v": None}),
        (2, "cdc", "", "i", "s", "t", "d", "2", 2, None, {}, None),
        (3, "cdc", "", "i", "s", "u", "d", None, 0, None, {"id": "2"}, {}),
    ]
    return spark.createDataFrame(rows, ENVELOPE)


def test_what_follows_from_a_change_takes_no_part(spark, tmp_path, monkeypatch):
    envelopes(spark).write.parquet(f"{tmp_path}/src")
    seen, dedup = [], logs.dedup_stream
    monkeypatch.setattr(pipeline, "dedup_stream", lambda df, *a, **k: seen.append(df.columns) or dedup(df, *a, **k))
    sources = [pipeline.SourceSpec("i", options={"path": f"{tmp_path}/src"}, topic=t) for t in ("", "own")]
    pipe = pipeline.Pipeline(spark, pipeline.PipelineSpec(sources, log=f"{tmp_path}/log"), f"{tmp_path}/cp")
    pipe.run_once()
    assert len(seen) == 1 and not {"subject", "headers", "msg_id"} & set(seen[0])
    got = spark.read.parquet(f"{tmp_path}/log")
    want = fan_in(*[logs.to_messages(envelopes(spark), t) for t in ("", "own")])
    text = lambda df: sorted(str(r) for r in df.select(*sorted(want.columns)).collect())
    assert text(got) == text(want) == text(pipe.messages())


def test_ids_are_the_same_in_a_union(spark):
    plain = envelopes(spark)
    placed, numbered = plain.withColumn("row_id", F.lit("r")), plain.withColumn("ordinal", F.lit(5).cast("long")).withColumn("row_id", F.lit(None).cast("string"))
    one = fan_in(*[df.withColumn("want", logs.message_id(df)) for df in (plain, placed, numbered)])
    assert one.count() == 9 and one.filter(~F.col("want").eqNullSafe(logs.message_id(one))).count() == 0


def test_null_maps_and_arrays_travel_as_empty_ones(spark, tmp_path):
    rows = envelopes(spark).withColumn("msg_id", F.col("seq").cast("string")).withColumn("a.b", F.when(F.col("seq") < 3, F.array(F.nullif("seq", F.lit(1)))))
    rows = rows.withColumn("ts", F.timestamp_seconds("seq"))
    rows.write.parquet(f"{tmp_path}/src")
    out = logs.dedup_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/src"))
    plan = out._jdf.queryExecution().logical().toString()
    assert all(f"coalesce({c}" in plan for c in ("before", "after")) and out.schema.simpleString() == rows.schema.simpleString()
    logs.publish_log(out, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    text = lambda df: sorted(str(r) for r in df.select(*[F.col(f"`{c}`") for c in rows.columns]).collect())
    assert text(spark.read.parquet(f"{tmp_path}/log")) == text(rows)
