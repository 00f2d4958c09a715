"""What a batch costs is shared by tasks: those that write a bucket, those that read few files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.plans.pipeline import Pipeline, PipelineSpec, SourceSpec
from changefold.streaming import tables


def test_a_large_bucket_is_written_by_many_tasks(spark, tmp_path):
    table = tables.MergeTable(f"{tmp_path}/t", "id", T.StructType.fromDDL("id long, x string"), ["lsn", "seq"], buckets=1)
    rows = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("key"), F.lit("c").alias("op"), F.create_map(F.lit("x"), F.sha2(F.col("id").cast("string"), 256)).alias("image"), F.col("id").alias("lsn"), F.col("id").alias("seq"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        table.add(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(tmp_path.glob("t/data/version=000000/bucket=0/*.parquet"))) > 1
    assert table.read(spark).select("id").distinct().count() == 40_000


def test_batches_of_few_files_are_dealt_out(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("n")).coalesce(1).write.parquet(f"{tmp_path}/t")
    plan = lambda **o: Pipeline(spark, PipelineSpec([SourceSpec("i", "snapshot", options={"path": f"{tmp_path}/t", "table": "t", **o})]), f"{tmp_path}/cp").messages(True)._jdf.queryExecution().toString()
    assert "Repartition" in plan(files_per_trigger=1) and "Repartition" not in plan()
