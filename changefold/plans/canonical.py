"""Change logs and related tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefold.operators.routing import build_subject

SINKS = ("console", "search", "store")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log of accounts and purchases, three instances, keyed by user.

    Views leave ``value`` out of their image, so it is absent; every 17th event sets it null.
    """
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    value = F.when((F.col("event_id") % 17 != 0), F.col("value"))
    image = F.map_from_arrays(F.array(F.lit("id"), F.lit("k"), F.lit("value")), F.array(F.col("user_id").cast("string"), k.cast("string"), value.cast("string")))
    image = F.when(F.col("event_type") == "view", F.map_filter(image, lambda c, v: c != "value")).otherwise(image)
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    rows = e.select(
        (F.col("event_id") + 1).alias("seq"), (F.col("event_id") + 1).alias("lsn"), (F.col("event_id") + 1).cast("string").alias("offset"),
        F.concat(F.lit("inst"), (F.col("user_id") % 3).cast("string")).alias("instance_id"), F.lit("public").alias("schema"),
        F.when(F.col("event_type") == "purchase", "purchases").otherwise("accounts").alias("tbl"), op.alias("op"), F.col("user_id").alias("pk"), "ts",
        F.when(op == "d", image).alias("before"), F.when(op != "d", image).alias("after"), F.col("event_type"), k.alias("k"), F.when(F.col("event_type") != "view", value).alias("value"),
    )
    return rows.withColumn("topic", F.lit("cdc")).withColumn("subject", build_subject(F.col("topic"), F.col("instance_id"), F.col("schema"), F.col("tbl")))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery per message to two sinks: attempts, acked, time, error."""
    log = change_log(spark, sf_dir)
    rows = log.select("seq", "instance_id", "lsn", "offset", "ts", "subject", F.explode(F.array(F.lit("search"), F.lit("store"))).alias("sink"))
    attempts = (1 + (F.col("seq") - 1) % 12).cast("int")
    acked = (F.col("seq") - 1) % 7 != 0
    kind = F.element_at(F.array(F.lit("network"), F.lit("validation"), F.lit("timeout"), F.lit("schema")), (F.col("seq") % 4 + 1).cast("int"))
    rows = rows.filter((F.col("sink") == "store") | ((F.col("seq") - 1) % 5 != 0))
    return rows.withColumn("attempts", attempts).withColumn("acked", acked).withColumn("error_class", F.when(~acked, kind)).withColumn("last_attempt", F.col("ts").cast("timestamp"))
