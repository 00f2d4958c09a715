"""Reading change logs and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.model import ENVELOPE


def _as_pattern(spark: SparkSession, path: str) -> str:
    """A single file as a pattern that only it matches, as streams read folders and patterns alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if files.exists(at) and files.getFileStatus(at).isFile() else path


def read_changes(
    spark: SparkSession, path: str, after: Column | None = None, stream: bool = False, schema: T.StructType = ENVELOPE, form: str = "parquet",
    files_per_trigger: int | None = None, names: str | None = None,
) -> DataFrame:
    """A change log as a table or a stream. A batch resumes by a predicate on the position,
    which Parquet's statistics prune by; a stream resumes by its checkpoint. Only files whose
    names match the pattern ``names`` are seen, if there is one."""
    reader = (spark.readStream if stream else spark.read).format(form).schema(schema)
    if names:
        reader = reader.option("pathGlobFilter", names)
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.load(_as_pattern(spark, path) if stream else path)
    return df if after is None else df.filter(after)


def read_offsets(instances: DataFrame, state: DataFrame) -> DataFrame:
    """The saved offset of each instance, empty if there is none."""
    held = state.select(F.col("instance_id").alias("_i"), F.col("offset").alias("_o"))
    return instances.join(held, F.col("instance_id") == F.col("_i"), "left").select("instance_id", F.coalesce("_o", F.lit("")).alias("offset"))


def fan_in(*logs: DataFrame) -> DataFrame:
    """One log of many; columns that some lack are null."""
    out = logs[0]
    for df in logs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
