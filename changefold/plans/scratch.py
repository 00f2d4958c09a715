"""Folders for what a job keeps between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Where the session names none, a
    local master gets a temporary folder; a cluster, whose executors would each write to a
    disk of their own, is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``scratch_root``."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


class Marker:
    """An empty file that says that something is done."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.files.exists(self.path)

    def set(self) -> None:
        self.files.create(self.path, True).close()
