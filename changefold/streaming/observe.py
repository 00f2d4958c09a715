"""Progress of streaming queries as a table: active workers, restarts, batch durations."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from changefold.operators.metrics import SECOND_BOUNDS, histogram
from changefold.plans.scratch import scratch_dir

SCHEMA = "kind string, sink string, id string, run_id string, batch long, rows long, seconds double, error string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


class ProgressTable(StreamingQueryListener):
    """Keeps what happens to queries, a row per batch, start and end, in a folder of JSON lines that
    outlives the session. The driver holds ``flush`` rows at most before it writes them, and nothing
    is dropped; a table that is begun anew on the same folder goes on with it."""

    def __init__(self, spark: SparkSession, path: str | None = None, flush: int = 1000):
        self.spark, self.path, self.flush_rows = spark, path or scratch_dir(spark, "progress-rows"), flush
        self.rows, self.names, self.lock = [], {}, threading.Lock()

    def _add(self, *row) -> None:
        with self.lock:
            self.rows.append(row)
            if len(self.rows) >= self.flush_rows:
                self._write()

    def _write(self) -> None:
        """A file, written under another name and renamed, so that no reader meets half of it."""
        if not self.rows:
            return
        fs = self.spark._jvm.org.apache.hadoop.fs
        name = f"rows-{uuid.uuid4().hex}.json"
        made, final = fs.Path(f"{self.path}/.{name}"), fs.Path(f"{self.path}/{name}")
        files = final.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(made, True)
        out.write(bytearray("".join(json.dumps(dict(zip(FIELDS, r, strict=True))) + "\n" for r in self.rows).encode()))
        out.close()
        files.rename(made, final)
        self.rows = []

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._add("start", event.name, str(event.id), str(event.runId), None, None, None, None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add("batch", p.name, str(p.id), str(p.runId), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add("end", self.names.pop(str(event.runId), None), str(event.id), str(event.runId), None, None, None, event.exception)

    def seen(self, kind: str) -> int:
        """How many rows of a kind there are."""
        return self.table(self.spark).filter(F.col("kind") == kind).count()

    def table(self, spark: SparkSession) -> DataFrame:
        """All rows; what the driver still holds is written first."""
        with self.lock:
            self._write()
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).json(self.path)


def active_workers(progress: DataFrame) -> DataFrame:
    """Per sink the runs that started and haven't ended."""
    runs = progress.groupBy("sink", "run_id").agg(F.count_if(F.col("kind") == "end").alias("ends"))
    return runs.groupBy("sink").agg(F.count_if(F.col("ends") == 0).alias("active_workers"))


def reconnects(progress: DataFrame) -> DataFrame:
    """Per sink how often its query was started again."""
    return progress.filter("kind = 'start'").groupBy("sink").agg((F.count_distinct("run_id") - 1).alias("reconnects"))


def worker_duration_histogram(progress: DataFrame) -> DataFrame:
    """Cumulative buckets of batch seconds per sink."""
    return histogram(progress.filter("kind = 'batch'"), "seconds", SECOND_BOUNDS, "sink")
