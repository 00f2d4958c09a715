"""Dead letters on files: replays that end letters once, and free what they took.

Sinks write letters to folders of their own (sink, query, batch). A pointer, moved last, names
which of these a replay has taken, what is left of them, and the replay that is under way. A
replay is staged before the pointer moves and delivered after, under its number; one that broke off is
delivered again from what was staged. So a crash neither loses a letter nor ends it twice, if a delivery
may be repeated under its number, as that of a sink may.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changefold.operators.filters import Predicate, Transformer
from changefold.streaming.log import reprocess_dlq


class DeadLetters:
    """The letters below ``path``, the ``dlq`` of a pipeline or a sink. One replay at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str, prefix: str) -> list[str]:
        files, path = self._at(name)
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(x for x in found if x.startswith(prefix))

    def _delete(self, name: str) -> None:
        files, path = self._at(name)
        files.delete(path, True)

    def pointer(self) -> dict:
        for name in reversed(self._names("_replays", "pointer=")):
            files, done = self._at(f"_replays/{name}/_SUCCESS")
            if files.exists(done):
                return json.loads(self.spark.read.text(f"{self.path}/_replays/{name}").collect()[0][0])
        return {"version": 0, "number": 0, "taken": [], "left": [], "under_way": None}

    def _move(self, at: dict) -> dict:
        at = at | {"version": at["version"] + 1}
        line = self.spark.createDataFrame([(json.dumps(at),)], "value string").coalesce(1)
        line.write.mode("overwrite").text(f"{self.path}/_replays/pointer={at['version']:012d}")
        for name in self._names("_replays", "pointer=")[:-2]:
            self._delete(f"_replays/{name}")
        return at

    def _folders(self, at: dict) -> list[str]:
        """The folders of letters that count."""
        found = [f"{s}/{q}/{b}" for s in self._names("", "sink=") for q in self._names(s, "query=") for b in self._names(f"{s}/{q}", "batch=")]
        whole = [f for f in found if f not in at["taken"] and self._at(f"{f}/_SUCCESS")[0].exists(self._at(f"{f}/_SUCCESS")[1])]
        return whole + at["left"]

    def _read(self, folders: list[str]) -> DataFrame | None:
        """Letters of folders, each with the sink in its path and the ``_folder`` it is in."""
        frames = []
        for f in folders:
            rows = self.spark.read.parquet(f"{self.path}/{f}")
            rows = rows if "sink" in rows.columns else rows.withColumn("sink", F.lit(f.split("/")[0].removeprefix("sink=")))
            frames.append(rows.withColumn("_folder", F.lit(f)))
        out = frames[0] if frames else None
        for rows in frames[1:]:
            out = out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        """The letters that are left; None if there never was one."""
        rows = self._read(self._folders(self.pointer()))
        return rows.drop("_folder") if rows is not None else None

    def replay(
        self, deliver: Callable[[DataFrame, int], None], predicates: list[Predicate] = (), transformers: list[Transformer] = (),
        valid: Callable[[DataFrame], Column] | None = None, first: int = 100,
    ) -> int:
        """Deliver the first letters that pass, as ``reprocess_dlq`` tells; the number of this replay.
        Folders that letters were taken from are rewritten, and no others."""
        at = self.pointer()
        if at["under_way"] is not None:
            at = self._finish(at, deliver)
        rows = self._read(self._folders(at))
        if rows is None:
            return at["number"]
        number = at["number"] + 1
        replayed, left, _ = reprocess_dlq(rows, predicates, transformers, valid=valid, first=first)
        order = [c for c in ("sink", "msg_id") if c in rows.columns]
        touched = sorted(r[0] for r in rows.orderBy("seq", *order).limit(first).select("_folder").distinct().collect())
        replayed.drop("_folder").write.mode("overwrite").parquet(f"{self.path}/_replays/staged={number}")
        left.filter(F.col("_folder").isin(touched)).drop("_folder").write.mode("overwrite").parquet(f"{self.path}/_replays/left={number}")
        rest = [f for f in at["left"] if f not in touched] + [f"_replays/left={number}"]
        at = self._move(at | {"number": number, "taken": at["taken"] + [f for f in touched if f not in at["left"]], "left": rest, "under_way": touched})
        self._finish(at, deliver)
        return number

    def _finish(self, at: dict, deliver: Callable[[DataFrame, int], None]) -> dict:
        """Deliver what is staged, and delete it and the folders whose letters went or were rewritten."""
        staged = f"_replays/staged={at['number']}"
        deliver(self.spark.read.parquet(f"{self.path}/{staged}"), at["number"])
        touched = at["under_way"]
        at = self._move(at | {"under_way": None})
        for name in [*touched, staged]:
            self._delete(name)
        return at
