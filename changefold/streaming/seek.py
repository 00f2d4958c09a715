"""A seek index of a log on files: deep pages read a few spans, and expired files leave the disk.

The index counts messages by topic, subject and span of sequence numbers, in levels. A span of a
level is ``2^STEP`` spans of the one below; the lowest, of ``2^LEAF`` numbers, also tell the files that hold them
and the newest time in each. Rows are only added: a batch of the log adds its counts under its
number, and a file that goes adds its counts with the sign turned. So readers sum up, and a batch or an
expiry that is done again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from changefold.operators.filters import subject_match
from changefold.plans.scratch import Marker

#: Bits of a number within its lowest span; bits of a span within the next level's; levels. The
#: highest has at most 4,096 spans, as numbers have 64 bits, and every other 1,024 in a span above.
LEAF, STEP, LEVELS = 12, 10, 5
COUNTS = "level int, node long, topic string, subject string, file string, newest timestamp, n long"


def span_of(seq: Column, level: int) -> Column:
    return F.shiftright(seq.cast("long"), LEAF + STEP * level)


def with_levels(leaves: DataFrame) -> DataFrame:
    """Lowest counts and the higher ones that follow from them."""
    higher = leaves.select(F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("node", STEP * i).alias("node")) for i in range(1, LEVELS)])).alias("s"), "topic", "subject", "n")
    sums = higher.groupBy("s.level", "s.node", "topic", "subject").agg(F.sum("n").alias("n"))
    return leaves.unionByName(sums.filter("n <> 0"), allowMissingColumns=True).select(*[f.split()[0] for f in COUNTS.split(", ")])


class SeekIndex:
    """The index at ``path`` of the log at ``log``, whose messages have at least seq, topic, subject and ts.

    Messages without a number have no place: they are in no page. One query follows a log."""

    def __init__(self, spark: SparkSession, path: str, log: str, schema: T.StructType, compact: int = 32):
        self.spark, self.path, self.log, self.schema, self.compact = spark, path.rstrip("/"), log.rstrip("/"), schema, compact

    # --- files -------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self) -> list[str]:
        files, at = self._fs(self.path)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def _done(self, name: str) -> bool:
        return Marker(self.spark, f"{self.path}/{name}/_SUCCESS").exists()

    def _base(self) -> dict:
        """The newest whole base: its name, the last batch in it, the expiries in it."""
        for name in reversed([x for x in self._names() if x.startswith("base-")]):
            if self._done(f"{name}/holds"):
                return json.loads(self.spark.read.text(f"{self.path}/{name}/holds").collect()[0][0]) | {"name": name}
        return {"name": None, "epoch": -1, "gone": [], "number": -1}

    def _parts(self, base: dict) -> list[str]:
        """Parts that are not in the base."""
        batches = [x for x in self._names() if x.startswith("batch-") and int(x.split("-")[1]) > base["epoch"]]
        gone = [x for x in self._names() if x.startswith("gone-") and x not in base["gone"]]
        return [x for x in batches + gone if self._done(x)]

    def counts(self) -> DataFrame:
        """All counts, which readers sum up."""
        base = self._base()
        paths = [f"{self.path}/{x}" for x in ([f"{base['name']}/counts"] if base["name"] else []) + self._parts(base)]
        return self.spark.read.schema(COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], COUNTS)

    def _write(self, leaves: DataFrame, name: str) -> None:
        """In order of span, so that a step down reads the row groups of its spans alone."""
        with_levels(leaves).repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.mode("overwrite").parquet(f"{self.path}/{name}")

    # --- writing -----------------------------------------------------------------------

    def add(self, rows: DataFrame, epoch: int) -> None:
        """Count a batch of the log (seq, topic, subject, ts, file); a batch that is in the index stays as it is."""
        if epoch <= self._base()["epoch"] or self._done(f"batch-{epoch:012d}"):
            return
        keyed = rows.filter("seq is not null").withColumn("node", span_of(F.col("seq"), 0))
        leaves = keyed.groupBy("node", "topic", "subject", "file").agg(F.max(F.col("ts").cast("timestamp")).alias("newest"), F.count("*").alias("n"))
        self._write(leaves.withColumn("level", F.lit(0)), f"batch-{epoch:012d}")
        if len(self._parts(self._base())) >= self.compact:
            self.fold()

    def follow(self, trigger: dict | None = None) -> StreamingQuery:
        """Index what is new in the log: a query whose checkpoint is kept with the index, as its batches number the parts."""
        stream = self.spark.readStream.schema(self.schema).parquet(self.log)
        rows = stream.select("seq", "topic", "subject", "ts", F.col("_metadata.file_path").alias("file"))
        return rows.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.path}/_cursor").trigger(**(trigger or {"availableNow": True})).start()

    def fold(self) -> None:
        """Sum all parts up in a new base. What the last base replaced is deleted, no sooner, for readers."""
        self._sweep()  # before the names of expired files go
        base, names = self._base(), self._names()
        parts = self._parts(base)
        for x in names:
            old = x.startswith("base-") and x != base["name"] or x.startswith("batch-") and int(x.split("-")[1]) <= base["epoch"] or x in base["gone"]
            if old:
                files, at = self._fs(f"{self.path}/{x}")
                files.delete(at, True)
        left = self.counts().filter("level = 0").groupBy("node", "topic", "subject", "file").agg(F.max("newest").alias("newest"), F.sum("n").alias("n")).filter("n <> 0")
        name = f"base-{base['number'] + 1:012d}"
        self._write(left.withColumn("level", F.lit(0)), f"{name}/counts")
        epochs = [int(x.split("-")[1]) for x in parts if x.startswith("batch-")]
        # expiries that are on the disk and in this base; older ones were deleted above
        holds = {"epoch": max([base["epoch"], *epochs]), "gone": [x for x in parts if x.startswith("gone-")], "number": base["number"] + 1}
        self.spark.createDataFrame([(json.dumps(holds),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}/holds")

    # --- retention ---------------------------------------------------------------------

    def expired(self, now: str, days: int) -> DataFrame:
        """Files (file) of the log all of whose messages are older than ``days``. Files that a message
        without time is in stay, as do those that the log's own list of files still names."""
        held = self.counts().filter("level = 0").groupBy("file", "node").agg(F.max("newest").alias("newest"), F.max(F.col("newest").isNull()).alias("open"), F.sum("n").alias("n"))
        ages = held.filter("n <> 0").groupBy("file").agg(F.max("newest").alias("newest"), F.max("open").alias("open"))
        old = ages.filter(~F.col("open") & (F.col("newest") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))).select("file")
        listed = self._listed()
        return old.join(listed, F.regexp_replace("file", "^file:/+", "/") == F.col("_listed"), "left_anti") if listed is not None else old

    def _listed(self) -> DataFrame | None:
        """Files that the list kept by a streaming writer names; None if the log has no such list."""
        files, at = self._fs(f"{self.log}/_spark_metadata")
        if not files.exists(at):
            return None
        names = [s.getPath().getName() for s in files.listStatus(at)]
        whole = [int(x.split(".")[0]) for x in names if x.endswith(".compact")]
        last = max(whole, default=-1)
        kept = [x for x in names if x.endswith(".compact") and int(x.split(".")[0]) == last or x.isdigit() and int(x) > last]
        if not kept:
            return None
        # as lines of an RDD, because frames can't be read from folders that begin with an underscore
        found = self.spark.sparkContext.textFile(",".join(f"{self.log}/_spark_metadata/{x}" for x in kept)).map(lambda line: (line,))
        lines = self.spark.createDataFrame(found, "value string").filter("value like '{%'")
        plain = F.url_decode(F.replace(F.get_json_object("value", "$.path"), F.lit("+"), F.lit("%2B")))
        return lines.select(F.regexp_replace(plain, "^file:/+", "/").alias("_listed"))

    def expire(self, now: str, days: int) -> int:
        """Take expired files out of the index, then off the disk; how many. Broken off in between, files are
        in no page and only take room: the next call deletes what earlier expiries name."""
        name = f"gone-{uuid.uuid4().hex}"
        held = self.counts().filter("level = 0").join(self.expired(now, days), "file", "left_semi")
        turned = held.groupBy("node", "topic", "subject", "file").agg(F.max("newest").alias("newest"), (-F.sum("n")).alias("n")).filter("n <> 0")
        if not turned.isEmpty():
            self._write(turned.withColumn("level", F.lit(0)), name)
        return self._sweep()

    def _sweep(self) -> int:
        """Delete the files of all expiries that are still on the disk. Names come to the driver one after the other."""
        deleted = 0
        for part in [x for x in self._names() if x.startswith("gone-") and self._done(x)]:
            for row in self.spark.read.schema(COUNTS).parquet(f"{self.path}/{part}").filter("level = 0").select("file").distinct().toLocalIterator():
                files, at = self._fs(row["file"])
                deleted += bool(files.delete(at, False))
        return deleted

    # --- reading -----------------------------------------------------------------------

    def _matching(self, topic: str | None, subject: str | None) -> DataFrame:
        rows = self.counts()
        rows = rows if topic is None else rows.filter(F.col("topic") == topic)
        return rows if subject is None else rows.filter(subject_match(F.col("subject"), [subject]))

    @staticmethod
    def _within(level: int, parent: int) -> Column:
        """Rows of the spans of a level in one span of the level above."""
        return (F.col("level") == level) & F.col("node").between(parent << STEP, ((parent + 1) << STEP) - 1)

    def _find(self, rows: DataFrame, *ranks: int) -> list[tuple[int, int]]:
        """(lowest span, messages before it) of the messages with these ranks from 0, which exist. Each step
        brings the counts of at most 1,024 spans a rank to the driver, the first of 4,096."""
        at: list[tuple[int | None, int]] = [(None, 0) for _ in ranks]
        for level in reversed(range(LEVELS)):
            here = reduce(lambda x, y: x | y, [F.col("level") == level if node is None else self._within(level, node) for node, _ in at])
            spans = sorted((r["node"], r["n"]) for r in rows.filter(here).groupBy("node").agg(F.sum("n").alias("n")).filter("n > 0").collect())
            at = [self._step(spans, above, before, rank) for (above, before), rank in zip(at, ranks, strict=True)]
        return at

    @staticmethod
    def _step(spans: list[tuple[int, int]], above: int | None, before: int, rank: int) -> tuple[int, int]:
        for node, n in spans:
            if above is None or node >> STEP == above:
                if before + n > rank:
                    return node, before
                before += n
        raise LookupError(f"no message has rank {rank}")

    def _messages(self, rows: DataFrame, low: int, high: int, topic: str | None, subject: str | None) -> DataFrame:
        """Matching messages of the lowest spans from ``low`` to ``high`` that hold any, from the files that hold them."""
        held = rows.filter((F.col("level") == 0) & F.col("node").between(low, high)).groupBy("node", "file").agg(F.sum("n").alias("n")).filter("n > 0").collect()
        if not held:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).option("basePath", self.log).parquet(*sorted({r["file"] for r in held}))
        ranges: list[list[int]] = []
        for node in sorted({r["node"] for r in held}):
            if ranges and ranges[-1][1] == node - 1:
                ranges[-1][1] = node
            else:
                ranges.append([node, node])
        found = found.filter(reduce(lambda a, b: a | b, [F.col("seq").between(a << LEAF, ((b + 1) << LEAF) - 1) for a, b in ranges]))
        found = found if topic is None else found.filter(F.col("topic") == topic)
        return found if subject is None else found.filter(subject_match(F.col("subject"), [subject]))

    def _up_to(self, rows: DataFrame, floor: int, topic: str | None, subject: str | None) -> int:
        """Matching messages numbered ``floor`` or less: whole spans by their counts, one lowest span by its messages."""
        nodes = [floor >> (LEAF + STEP * level) for level in range(LEVELS)]
        whole = (F.col("level") == LEVELS - 1) & (F.col("node") < nodes[-1])
        for level in range(LEVELS - 1):
            whole |= (F.col("level") == level) & (F.col("node") >= nodes[level + 1] << STEP) & (F.col("node") < nodes[level])
        n = rows.filter(whole).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
        return n + self._messages(rows, nodes[0], nodes[0], topic, subject).filter(F.col("seq") <= floor).count()

    def page(
        self, limit: int = 20, page: int = 1, topic: str | None = None, subject: str | None = None, status: str = "all", floor: int | None = None,
        newest: bool = False, most: int = 100,
    ) -> DataFrame:
        """The page of ``explorer.list_messages`` in order of seq, or with the ``newest`` first, at the cost of the
        spans it is in. ``status`` is relative to the acknowledged ``floor``; ``most`` caps a page, as there.
        Messages with one number are in order of subject and of message id, if they have one. Other orders need ``list_messages``."""
        limit, page = max(1, min(limit, most)), max(1, page)
        rows = self._matching(topic, subject)
        first, end = 0, rows.filter(F.col("level") == LEVELS - 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
        if status != "all":
            first, end = {"sent": lambda n: (0, n), "unsent": lambda n: (n, end)}[status](self._up_to(rows, floor, topic, subject))
        low = max(first, end - page * limit) if newest else first + (page - 1) * limit
        high = end - (page - 1) * limit if newest else min(end, low + limit)
        if low >= high:
            return self.spark.createDataFrame([], self.schema)
        (at, before), (last, _) = self._find(rows, low, high - 1)
        order = ["seq", "subject", *[c for c in ("msg_id",) if c in self.schema.names]]
        found = self._messages(rows, at, last, topic, subject).orderBy(*order).offset(low - before).limit(high - low)
        return found.orderBy(*[F.col(c).desc() for c in order]) if newest else found
