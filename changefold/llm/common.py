"""Helpers shared by the training-data operators: tables, scratch space, hashed words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where the session
    names none, a local master gets a temporary one; a cluster, whose executors would
    each write to a disk of their own, is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder, in folders of the column ``by``, and read it back:
    cuts the lineage, survives lost executors, and keeps one computation where a result is
    used several times."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that ``saved`` has made and ``settled`` hasn't deleted.
_MADE: list[str] = []


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Save what ``make`` gives, and delete the tables that were saved on the way to it."""
    before = len(_MADE)
    done = saved(make(), label)
    for path in _MADE[before:-1]:
        delete(spark, path)
    del _MADE[before:-1]
    return done


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a frame that may be broadcast.
MOST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds."""
    total = F.lit(0).cast("long")
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            size = F.aggregate(c, F.lit(0), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0)))
        elif isinstance(kind, T.ArrayType):
            size = F.size(c) * 8
        else:
            size = F.lit(0)
        total = total + 16 + F.greatest(F.lit(0), F.coalesce(size, F.lit(0)))
    return total


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = MOST_BYTES) -> DataFrame:
    """Hint a broadcast only if the frame, which must be saved already, has few rows and
    bytes; otherwise Spark picks a shuffled join."""
    first = df.limit(max_rows + 1)
    n, size = first.agg(F.count("*"), F.sum(row_bytes(first))).collect()[0]
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the fast byte-wise path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# --- hashed words in numpy -------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def chunks(texts: list, limit: int = 1 << 20):
    """Split a list of texts (str or None) into runs of about ``limit`` bytes, as
    (first index, list of bytes); bounds the arrays that numpy makes at once."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if run and size + len(data) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(data)
        size += len(data) + 1
    if run:
        yield start, run


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts hold about ``limit`` bytes; a longer text is a run
    of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(sizes, (int(sizes[start - 1]) if start else 0) + limit, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of several texts at once: their hashes and the text each belongs to.

    A word is a run of bytes other than ASCII white space, A-Z lower-cased. Words are
    hashed to 64 bits by a sum of bytes times position-dependent odd random values.
    """

    def __init__(self, run: list[bytes]):
        joined = b"\n".join(run) + b"\n"
        buf = _FOLD[np.frombuffer(joined, dtype=np.uint8)]
        self.n_texts = len(run)
        self.bytes = buf
        word = ~_IS_SPACE[buf]
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lens = ends - starts
        self.starts, self.lens = starts, lens
        lengths = np.array([len(x) + 1 for x in run], dtype=np.int64)
        self.text_ends = np.cumsum(lengths)
        self.text = np.searchsorted(self.text_ends, starts, side="right")
        self.counts = np.bincount(self.text, minlength=self.n_texts)
        if len(starts):
            offs = np.cumsum(lens) - lens
            pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(offs, lens)
            rand = mix64((np.arange(1, int(lens.max()) + 1, dtype=np.uint64)) * _STEP) | np.uint64(1)
            parts = (buf[word].astype(np.uint64) + np.uint64(1)) * rand[pos]
            self.hash = mix64(np.add.reduceat(parts, offs) + lens.astype(np.uint64) * _STEP)
        else:
            self.hash = np.empty(0, dtype=np.uint64)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words and the text each is in, repeats included. A text
        of fewer words, but not none, gives its whole sequence as one."""
        h, text = self.hash, self.text
        firsts = np.cumsum(self.counts) - self.counts
        if len(h) >= n:
            acc = np.zeros(len(h) - n + 1, dtype=np.uint64)
            for k in range(n):
                acc = mix64(acc + h[k : len(h) - n + 1 + k] + _STEP)
            inside = text[: len(h) - n + 1] == text[n - 1 :]
            long_h, long_t = acc[inside], text[: len(h) - n + 1][inside]
        else:
            long_h, long_t = np.empty(0, dtype=np.uint64), np.empty(0, dtype=text.dtype)
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if not len(short):
            return long_h, long_t
        acc = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            has = self.counts[short] > k
            at = np.where(has, firsts[short] + k, 0)
            acc = np.where(has, mix64(acc + h[at] + _STEP), acc)
        return np.concatenate([long_h, mix64(acc + _M2)]), np.concatenate([long_t, short])
