"""Pages by the seek index against sorted listings; expiry of files."""

import datetime as dt
import random

import pytest

from changefold.plans.pipeline import Pipeline, PipelineSpec, SourceSpec
from changefold.streaming import log as logs
from changefold.streaming.seek import SeekIndex

SCHEMA = "seq long, ts timestamp_ntz, subject string, topic string"


def start(spark, tmp_path, **kw):
    return SeekIndex(spark, f"{tmp_path}/index", f"{tmp_path}/log", spark.createDataFrame([], SCHEMA).schema, **kw)


def write(spark, index, rows, files=2):
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(files, "seq").write.mode("append").partitionBy("topic").parquet(index.log)
    index.follow().awaitTermination()


def message(rng, seq, day=1):
    topic = rng.choice(["a", "b"])
    return seq, dt.datetime(2024, 1, day), f"{topic}.{rng.choice('xyz')}.{rng.choice('pq')}.t", topic


def listing(rows, topic=None, tail=None, keep=lambda seq: True):
    return sorted((r[0], r[2]) for r in rows if r[0] is not None and (topic is None or r[3] == topic) and (tail is None or r[2].split(".")[2] == tail) and keep(r[0]))


def got(frame):
    return [(r["seq"], r["subject"]) for r in frame.collect()]


def test_pages_equal_the_sorted_listing(spark, tmp_path):
    """Numbers from both ends of 64 bits, close and far apart, repeated ones and nulls; batches in no order; folds between."""
    rng = random.Random(3)
    index, rows = start(spark, tmp_path, compact=3), []
    seqs = [-(2**63), -1, 0, 2**63 - 1, *range(4000, 4200), *(rng.randrange(2**40) for _ in range(80)), *(rng.randrange(-(2**20), 2**20) for _ in range(80)), 4096, 4096]
    rng.shuffle(seqs)
    for i in range(4):
        new = [message(rng, s) for s in seqs[i::4]] + [(None, dt.datetime(2024, 1, 1), "a.x.p.t", "a")]
        rows += new
        write(spark, index, new)
    assert any(n.startswith("base-") for n in index._names())
    everything = listing(rows)
    for limit, page in ((20, 1), (7, 30), (20, len(everything) // 20 + 1), (20, 100), (1000, 2)):
        size = min(limit, 100)
        assert got(index.page(limit, page)) == everything[(page - 1) * size : page * size]
    for page in (1, 6, 19, 20):
        assert got(index.page(20, page, newest=True)) == everything[::-1][(page - 1) * 20 : page * 20]
    some = listing(rows, "a", "p")
    for page in (1, 4):
        assert got(index.page(10, page, topic="a", subject="a.*.p.t")) == some[(page - 1) * 10 : page * 10]
    for floor in (-(2**63), 4100, 2**62):
        assert got(index.page(15, 2, subject="*.*.q.t", status="sent", floor=floor)) == listing(rows, tail="q", keep=lambda s, f=floor: s <= f)[15:30]
        assert got(index.page(15, 2, status="unsent", floor=floor)) == listing(rows, keep=lambda s, f=floor: s > f)[15:30]
    assert got(index.page(topic="none")) == []


def test_an_index_without_batches_has_empty_pages(spark, tmp_path):
    assert got(start(spark, tmp_path).page()) == []


def test_a_repeated_batch_counts_once_also_after_a_fold(spark, tmp_path):
    rng = random.Random(5)
    index = start(spark, tmp_path)
    rows = [message(rng, s) for s in range(50)]
    write(spark, index, rows)
    batch = spark.createDataFrame([(*r, "f") for r in rows], f"{SCHEMA}, file string")
    index.add(batch, 0)
    index.fold()
    index.add(batch, 0)
    index.fold()
    assert not [n for n in index._names() if n.startswith("batch-")]
    assert got(index.page(20, 3)) == listing(rows)[40:]


def test_a_deep_page_reads_the_files_of_its_spans_alone(spark, tmp_path):
    index = start(spark, tmp_path)
    rng = random.Random(7)
    for i in range(3):
        write(spark, index, [message(rng, s) for s in range(i * 40_000, (i + 1) * 40_000, 10)], files=4)
    page = index.page(20, 450)
    assert [s for s, _ in got(page)] == list(range(89_800, 90_000, 10))
    assert len(spark.read.parquet(index.log).inputFiles()) == 24
    assert len(page.inputFiles()) <= 4


def test_expired_files_leave_pages_and_the_disk(spark, tmp_path):
    rng = random.Random(9)
    index, rows = start(spark, tmp_path), {}
    for day in (1, 5, 9):
        rows[day] = [message(rng, day * 1000 + s, day) for s in range(60)]
        write(spark, index, rows[day], files=1)
    before = len(spark.read.parquet(index.log).inputFiles())
    assert index.expire("2024-01-10", 7) == 2  # one file a topic
    left = listing(rows[5] + rows[9])
    assert len(spark.read.parquet(index.log).inputFiles()) == before - 2
    assert got(index.page(100, 1)) + got(index.page(100, 2)) == left
    assert index.expire("2024-01-10", 7) == 0
    index.fold()
    index.fold()
    assert got(index.page(100, 1)) + got(index.page(100, 2)) == left


def test_an_expiry_that_breaks_off_is_ended_by_the_next_call(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    index = start(spark, tmp_path)
    old, new = [message(rng, s, 1) for s in range(40)], [message(rng, 100 + s, 9) for s in range(40)]
    write(spark, index, old, files=1)
    write(spark, index, new, files=1)
    with monkeypatch.context() as m:
        m.setattr(SeekIndex, "_sweep", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.expire("2024-01-10", 7)
    assert got(index.page(100)) == listing(new)
    assert len(spark.read.parquet(index.log).inputFiles()) == 4
    index.fold()  # sweeps before it drops the names
    assert len(spark.read.parquet(index.log).inputFiles()) == 2
    assert got(index.page(100)) == listing(new)


def test_files_that_the_writers_list_names_stay(spark, tmp_path):
    """Readers of a log that a stream writes go by its list of files."""
    rng = random.Random(13)
    rows = [message(rng, s, 1) for s in range(40)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    index = start(spark, tmp_path)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    stream.writeStream.partitionBy("topic").option("checkpointLocation", f"{tmp_path}/cursor").trigger(availableNow=True).start(index.log).awaitTermination()
    index.follow().awaitTermination()
    assert index.expire("2024-03-01", 7) == 0
    assert got(index.page(100)) == listing(rows) and spark.read.parquet(index.log).count() == 40
    assert logs.expire_log(spark.read.parquet(index.log), "2024-03-01").count() == 0


def test_the_log_of_a_pipeline(spark, tmp_path):
    """Two tables' snapshots, whose rows share numbers, in pages that hold every message once."""
    for name, n in (("users", 30), ("items", 25)):
        spark.range(n).selectExpr("id", "concat('n', id) AS name").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    sources = [SourceSpec(name, "snapshot", options={"path": f"{tmp_path}/{name}", "table": f"crm.{name}"}) for name in ("users", "items")]
    pipe = Pipeline(spark, PipelineSpec(sources, log=f"{tmp_path}/log"), f"{tmp_path}/cursors")
    pipe.run_once()
    pipe.publish({"availableNow": True}).awaitTermination()
    index = pipe.index()
    index.follow().awaitTermination()
    index.follow().awaitTermination()
    pages = [index.page(20, p).collect() for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [20, 20, 15, 0]
    assert sorted(r["msg_id"] for p in pages for r in p) == sorted(r["msg_id"] for r in pipe.log().collect())
    users = index.page(100, subject="cdc.users.>").collect()
    assert {r["tbl"] for r in users} == {"users"} and len(users) == 30
    assert {r["after"]["name"] for r in users} == {f"n{i}" for i in range(30)}
    with pytest.raises(ValueError, match="needs a log"):
        Pipeline(spark, PipelineSpec(sources), f"{tmp_path}/c2").index()
