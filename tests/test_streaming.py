"""Streaming delivery: cursors, restarts, dead letters; batch and stream agree."""

import datetime as dt
import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.model import ENVELOPE
from changefold.operators import merge
from changefold.plans.pipeline import Pipeline, PipelineSpec, SinkSpec, SourceSpec
from changefold.sources import decode, snapshot
from changefold.sources.changes import read_changes
from changefold.sources.poll import PollSource, poll_trigger
from changefold.streaming import log as logs
from changefold.streaming.observe import ProgressTable, active_workers, reconnects, worker_duration_histogram
from changefold.streaming.sinks import AppendSink, FunctionSink, TableSink, WebhookSink, run_sink, with_retries
from changefold.streaming.tables import MergeTable

TABLE = "id long, x long"


def changes(spark, data):
    t = dt.datetime(2024, 1, 1)
    full = [(s, "cdc", f"cdc.i.public.{tbl}", "i", "public", tbl, op, str(s), s, t + dt.timedelta(seconds=s), image if op == "d" else None, None if op == "d" else image) for s, tbl, op, image in data]
    return spark.createDataFrame(full, ENVELOPE)


FIRST = [(1, "t", "c", {"id": "1", "x": "1"}), (2, "t", "c", {"id": "2", "x": "2"}), (3, "u", "c", {"id": "9", "x": "9"})]
SECOND = [(4, "t", "u", {"id": "1", "x": "5"}), (5, "t", "d", {"id": "2"}), (6, "t", "x", {"id": "3"}), (7, "t", "c", {"x": "1"}), (8, "t", "c", {"id": "4", "x": "4"})]


def test_table_sink_resumes_and_keeps_dead_letters(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    sink = lambda: TableSink("store", out, "id", ["lsn", "seq"], spark.createDataFrame([], TABLE), ["cdc.*.public.t"], f"{tmp_path}/dlq")
    for part in (FIRST, SECOND):
        changes(spark, part).coalesce(1).write.mode("append").parquet(src)
        run_sink(read_changes(spark, src, stream=True), sink(), cp).awaitTermination()
    got = {r["id"]: r["x"] for r in sink().read(spark).collect()}
    assert got == {1: 5, 4: 4}
    dead = spark.read.parquet(f"{tmp_path}/dlq").select("seq", "reason").orderBy("seq").collect()
    assert [tuple(r) for r in dead] == [(6, "unknown op"), (7, "missing key")]
    batch = merge.split_keyless(merge.split_ops(read_changes(spark, src).filter("tbl = 't'").withColumn("image", F.coalesce("before", "after")))[0])[0]
    whole = merge.apply_changes(batch, spark.createDataFrame([], TABLE), "id", ["lsn", "seq"])
    assert {r["id"]: r["x"] for r in whole.collect()} == got


def test_repeated_epoch_changes_nothing(spark, tmp_path):
    sink = TableSink("s", str(tmp_path / "o"), "id", ["lsn", "seq"], spark.createDataFrame([], TABLE))
    for _ in range(2):
        sink.write(changes(spark, FIRST[:2]), 0)
    assert {r["id"]: r["x"] for r in sink.read(spark).collect()} == {1: 1, 2: 2}


def test_failed_write_is_retried_and_cursor_stays(spark, tmp_path):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    changes(spark, FIRST).write.parquet(src)
    calls = []

    def flaky(batch, epoch):
        calls.append(epoch)
        if len(calls) == 1:
            raise RuntimeError("down")

    run_sink(read_changes(spark, src, stream=True), FunctionSink("f", flaky), cp, tries=2).awaitTermination()
    assert calls == [0, 0]
    run_sink(read_changes(spark, src, stream=True), FunctionSink("f", flaky), cp).awaitTermination()
    assert calls == [0, 0]


def test_publish_and_dedup_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "log", "cp"))
    data = changes(spark, FIRST)
    data.unionByName(data.filter("seq = 1")).coalesce(1).write.parquet(src)
    stream = logs.to_messages(read_changes(spark, src, stream=True))
    logs.publish_log(logs.dedup_stream(stream), out, cp).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 3 and set(logs.PARTITIONS) <= set(got.columns)
    assert logs.dedup_messages(logs.to_messages(read_changes(spark, src))).count() == 3


def test_pipeline_runs_sinks_apart(spark, tmp_path):
    src = str(tmp_path / "src")
    changes(spark, FIRST).write.parquet(src)
    spec = PipelineSpec(
        [SourceSpec("i", options={"path": src})],
        [SinkSpec("raw", "append", options={"path": f"{tmp_path}/raw"}), SinkSpec("tab", "table", ["cdc.i.public.t"], {"path": f"{tmp_path}/tab", "schema": TABLE})],
        filters=["op <> 'd'"],
    )
    pipe = Pipeline(spark, spec, f"{tmp_path}/cp")
    pipe.run_once()
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 3
    assert MergeTable(f"{tmp_path}/tab", "id", T.StructType.fromDDL(TABLE), ["lsn", "seq", "instance_id"]).read(spark).count() == 2
    pipe.stop()


def test_reprocess(spark):
    dead = changes(spark, FIRST).unionByName(changes(spark, [(9, "t", "c", None)]))
    replayed, left, ended = logs.reprocess_dlq(dead, ["tbl = 't'"], valid=lambda df: df["after"]["id"] != "2")
    assert sorted(r["seq"] for r in replayed.collect()) == [1]
    assert sorted(r["seq"] for r in left.collect()) == [2, 3] and [r["seq"] for r in ended.collect()] == [9]
    letters = logs.dead_letters(changes(spark, FIRST[:1]), F.lit("why")).collect()[0]
    assert (letters["reason"], letters["dlq_subject"]) == ("why", "dlq.cdc.i.public.t")


def test_poll_source(spark, tmp_path):
    answers = [(200, b'[{"id":1},{"id":2}]'), (500, b"")]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = answers[0] if len(answers) == 1 else answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PollSource)
    stream = spark.readStream.format("poll").option("url", f"http://127.0.0.1:{server.server_port}/").option("keep", str(tmp_path / "keep")).load()
    seen = ProgressTable(spark)
    spark.streams.addListener(seen)
    got = []
    query = stream.writeStream.queryName("poll").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, epoch: got.extend(df.collect())).trigger(**poll_trigger(200)).start()
    for _ in range(150):
        if len(got) >= 2:
            break
        time.sleep(0.2)
    query.stop()
    server.shutdown()
    responses = spark.createDataFrame(got, stream.schema)
    assert decode.poll_rows_to_events(responses, "i", "t").count() == 2
    assert decode.poll_errors(responses).count() >= 1
    for _ in range(50):
        if seen.seen("end"):
            break
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    progress = seen.table(spark)
    assert [tuple(r) for r in active_workers(progress).collect()] == [("poll", 0)]
    assert [tuple(r) for r in reconnects(progress).collect()] == [("poll", 0)]
    batches = progress.filter("kind = 'batch'").count()
    assert worker_duration_histogram(progress).filter("le = '+Inf'").collect()[0]["n"] == batches > 0


def test_rate_limit_and_hot_sinks(spark, tmp_path):
    src = str(tmp_path / "src")
    for row in FIRST:
        changes(spark, [row]).coalesce(1).write.mode("append").parquet(src)
    sizes = []
    limited = read_changes(spark, src, stream=True, files_per_trigger=1)
    run_sink(limited, FunctionSink("slow", lambda df, epoch: sizes.append(df.count())), str(tmp_path / "cp")).awaitTermination()
    assert sizes == [1, 1, 1]
    pipe = Pipeline(spark, PipelineSpec([SourceSpec("i", options={"path": src})], []), str(tmp_path / "cp2"))
    query = pipe.add_sink(SinkSpec("late", "append", options={"path": str(tmp_path / "late")}), {"processingTime": "100 milliseconds"})
    assert query.isActive and pipe.add_sink(SinkSpec("bad", "nope")) is None
    pipe.remove_sink("late")
    assert not query.isActive and pipe.queries == {}


# --- nothing is lost -------------------------------------------------------------------


def test_retries():
    calls = []

    def fail(kind):
        def write():
            calls.append(kind)
            raise logs.DeliveryError("no", kind)

        return write

    for retries, kind, want in ((0, "network", 1), (2, "network", 3), (2, "unknown", 3), (5, "schema", 1), (5, "validation", 1)):
        calls.clear()
        with pytest.raises(logs.DeliveryError):
            with_retries(fail(kind), retries, base=1)
        assert len(calls) == want
    done = []
    with_retries(lambda: done.append(1), 0)
    assert done == [1]


def test_sink_without_retries_writes(spark, tmp_path):
    src = str(tmp_path / "src")
    changes(spark, FIRST).write.parquet(src)
    spec = PipelineSpec([SourceSpec("i", options={"path": src})], [SinkSpec("raw", "append", options={"path": f"{tmp_path}/raw"}, max_retries=0)])
    Pipeline(spark, spec, f"{tmp_path}/cp").run_once()
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 3


def test_poisoned_batch_goes_to_dead_letters_and_the_sink_goes_on(spark, tmp_path):
    src, dlq = str(tmp_path / "src"), str(tmp_path / "dlq")
    for row in FIRST:
        changes(spark, [row]).coalesce(1).write.mode("append").parquet(src)
    seen, tried = [], []

    def write(df, epoch):
        seqs = [r["seq"] for r in df.collect()]
        tried.extend(seqs)
        if 2 in seqs:
            raise RuntimeError("poison")
        seen.extend(seqs)

    log = read_changes(spark, src, stream=True, files_per_trigger=1)
    run_sink(log, FunctionSink("f", write), str(tmp_path / "cp"), tries=2, dlq=dlq, base=1).awaitTermination()
    assert sorted(seen) == [1, 3] and tried.count(2) == 2
    dead = spark.read.parquet(dlq).collect()
    assert [(r["seq"], r["sink"], r["original_subject"]) for r in dead] == [(2, "f", "cdc.i.public.t")] and "poison" in dead[0]["reason"]


def test_dedup_keeps_messages_without_id(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    data = changes(spark, [(s, "t", "c", {"id": str(s)}) for s in range(1, 7)]).withColumn("offset", F.when(F.col("seq") == 6, "6").otherwise(""))
    data.coalesce(1).write.parquet(src)
    assert logs.dedup_messages(logs.to_messages(read_changes(spark, src))).count() == 6
    logs.publish_log(logs.dedup_stream(logs.to_messages(read_changes(spark, src, stream=True))), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_dedup_against_plain_python(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", "c", None, f"only{i}"]), None if rng.random() < 0.05 else start + dt.timedelta(seconds=rng.randrange(900))) for i in range(400)]
    rows += rows[:20]  # rows equal in everything
    want, last = [], {}
    for seq, key, at in sorted(rows, key=lambda r: (r[2] or start, r[0])):
        if key is None or at is None or key not in last or (at - last[key]).total_seconds() >= 120:
            want.append((seq, key, at))
            if key is not None and at is not None:
                last[key] = at
    frame = spark.createDataFrame(rows, "seq long, msg_id string, ts timestamp_ntz").withColumn("_k", F.lit(1)).drop("_k")
    assert sorted(map(tuple, logs.dedup_messages(frame).collect()), key=repr) == sorted(want, key=repr)
    assert logs.dedup_messages(frame.limit(0)).count() == 0


def test_snapshot_rows_are_no_duplicates(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(50)], "id long, v string")
    events = [snapshot.snapshot_to_events(rows, name, "inst", "id") for name in ("one", "two")]
    log = events[0].unionByName(events[1]).withColumn("seq", F.monotonically_increasing_id()).withColumn("ts", F.lit(dt.datetime(2024, 1, 1)))
    assert logs.dedup_messages(logs.to_messages(log)).count() == 100
    assert logs.dedup_messages(logs.to_messages(log, ordinals=())).count() == 1


def test_reprocess_knows_sinks_apart(spark):
    letters = changes(spark, FIRST[:2]).crossJoin(spark.createDataFrame([("a",), ("b",)], "sink string"))
    replayed, left, _ = logs.reprocess_dlq(letters, ["sink = 'a'"])
    assert sorted((r["sink"], r["seq"]) for r in left.collect()) == [("b", 1), ("b", 2)] and replayed.count() == 2


def test_table_sink_loses_no_row_and_knows_its_queries(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = lambda: TableSink("s", path, "id", ["lsn", "seq"], spark.createDataFrame([], TABLE), compact=3)
    src = str(tmp_path / "src")
    batches = [FIRST[:2], SECOND, [(9, "t", "u", None), (10, "t", "u", {"id": "7", "x": "1"})], [(11, "t", "u", {"id": "7", "x": "2"})], [(12, "t", "d", {"id": "1"}), (13, "t", "c", {"id": "2", "x": "8"})]]
    for batch in batches:
        changes(spark, batch).coalesce(1).write.mode("append").parquet(src)
        run_sink(read_changes(spark, src, stream=True), sink(), str(tmp_path / "cp")).awaitTermination()
    assert {r["id"]: r["x"] for r in sink().read(spark).collect()} == {2: 8, 4: 4, 7: 2}
    dead = spark.read.parquet(f"{path}/dlq").select("seq", "reason").collect()
    assert sorted(map(tuple, dead)) == [(6, "unknown op"), (7, "missing key"), (9, "missing image")]
    assert len(list(tmp_path.joinpath("t").glob("pointer=*"))) == 2
    # a new checkpoint numbers its batches from 0 again, and they count
    other = str(tmp_path / "other")
    changes(spark, [(1, "t", "c", {"id": "50", "x": "5"})]).write.parquet(other)
    run_sink(read_changes(spark, other, stream=True), sink(), str(tmp_path / "cp2")).awaitTermination()
    assert {r["id"] for r in sink().read(spark).collect()} == {2, 4, 7, 50}


def test_append_sink_keeps_what_other_queries_wrote(spark, tmp_path):
    src = str(tmp_path / "src")
    changes(spark, FIRST).write.parquet(src)
    for cp in ("a", "b"):
        run_sink(read_changes(spark, src, stream=True), AppendSink("raw", str(tmp_path / "out")), str(tmp_path / cp)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_webhook_sink_posts_from_tasks(spark, tmp_path):
    bodies, status = [], [503]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            code = status.pop() if status else 204
            if code == 204:
                bodies.append(json.loads(body))
            self.send_response(code)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    src = str(tmp_path / "src")
    changes(spark, FIRST).coalesce(1).write.parquet(src)
    sink = WebhookSink("w", f"http://127.0.0.1:{server.server_port}/", size=2)
    run_sink(read_changes(spark, src, stream=True), sink, str(tmp_path / "cp"), tries=3, base=1).awaitTermination()
    server.shutdown()
    posted = {tuple(c["offset"] for c in b) for b in bodies}
    assert posted == {("1", "2"), ("3",)}


def test_a_lagging_source_is_not_too_late(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for shift in (86_400, 0, 5):
        late = changes(spark, FIRST).withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(shift)))
        late.withColumn("offset", F.concat(F.lit(f"{shift // 10}-"), "offset")).coalesce(1).write.mode("append").parquet(src)
        logs.publish_log(logs.dedup_stream(logs.to_messages(read_changes(spark, src, stream=True))), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_stream_dedup_equals_batch_dedup(spark, tmp_path):
    """Messages in order of time, in several batches with restarts; every kind of column comes out as it went in."""
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    rows = []
    for i in range(300):
        at = start + dt.timedelta(seconds=4 * i + rng.random())
        key = rng.choice(["a", "b", f"only{i}", None])
        rows.append((i, key, None if i % 50 == 7 else at, {"k": None, "v": 'q"é'}, bytearray([i % 256, 0]), [i, None], i % 3 == 0, (at - start).total_seconds()))
    schema = "seq long, msg_id string, ts timestamp_ntz, image map<string,string>, raw binary, a array<int>, flag boolean, x double"
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").parquet(src)
        stream = logs.dedup_stream(spark.readStream.schema(schema).parquet(src), buckets=4)
        stream.writeStream.option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    key = lambda r: r[0]
    want = sorted(map(tuple, logs.dedup_messages(spark.createDataFrame(rows, schema)).collect()), key=key)
    assert sorted(map(tuple, spark.read.schema(schema).parquet(out).collect()), key=key) == want and 100 < len(want) < 300


def test_window_starts_anew_and_late_messages_are_not_lost(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    # seconds of one id: 0 is accepted, 100 not, 130 is (the window began at 0), 240 not (it began anew at 130), 250 is; then some earlier ones
    for batch in ([0], [100, 130], [240, 250], [-200], [-100], [60]):
        spark.createDataFrame([(s, "a", start + dt.timedelta(seconds=s)) for s in batch], "seq long, msg_id string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = logs.dedup_stream(spark.readStream.schema("seq long, msg_id string, ts timestamp").parquet(src), buckets=2)
        stream.writeStream.option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == [-200, 0, 130, 250]


def test_polls_are_kept_and_replayed(spark, tmp_path):
    """A server that never says the same twice: a batch that fails and is done again after a restart has
    the responses that were kept, of all addresses, and polls go on behind it."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = json.dumps([{"n": len(asked)}]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PollSource)
    urls = " ".join(f"http://127.0.0.1:{server.server_port}/{k}" for k in range(3))
    seen, batches = [], []

    def write(df, epoch):
        rows = sorted(map(tuple, df.select("address", "poll_ts", "body").collect()))
        seen.append((epoch, rows))
        if len(seen) == 1:
            raise RuntimeError("broken off")
        batches.append(rows)

    def start():
        stream = spark.readStream.format("poll").option("urls", urls).option("keep", str(tmp_path / "keep")).load()
        return stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(write).trigger(**poll_trigger(100)).start()

    with pytest.raises(Exception, match="broken off"):
        start().awaitTermination()
    for n in (2, 4):
        query = start()
        while len(batches) < n:
            time.sleep(0.1)
        query.stop()
    server.shutdown()
    assert seen[0] == seen[1] and len(seen[0][1]) == 3, "the batch wasn't replayed as it was"
    bodies = [b for rows in batches for _, _, b in rows]
    assert len(set(bodies)) == len(bodies) and {p for p in asked} == {"/0", "/1", "/2"}
    assert len(list((tmp_path / "keep").glob("poll=*"))) <= 3


def test_progress_counts_right_after_many_batches(spark, tmp_path):
    """Twenty thousand batches of two sinks, of which one was started again: the driver holds few rows of them."""
    Run = lambda **x: type("Event", (), x)
    table = lambda: ProgressTable(spark, str(tmp_path / "rows"), flush=3000)
    seen = table()
    for run, name, n in ((1, "a", 12_000), (2, "b", 4_000), (3, "b", 4_000)):
        seen = table() if run == 3 else seen  # a new session goes on with the folder
        seen.onQueryStarted(Run(runId=run, name=name, id=name))
        for k in range(n):
            seen.onQueryProgress(Run(progress=Run(name=name, id=name, runId=run, batchId=k, numInputRows=2, durationMs={"triggerExecution": 100})))
        assert len(seen.rows) < 3000
        if run == 2:
            seen.onQueryTerminated(Run(runId=run, id=name, exception=None))
            seen.table(spark)
    rows = seen.table(spark)
    assert {tuple(r) for r in active_workers(rows).collect()} == {("a", 1), ("b", 1)}
    assert {tuple(r) for r in reconnects(rows).collect()} == {("a", 0), ("b", 1)}
    assert {r["sink"]: r["n"] for r in worker_duration_histogram(rows).filter("le = '+Inf'").collect()} == {"a": 12_000, "b": 8_000}
    assert rows.filter("kind = 'batch'").agg(F.sum("rows")).collect()[0][0] == 40_000


def test_a_stopped_query_leaves_no_dead_letters(spark, tmp_path):
    src, out, dlq = (str(tmp_path / n) for n in ("src", "out", "dlq"))
    changes(spark, FIRST).coalesce(1).write.parquet(src)
    begun = threading.Event()

    def slow(df, epoch):
        begun.set()
        nap = F.udf(lambda s: time.sleep(20) or s, "long")
        df.select(nap("seq").alias("seq")).write.mode("overwrite").parquet(f"{out}/slow")

    query = run_sink(read_changes(spark, src, stream=True), FunctionSink("f", slow), str(tmp_path / "cp"), tries=3, dlq=dlq, base=1)
    assert begun.wait(60)
    time.sleep(2)
    query.stop()
    done = []
    run_sink(read_changes(spark, src, stream=True), FunctionSink("f", lambda df, epoch: done.extend(r["seq"] for r in df.collect())), str(tmp_path / "cp"), tries=3, dlq=dlq).awaitTermination()
    assert sorted(done) == [1, 2, 3] and not (tmp_path / "dlq").exists()
