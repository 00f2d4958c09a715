"""Pipeline definitions: every source and sink type by name, with its settings."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from changefold.plans.pipeline import SINKS, SOURCES, Pipeline, PipelineSpec, SinkSpec, SourceSpec, list_types
from tests.test_streaming import FIRST, SECOND, changes


def run(spark, tmp_path, sinks, sources=None, **settings):
    if sources is None:
        src = str(tmp_path / "src")
        changes(spark, FIRST + SECOND).coalesce(1).write.mode("append").parquet(src)
        sources = [SourceSpec("i", options={"path": src})]
    pipe = Pipeline(spark, PipelineSpec(sources, sinks, **settings), str(tmp_path / "cp"))
    pipe.run_once()
    return pipe


def test_types_are_listed():
    assert list_types() == {"sources": ["binlog", "handoff", "json", "parquet", "poll", "snapshot", "wal"], "sinks": ["append", "bulk", "console", "kv", "routed", "table", "webhook"]}
    assert set(list_types()["sources"]) == set(SOURCES) and set(list_types()["sinks"]) == set(SINKS)
    with pytest.raises(ValueError, match="missing options columns"):
        PipelineSpec(sinks=[SinkSpec("s", "routed", options={"path": "p"})]).check()


def test_append_with_mapping_and_expressions(spark, tmp_path):
    run(spark, tmp_path, [SinkSpec("raw", options={"path": f"{tmp_path}/o"}, mapping={"x": "amount"}, expressions={"twice": "2 * try_cast(try_element_at(data, 'amount') as int)"})])
    got = {r["seq"]: r["after"] or r["before"] for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert got[1] == {"id": "1", "amount": "1", "twice": "2"} and got[5] == {"id": "2", "twice": None} and len(got) == 8


def test_routed(spark, tmp_path):
    run(spark, tmp_path, [SinkSpec("r", "routed", options={"path": f"{tmp_path}/o", "columns": {"id": "bigint", "x": "int"}}, routes={"i.t": "things"}, prefix="cdc_")])
    got = spark.read.parquet(f"{tmp_path}/o").collect()
    assert {(r["target"], r["seq"], r["op"], r["id"], r["x"]) for r in got} == {
        ("things", 1, "c", 1, 1), ("things", 2, "c", 2, 2), ("cdc_i_u", 3, "c", 9, 9), ("things", 4, "u", 1, 5), ("things", 5, "d", 2, None), ("things", 6, "x", 3, None), ("things", 7, "c", None, 1), ("things", 8, "c", 4, 4)}


def test_table_with_keys(spark, tmp_path):
    sinks = [SinkSpec("t", "table", ["cdc.i.public.t", "cdc.i.public.u"], {"path": f"{tmp_path}/o", "schema": "k long, x long", "key": "k"}, mapping={"id": "k"}, keys={"u": "x"})]
    pipe = run(spark, tmp_path, sinks)
    table = SINKS["table"](spark, pipe.spec.sinks[0]).read(spark)
    assert {(r["k"], r["x"]) for r in table.collect()} == {(1, 5), (4, 4), (9, 9)}
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/o/dlq").collect()) == [6, 7]


def test_bulk(spark, tmp_path):
    run(spark, tmp_path, [SinkSpec("b", "bulk", options={"path": f"{tmp_path}/o"}, index="things", batch_size=3)])
    files = [p.read_text() for p in tmp_path.glob("o/**/*.txt")]
    lines = [json.loads(x) for text in files for x in text.splitlines() if x]
    heads = [next(iter(x.items())) for x in lines if set(x) <= {"index", "delete"}]
    assert sorted((a, h.get("_id")) for a, h in heads if h.get("_id")) == sorted([("index", "1"), ("index", "2"), ("index", "9"), ("index", "1"), ("delete", "2"), ("index", "3"), ("index", "4")])
    assert len(heads) == 8 and all(h["_index"] == "things" for _, h in heads) and len(lines) == 15


def test_kv(spark, tmp_path):
    run(spark, tmp_path, [SinkSpec("k", "kv", options={"path": f"{tmp_path}/o", "command": "set", "ttl": 60, "value_fields": ["x"]}, key="concat('t:', data.id)")])
    got = {r["seq"]: (r["command"], r["key"], r["args"], r["ttl"]) for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert got[4] == ("SET", "t:1", {"value": "5"}, 60) and got[5] == ("DEL", "t:2", {}, None) and got[7][1] == "cdc:i:t:7"


def test_webhook_and_console(spark, tmp_path):
    bodies = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            bodies.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    sinks = [SinkSpec("w", "webhook", options={"url": f"http://127.0.0.1:{server.server_port}/", "payload": True}, batch_size=4, expressions={"y": "'z'"}), SinkSpec("c", "console")]
    pipe = run(spark, tmp_path, sinks, dlq=f"{tmp_path}/dlq")
    server.shutdown()
    assert sorted(len(b) for b in bodies) == [4, 4] and {c["after"]["y"] for b in bodies for c in b if c.get("after")} == {"z"}
    # lines go to the tasks' own log; a failed batch would be a dead letter
    assert not (tmp_path / "dlq").exists() and pipe.queries["c"].exception() is None


def test_log_in_the_middle(spark, tmp_path):
    """Duplicates are published once; sinks read the log on cursors of their own."""
    src = str(tmp_path / "src")
    for _ in range(2):
        changes(spark, FIRST).coalesce(1).write.mode("append").parquet(src)
    sinks = [SinkSpec("one", options={"path": f"{tmp_path}/one"}), SinkSpec("two", options={"path": f"{tmp_path}/two"}, subjects=["cdc.i.public.u"])]
    settings = {"log": f"{tmp_path}/log", "filters": ["op <> 'x'"], "keep_days": 3}
    sources = [SourceSpec("i", options={"path": src})]
    run(spark, tmp_path, sinks, sources, **settings)
    changes(spark, SECOND).coalesce(1).write.mode("append").parquet(src)
    run(spark, tmp_path, sinks, sources, **settings)
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/one").collect()) == [1, 2, 3, 4, 5, 7, 8]
    assert [r["seq"] for r in spark.read.parquet(f"{tmp_path}/two").collect()] == [3]


def test_dead_letters_of_a_pipeline(spark, tmp_path):
    sinks = [SinkSpec("bad", "webhook", options={"url": "http://127.0.0.1:9/"}, max_retries=1, retry_base_ms=1), SinkSpec("good", options={"path": f"{tmp_path}/o"})]
    run(spark, tmp_path, sinks, dlq=f"{tmp_path}/dlq")
    dead = spark.read.parquet(f"{tmp_path}/dlq").collect()
    assert len(dead) == 8 and {r["sink"] for r in dead} == {"bad"} and spark.read.parquet(f"{tmp_path}/o").count() == 8


def test_snapshot_source(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string").coalesce(1).write.parquet(f"{tmp_path}/users")
    source = SourceSpec("s", "snapshot", options={"path": f"{tmp_path}/users", "table": "crm.users"})
    run(spark, tmp_path, [SinkSpec("t", "table", options={"path": f"{tmp_path}/o", "schema": "id long, name string"})], [source], log=f"{tmp_path}/log")
    table = SINKS["table"](spark, SinkSpec("t", "table", options={"path": f"{tmp_path}/o", "schema": "id long, name string"})).read(spark)
    assert {(r["id"], r["name"]) for r in table.collect()} == {(i, f"n{i}") for i in range(20)}


def test_wal_binlog_and_kept_polls(spark, tmp_path):
    cell = "array<struct<kind:string,value:string>>"
    spark.createDataFrame([(1, 0, "insert", 7, None, [("text", "5")])], f"lsn long, ts long, kind string, relation_id long, old {cell}, new {cell}").write.parquet(f"{tmp_path}/wal")
    spark.createDataFrame([(7, "public", "t", [("id", 20)])], "relation_id long, namespace string, name string, columns array<struct<name:string,oid:int>>").write.parquet(f"{tmp_path}/rel")
    spark.createDataFrame([("f", 9, "delete", "db", "u", ["id"], [["6"]], 0)], "file string, pos long, action string, db string, table string, columns array<string>, rows array<array<string>>, ts long").write.parquet(f"{tmp_path}/bin")
    spark.createDataFrame([(5, 200, '[{"id":8},{"id":9}]')], "poll_ts long, status int, body string").write.parquet(f"{tmp_path}/polls")
    sources = [
        SourceSpec("w", "wal", options={"path": f"{tmp_path}/wal", "relations": f"{tmp_path}/rel"}), SourceSpec("b", "binlog", options={"path": f"{tmp_path}/bin"}),
        SourceSpec("p", "poll", options={"path": f"{tmp_path}/polls", "table": "v"}),
    ]
    run(spark, tmp_path, [SinkSpec("raw", options={"path": f"{tmp_path}/o"})], sources, log=f"{tmp_path}/log")
    got = {(r["instance_id"], r["subject"], r["op"], (r["after"] or r["before"])["id"]) for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert got == {("w", "cdc.w.public.t", "c", "5"), ("b", "cdc.b.db.u", "d", "6"), ("p", "cdc.p.public.v", "c", "8"), ("p", "cdc.p.public.v", "c", "9")}


def test_json_source(spark, tmp_path):
    changes(spark, FIRST).write.json(f"{tmp_path}/src")
    run(spark, tmp_path, [SinkSpec("raw", options={"path": f"{tmp_path}/o"})], [SourceSpec("i", "json", ["t"], {"path": f"{tmp_path}/src"})])
    got = spark.read.parquet(f"{tmp_path}/o").collect()
    assert {r["seq"] for r in got} == {1, 2} and {type(r["ts"]) for r in got} == {dt.datetime}
