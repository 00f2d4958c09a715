"""Edge rows of operators on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from changefold import queries
from changefold.functions import scalars
from changefold.operators import actions, filters, merge, metrics, routing
from changefold.plans.pipeline import PipelineSpec, SinkSpec, SourceSpec, builder, SINKS
from changefold.sources import changes as reading
from changefold.sources import decode, snapshot
from changefold.streaming import log as logs

CHANGE = "seq long, lsn long, op string, image map<string,string>"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def apply(spark, changes, base=()):
    log = spark.createDataFrame(changes, CHANGE)
    keyed, dead = merge.split_keyless(log.withColumn("tbl", F.lit("t")), kind="bigint")
    table = spark.createDataFrame(list(base), "id long, x long, y long")
    return {r["id"]: (r["x"], r["y"]) for r in merge.apply_changes(keyed, table, "id", ["lsn", "seq"]).collect()}, dead.count()


@pytest.mark.parametrize(
    ("changes", "base", "want"),
    [
        ([(1, 1, "c", {"id": "1", "x": "1", "y": "2"}), (2, 2, "u", {"id": "1", "y": "3"})], [], {1: (1, 3)}),
        ([(1, 1, "c", {"id": "1", "x": "1", "y": "9"}), (2, 2, "d", {"id": "1"}), (3, 3, "c", {"id": "1", "x": "7"})], [], {1: (7, None)}),
        ([(1, 1, "u", {"id": "1", "y": None})], [(1, 5, 6)], {1: (5, None)}),
        ([(1, 1, "d", {"id": "1"})], [(1, 5, 6)], {}),
        ([], [(1, 5, 6)], {1: (5, 6)}),
        ([(2, 1, "u", {"id": "1", "x": "2"}), (1, 1, "u", {"id": "1", "x": "1"})], [], {1: (2, None)}),
        ([(1, 1, "u", {"id": "1", "x": "zz"})], [(1, 5, 6)], {1: (None, 6)}),
    ],
)
def test_apply_changes(spark, changes, base, want):
    assert apply(spark, changes, base)[0] == want


def test_keyless_rows_go_to_dead_letters(spark):
    got, dead = apply(spark, [(1, 1, "c", {"x": "1"}), (2, 2, "c", {"id": "2", "x": "1"}), (3, 3, "c", {"id": "no"})])
    assert got == {2: (1, None)} and dead == 2


def test_unknown_op_is_rejected(spark):
    known, rejected = merge.split_ops(spark.createDataFrame([(1, 1, "x", {}), (2, 2, None, {}), (3, 3, "r", {})], CHANGE))
    assert rows(known, "seq") == [(3,)] and rows(rejected, "seq", "reason") == [(1, "unknown op"), (2, "unknown op")]


def test_folding_in_steps_equals_folding_at_once(spark):
    changes = [(i, i, "cud"[i * 7 % 3], {"id": str(i % 4), ("x" if i % 2 else "y"): str(i)}) for i in range(1, 40)]
    whole, _ = apply(spark, changes)
    table = {}
    for part in (changes[:13], changes[13:14], changes[14:]):
        table, _ = apply(spark, part, [(k, *v) for k, v in table.items()])
    shuffled, _ = apply(spark, changes[::-1])
    assert table == whole == shuffled


def test_decode_tuple(spark):
    cols = [("a", 16), ("b", 23), ("c", 1700), ("d", 3802), ("e", 25)]
    cells = [("text", "t"), ("text", "abc"), ("text", "1.50"), ("text", '{"a":1}'), ("unchanged", None), ("text", "extra")]
    df = spark.createDataFrame([(cols, cells), (cols, None), (cols, [("null", None)])], "c array<struct<name:string,oid:int>>, v array<struct<kind:string,value:string>>")
    got = [r[0] for r in df.select(decode.decode_tuple(F.col("c"), F.col("v"))).collect()]
    assert got == [{"a": "true", "b": None, "c": "1.5", "d": '{"a":1}'}, None, {"a": None}]
    bad = spark.range(1).select(scalars.parse_oid(F.lit("abc"), F.lit(23))["bad"].alias("b"), scalars.parse_oid(F.lit("7"), F.lit(23))["bad"].alias("g")).collect()[0]
    assert bad["b"] and not bad["g"]


def test_wal_rows(spark):
    relations = spark.createDataFrame([(1, "public", "old", [("id", 23)], 1), (1, "public", "t", [("id", 23), ("n", 25)], 2)], "relation_id long, namespace string, name string, columns array<struct<name:string,oid:int>>, seen long")
    wal = spark.createDataFrame([(5, 1000, "update", 1, None, [("text", "1"), ("text", "x")]), (6, 1000, "delete", 1, [("text", "1")], None), (7, 0, "insert", 9, None, None)], "lsn long, ts long, kind string, relation_id long, old array<struct<kind:string,value:string>>, new array<struct<kind:string,value:string>>")
    got = decode.wal_rows_to_events(wal, relations, "i").orderBy("lsn").collect()
    assert [(r["op"], r["tbl"], r["before"], r["after"]) for r in got] == [("u", "t", None, {"id": "1", "n": "x"}), ("d", "t", {"id": "1"}, None)]


def test_binlog_rows(spark):
    data = [("f", 10, "update", [["1", "a"], ["1", "b"], ["2", "c"]]), ("f", 20, "insert", [["3", "d"], ["4", "e"]]), ("f", 30, "delete", [["5", None]]), ("f", 40, "update", [])]
    df = spark.createDataFrame([(f, p, a, "db", "t", ["id", "v"], r, 1) for f, p, a, r in data], "file string, pos long, action string, db string, table string, columns array<string>, rows array<array<string>>, ts long")
    got = decode.binlog_rows_to_events(df, "i").orderBy("lsn", "ordinal").collect()
    assert [(r["offset"], r["op"], r["before"], r["after"]) for r in got] == [
        ("f:10", "u", {"id": "1", "v": "a"}, {"id": "1", "v": "b"}), ("f:10", "u", None, None),
        ("f:20", "c", None, {"id": "3", "v": "d"}), ("f:20", "c", None, {"id": "4", "v": "e"}), ("f:30", "d", {"id": "5", "v": None}, None),
    ]


def test_poll(spark):
    df = spark.createDataFrame([(1, 200, '[{"a":1},{"a":2}]'), (2, 200, '{"a":1}'), (3, 200, "[]"), (4, 500, "[]")], "poll_ts long, status int, body string")
    assert [(r["lsn"], r["ordinal"], r["after"]) for r in decode.poll_rows_to_events(df, "i", "t").orderBy("lsn", "ordinal").collect()] == [(1, 0, {"a": "1"}), (1, 1, {"a": "2"})]
    assert rows(decode.poll_errors(df), "poll_ts", "reason") == [(2, "not an array"), (4, "status 500")]


def test_binlog_offset(spark):
    df = spark.createDataFrame([("a:1",), ("a",), ("a:1:2",), ("a:x",), ("a:4294967296",), (None,)], "o string")
    assert [r[0] and tuple(r[0]) for r in df.select(decode.parse_binlog_offset(F.col("o"))).collect()] == [("a", 1), None, None, None, None, None]


def test_subject_match(spark):
    df = spark.createDataFrame([("cdc",), ("cdc.a",), ("cdc.a.public.users",), ("cdcx.a",)], "s string")
    match = lambda p: [r[0] for r in df.filter(filters.subject_match(F.col("s"), p)).collect()]
    assert match(["cdc.>"]) == ["cdc.a", "cdc.a.public.users"]
    assert match(["cdc.*.public.users"]) == ["cdc.a.public.users"]
    assert match([">"]) == ["cdc", "cdc.a", "cdc.a.public.users", "cdcx.a"] == match([])
    assert match(["cdc.a", "cdcx.*"]) == ["cdc.a", "cdcx.a"]


def test_table_filters(spark):
    df = spark.createDataFrame([("public", "users"), ("public", "a.b"), ("x", "users")], "schema string, tbl string")
    assert filters.table_allowed(df, []).count() == 3
    assert filters.table_allowed(df, ["users"]).count() == 2 and filters.table_allowed(df, ["public.users"]).count() == 1
    assert filters.table_regex_allowed(df, ["public.a.b"]).count() == 1 and filters.table_regex_allowed(df, ["public.a+b"]).count() == 0


def test_rename(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2"},)], "image map<string,string>")
    assert [r[0] for r in df.select(filters.rename_fields(F.col("image"), {"a": "b"})).collect()] == [{"b": "1"}, {"b": "2"}]
    for names in ({"a": "b", "b": "c"}, {"a": "a"}):
        with pytest.raises(ValueError):
            filters.rename_fields(F.col("image"), names)


def test_split_valid(spark):
    df = spark.createDataFrame([('{"op":"c","after":{"a":1}}',), ('{"op":"d","before":{"a":1}}',), ('{"op":"d","after":{"a":1}}',), ("nope",), (None,)], "data string")
    good, bad = filters.split_valid(df)
    assert rows(good, "op") == [("c",), ("d",)] and rows(bad, "reason") == [("bad json",), ("bad json",), ("missing image",)]


def test_ids_and_keys(spark):
    raw = spark.createDataFrame([(bytes(range(16)),), (b"\x01\x02\xff",)], "b binary")
    assert [r[0] for r in raw.select(routing.bytes_id(F.col("b"))).collect()] == ["00010203-0405-0607-0809-0a0b0c0d0e0f", "0102ff"]
    df = spark.createDataFrame([({"ID": "7"}, "5"), ({}, "5"), ({"guid": "g", "uid": "u"}, "5")], "image map<string,string>, offset string").withColumns({"instance_id": F.lit("i"), "tbl": F.lit("t")})
    assert [r[0] for r in routing.build_key(df).select("key").collect()] == ["cdc:i:t:7", "cdc:i:t:5", "cdc:i:t:u"]


def test_times(spark):
    ok = ["2024-01-02 03:04:05", "2024-01-02 03:04:05.123", "2024-01-02 03:04:05+00", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.1234567Z"]
    bad = ["2024-01-02", "nope", "2024-01-02 03:04:05Z", ""]
    df = spark.createDataFrame([(t,) for t in ok + bad], "t string")
    got = [r[0] for r in df.select(scalars.parse_flex_time(F.col("t"))).collect()]
    base = int(dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.UTC).timestamp() * 1000)
    assert got == [base, base + 123, base, base, base + 123, None, None, None, None]


def test_sanitize(spark):
    doc = {"metadata": "{}", "created_at": "2024-01-02 03:04:05", "lifetime": "x", "timestamp": "2024-01-02T03:04:05Z", "n": "1"}
    got = spark.createDataFrame([(doc,), ({"metadata": '{"a":1}'},)], "d map<string,string>").select(scalars.sanitize_doc(F.col("d"))).collect()
    assert got[0][0] == {"metadata": "", "created_at": "1704164645000", "lifetime": "x", "timestamp": "1704164645000", "n": "1"} and got[1][0] == {"metadata": '{"a":1}'}


def test_kv_commands(spark):
    df = spark.createDataFrame([(1, "c", "k", {"a": "1"}), (2, "d", "k", {"a": "1"})], "seq long, op string, key string, image map<string,string>")
    run = lambda name, ttl=0: [(r["command"], r["ttl"]) for r in actions.kv_commands(df, name, ttl).orderBy("seq").collect()]
    assert run("set", 60) == [("SET", 60), ("DEL", None)] and run("hset") == [("HSET", None), ("DEL", None)] == run("what")
    assert run("sadd") == [("SADD", None), ("SREM", None)] and run("bf_add") == [("BF.ADD", None)] and run("bf.add") == [("BF.ADD", None), ("DEL", None)]


def test_kv_state(spark):
    df = spark.createDataFrame([(1, "HSET", "h", {"a": "1", "b": "2"}), (2, "HSET", "h", {"a": "3"}), (3, "SADD", "s", {"member": "x"}), (4, "SADD", "s", {"member": "y"}), (5, "SREM", "s", {"member": "x"}), (6, "SET", "v", {"value": "1"}), (7, "SET", "v", {"value": "2"}), (8, "HSET", "g", {"a": "1"}), (9, "DEL", "g", {})], "seq long, command string, key string, args map<string,string>")
    got = {r["key"]: (r["kind"], r["value"], r["fields"] and [tuple(f) for f in r["fields"]], r["members"]) for r in merge.kv_state(df).collect()}
    assert got == {"h": ("hash", None, [("a", "3"), ("b", "2")], None), "s": ("set", None, None, ["y"]), "v": ("string", "2", None, None)}


def test_bulk(spark):
    df = spark.createDataFrame([(1, "c", "t", {"id": "1"}), (2, "c", "t", {"x": "1"}), (3, "d", "t", {"id": "1"}), (4, "d", "t", {"x": "1"})], "seq long, op string, target string, image map<string,string>")
    got = actions.bulk_actions(df)
    assert rows(got, "seq", "action", "doc_id") == [(1, "index", "1"), (2, "index", None), (3, "delete", "1")]
    assert "\n" in actions.bulk_text(got).orderBy("seq").collect()[0]["value"]
    body = '{"errors":true,"items":[{"index":{"_id":"1","status":400,"error":{"type":"t","reason":"r"}}},{"delete":{"_id":"2","status":200}}]}'
    errors = actions.bulk_item_errors(spark.createDataFrame([(body,), ('{"errors":false,"items":[]}',)], "body string"))
    assert rows(errors, "action", "doc_id", "status", "type", "reason") == [("index", "1", 400, "t", "r")]


def test_infer_schema(spark):
    df = spark.createDataFrame([("t", '{"id":1,"a":true,"b":"x","c":{"z":1},"d":null,"e":1}'), ("t", '{"id":2.5,"a":null,"e":"x"}')], "target string, data string")
    got = actions.infer_sink_schema(df)
    assert {r["column"]: r["type"] for r in got.collect()} == {"id": "DOUBLE PRECISION", "a": "BOOLEAN", "b": "TEXT", "c": "JSONB", "d": "TEXT", "e": "TEXT"}
    assert '"id" DOUBLE PRECISION PRIMARY KEY' in actions.table_ddl(got).collect()[0]["ddl"]


def test_webhook_failures(spark):
    df = spark.createDataFrame([(1, 200), (2, 299), (3, 300), (4, None)], "batch long, status int")
    assert rows(actions.failed_batches(df), "batch") == [(3,), (4,)]


def test_paging_and_modes(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 1), ("c", 8000), ("d", 8001)], "tbl string, n_rows long")
    assert rows(snapshot.plan_chunks(counts).groupBy("tbl").count(), "tbl", "count") == [("a", 1), ("b", 1), ("c", 1), ("d", 2)]
    inst = spark.createDataFrame([("a", "always"), ("b", "initial"), ("c", "INITIAL"), ("d", ""), ("e", "never"), ("f", None)], "instance_id string, mode string")
    held = spark.createDataFrame([("a", "1"), ("b", "1")], "instance_id string, offset string")
    assert rows(snapshot.should_snapshot(inst, held), "instance_id", "snapshot") == [("a", True), ("b", False), ("c", True), ("d", True), ("e", False), ("f", True)]
    assert reading.read_offsets(inst, held).filter("offset = ''").count() == 4


def test_dedup_window_restarts(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, "m", t0 + dt.timedelta(seconds=s)) for i, s in enumerate((0, 100, 130, 200))] + [(9, None, t0), (10, None, t0)]
    got = logs.dedup_messages(spark.createDataFrame(data, "seq long, msg_id string, ts timestamp"))
    assert rows(got, "seq") == [(0,), (2,), (9,), (10,)]


def test_failures(spark):
    df = spark.createDataFrame([(1, 9), (2, 10), (3, 11)], "seq long, attempts int")
    assert rows(logs.route_failures(df), "seq", "route") == [(1, "redeliver"), (2, "dlq"), (3, "dlq")]
    jittered = logs.retry_schedule(df, jitter=True).collect()
    assert all(1000 <= r["delay_ms"] < 1500 for r in jittered)
    kinds = spark.createDataFrame([("schema",), ("Network",), (None,)], "k string")
    assert [r[0] for r in kinds.select(logs.classify_error(F.col("k"))).collect()] == [False, True, True]


def test_metrics_text(spark):
    lines = ["# c", "", 'a{x="1",y="z"} 2', "b 1.5e3", "garbage", 'c{} NaN?']
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(scalars.parse_metrics_line(F.col("l")).alias("m")).filter("m is not null").select("m.*").collect()
    assert [(r["name"], r["labels"], r["value"]) for r in got] == [("a", {"x": "1", "y": "z"}, 2.0), ("b", {}, 1500.0)]
    h = metrics.histogram(spark.createDataFrame([(1.0,), (7.0,), (2000.0,)], "v double"), "v", metrics.BATCH_BOUNDS)
    assert [(r["le"], r["n"]) for r in h.collect()] == [("1", 1), ("5", 1), ("10", 2), ("25", 2), ("50", 2), ("100", 2), ("250", 2), ("500", 2), ("1000", 2), ("+Inf", 3)]


def test_registry():
    with pytest.raises(ValueError, match="known are append, bulk, console, kv, routed, table, webhook"):
        builder(SINKS, "nope")
    with pytest.raises(ValueError, match="missing options path"):
        PipelineSpec([SourceSpec("i")]).check()
    with pytest.raises(ValueError, match="differ"):
        PipelineSpec([], [SinkSpec("a"), SinkSpec("a")]).check()


def test_snapshot_handler(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert rows(snapshot.handle_rows(df, lambda p: p.assign(v=p["v"].str.upper())), "id", "v") == [(1, "A"), (2, "B")]


def test_delta_across_spans(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 9, 7), ("a", 35, None), ("a", 36, 9), ("b", 2, 1)], "s string, at long, v long")
    got = {(r["s"], r["at"]): r["delta"] for r in metrics.throughput_delta(df, "s", "at", "v", span=10).collect()}
    assert got == {("a", 1): None, ("a", 9): 2, ("a", 35): None, ("a", 36): None, ("b", 2): None}


def test_order_holds_over_spans_of_a_source(spark, tmp_path):
    n = 600_000
    events = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.lit('{"k": 1}').alias("props"), F.lit(1.0).alias("value"), F.lit("view").alias("event_type"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"))
    events.repartition(7, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["sl1_order_changes"](spark, str(tmp_path)).toPandas()
    keys = list(zip(got["instance_id"], got["lsn"], got["seq"], strict=True))
    assert len(keys) == n and keys == sorted(keys)


def test_subject_filter_of_dotted_names(spark):
    rows = [(1, "cdc", "i", "public", "a.b"), (2, "cdc", "i.j", "public", "t"), (3, "cdc", "i", "public", "t"), (4, "", "i", "s.x", "t"), (5, None, "i", None, "t")]
    log = spark.createDataFrame(rows, "seq long, topic string, instance_id string, schema string, tbl string")
    log = log.withColumn("subject", routing.build_subject(F.col("topic"), F.col("instance_id"), F.col("schema"), F.col("tbl")))
    for pattern in ("cdc.i.public.a_b", "cdc.i.j.public.t", "cdc.*.public.*", "cdc.i.>", "cdc.i.s_x.t", "cdc.i.t", "cdc.i.*.t"):
        want = {r["seq"] for r in log.filter(filters.subject_match(F.col("subject"), [pattern])).collect()}
        assert want and {r["seq"] for r in filters.subject_filter(log, pattern).collect()} == want


def test_renames_that_share_a_target_are_refused():
    with pytest.raises(ValueError, match="share"):
        filters.rename_fields(F.col("image"), {"a": "c", "b": "c"})


def test_long_table_lists(spark):
    log = spark.createDataFrame([(1, "s", "t7"), (2, "s", "u"), (3, "s", "v")], "seq long, schema string, tbl string")
    got = filters.table_allowed(log, [f"t{i}" for i in range(3000)] + ["s.u"])
    assert {r["seq"] for r in got.collect()} == {1, 2} and "Join" not in got._jdf.queryExecution().toString()
