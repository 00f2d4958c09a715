"""One registered query per operator over the test tables, with its SQL.

Every query reads whole tables; ``CHG`` and ``DEL`` are the SQL twins of
``plans.canonical.change_log`` and ``deliveries``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changefold.functions import scalars
from changefold.model import ENVELOPE
from changefold.operators import acks, actions, explorer, filters, merge, metrics, routing
from changefold.plans import pipeline
from changefold.plans.canonical import change_log, deliveries, table
from changefold.plans.scratch import scratch_dir
from changefold.sources import changes as reading
from changefold.sources import decode, snapshot
from changefold.streaming import log as logs
from changefold.streaming import letters, observe, seek, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CHG = """chg AS (SELECT event_id + 1 AS seq, event_id + 1 AS lsn, CAST(event_id + 1 AS VARCHAR) AS "offset", 'inst' || (user_id % 3) AS instance_id, 'public' AS "schema",
  CASE WHEN event_type = 'purchase' THEN 'purchases' ELSE 'accounts' END AS tbl, CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, user_id AS pk, ts, event_type,
  event_type <> 'view' AS value_present, CASE WHEN event_type <> 'view' AND event_id % 17 <> 0 THEN value END AS value, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, 'cdc' AS topic FROM events),
log AS (SELECT *, topic || '.' || instance_id || '.' || "schema" || '.' || tbl AS subject FROM chg)"""
DEL = """del AS (SELECT seq, instance_id, lsn, "offset", ts, subject, sink, CAST(1 + (seq - 1) % 12 AS INTEGER) AS attempts, (seq - 1) % 7 <> 0 AS acked,
  CASE WHEN (seq - 1) % 7 = 0 THEN (['network', 'validation', 'timeout', 'schema'])[seq % 4 + 1] END AS error_class, ts AS last_attempt
  FROM log, (VALUES ('search'), ('store')) AS s(sink) WHERE sink = 'store' OR (seq - 1) % 5 <> 0)"""
NOW = "2024-01-20 00:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL, in which {CHG} and {DEL} stand for the shared CTEs."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.replace("{CHG}", CHG).replace("{DEL}", f"{CHG},\n{DEL}").replace("{NOW}", NOW)
        return f

    return add


# --- sources ---------------------------------------------------------------------------


def _kept(spark, df, label):
    """The path of a scratch folder to which a frame is written."""
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return path


def _envelopes(spark, d):
    return change_log(spark, d).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENVELOPE])


@query("src1_read_changes", "WITH {CHG} SELECT seq, op, tbl, lsn FROM log WHERE lsn > 100")
def src1(spark, d):
    path = _kept(spark, _envelopes(spark, d), "changes")
    return reading.read_changes(spark, path, after=F.col("lsn") > 100).select("seq", "op", "tbl", "lsn")


@query(
    "src8_snapshot_to_events",
    "SELECT 'inst0' AS instance_id, 'public' AS \"schema\", 'orders' AS tbl, 'r' AS op, 0 AS lsn, CAST(o_orderkey AS VARCHAR) "
    "AS id, o_orderstatus AS status, o_orderkey AS ordinal, 32 AS id_length FROM orders",
)
def src8(spark, d):
    events = snapshot.snapshot_to_events(table(spark, d, "orders"), "public.orders", "inst0", "o_orderkey")
    return events.select(
        "instance_id", "schema", "tbl", "op", "lsn", F.col("after")["o_orderkey"].alias("id"), F.col("after")["o_orderstatus"].alias("status"), "ordinal",
        F.length("row_id").alias("id_length"),
    )


LINE_SUMS = "count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(sum(l_orderkey) AS BIGINT) AS orders, CAST(sum(l_linenumber) AS BIGINT) AS lines"


@query(
    "src8_snapshot_through_log",
    f"SELECT 'lineitem' AS tbl, l_returnflag AS kind, {LINE_SUMS} FROM lineitem GROUP BY 2 UNION ALL SELECT 'customer', c_mktsegment, count(*), NULL, CAST(sum(c_custkey) AS BIGINT), NULL FROM customer GROUP BY 2",
)
def src8_log(spark, d):
    """Snapshots through the log and its dedup: lineitem, whose order keys repeat, and customers, keyed by
    name. The second start of the pipeline adds nothing. The tables are read where they lie."""
    out = scratch_dir(spark, "src8")
    sources = [pipeline.SourceSpec("crm", "snapshot", options={"path": f"{d}/{t}.parquet", "table": t}) for t in ("lineitem", "customer")]
    for _ in range(2):
        pipeline.Pipeline(spark, pipeline.PipelineSpec(sources, log=f"{out}/log"), f"{out}/cursors").run_once()
    after = F.col("after")
    log = spark.read.parquet(f"{out}/log").select("tbl", F.coalesce(after["l_returnflag"], after["c_mktsegment"]).alias("kind"), "after")
    number = lambda c, t: F.sum(after[c].cast(t))
    return log.groupBy("tbl", "kind").agg(
        F.count("*").alias("n"), number("l_quantity", "double").alias("quantity"), F.coalesce(number("l_orderkey", "long"), number("c_custkey", "long")).alias("orders"),
        number("l_linenumber", "long").alias("lines"),
    )


@query("src8_keyless_rows", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, count(*) AS ids FROM lineitem GROUP BY 1, 2")
def src8_keyless(spark, d):
    """Two columns of lineitem, of which a few values fill the table: each copy has an id of its own. Ids are much alike
    and shuffled in few bytes, so they are counted by as many tasks as there are rows for, not bytes."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    events = snapshot.snapshot_to_events(rows, "flags", "inst0")
    messages = logs.to_messages(events).select("msg_id", F.col("after")["l_returnflag"].alias("flag"), F.col("after")["l_linestatus"].alias("status"))
    messages = messages.repartition(snapshot.tasks_for(rows), "msg_id")
    return messages.groupBy("flag", "status").agg(F.count("*").alias("n"), F.count_distinct("msg_id").alias("ids"))


def _instances(spark, d):
    modes = F.element_at(F.array(F.lit("always"), F.lit("INITIAL"), F.lit(""), F.lit("never"), F.lit("Initial")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select(F.concat(F.lit("inst"), F.col("c_custkey").cast("string")).alias("instance_id"), modes.alias("mode"))


def _offsets(spark, d):
    return table(spark, d, "customer").filter("c_nationkey < 12").select(
        F.concat(F.lit("inst"), F.col("c_custkey").cast("string")).alias("instance_id"),
        F.when(F.col("c_nationkey") < 3, "").otherwise(F.col("c_custkey").cast("string")).alias("offset"),
    )


OFFSETS = """inst AS (SELECT 'inst' || c_custkey AS instance_id, (['always', 'INITIAL', '', 'never', 'Initial'])[c_custkey % 5 + 1] AS mode FROM customer),
off AS (SELECT 'inst' || c_custkey AS instance_id, CASE WHEN c_nationkey < 3 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS o FROM customer WHERE c_nationkey < 12)"""


@query(
    "src9_should_snapshot",
    f"WITH {OFFSETS} SELECT i.instance_id, mode, CASE WHEN lower(mode) = 'always' THEN true WHEN lower(mode) IN ('initial', '') "
    f"THEN coalesce(o, '') = '' ELSE false END AS snapshot FROM inst i LEFT JOIN off ON off.instance_id = i.instance_id",
)
def src9(spark, d):
    return snapshot.should_snapshot(_instances(spark, d), _offsets(spark, d))


TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


@query(
    "src10_plan_chunks",
    "WITH t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in TABLES) + "), c AS (SELECT tbl, n, greatest(CAST(ceil(n / 8000.0) AS BIGINT), 1) AS k FROM t), x AS (SELECT tbl, n, k, unnest(range(k)) AS chunk_index FROM c) SELECT tbl, chunk_index, chunk_index * 8000 AS chunk_start, least(8000, n - chunk_index * 8000) AS chunk_size, chunk_index = k - 1 AS is_last_chunk FROM x",
)
def src10(spark, d):
    counts = reading.fan_in(*[table(spark, d, t).agg(F.lit(t).alias("tbl"), F.count("*").alias("n_rows")) for t in TABLES])
    return snapshot.plan_chunks(counts)


def _chunk_sums(rows):
    return rows.groupBy("chunk_index").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custs"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


SUMS = "count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS custs, min(o_orderkey) AS lo, max(o_orderkey) AS hi"


def _with_ctid(spark, d):
    block, item = (F.col("o_orderkey") / 100).cast("long").cast("string"), (F.col("o_orderkey") % 100).cast("string")
    return table(spark, d, "orders").withColumn("ctid", F.concat(F.lit("("), block, F.lit(","), item, F.lit(")")))


@query("src11_read_chunk", f"SELECT CASE WHEN o_orderkey < 100 THEN 0 WHEN o_orderkey < 1000 THEN 1 ELSE 2 END AS chunk_index, {SUMS} FROM orders GROUP BY 1")
def src11(spark, d):
    orders, bounds = table(spark, d, "orders"), [(0, 100), (100, 1000), (1000, None)]
    parts = [snapshot.read_chunk(orders, "o_orderkey", *b, strategy="auto").withColumn("chunk_index", F.lit(i)) for i, b in enumerate(bounds)]
    return _chunk_sums(reading.fan_in(*parts))


@query("src11_integer_chunks", f"SELECT o_orderkey // 8000 AS chunk_index, {SUMS} FROM orders GROUP BY 1")
def src11_integer(spark, d):
    return _chunk_sums(snapshot.read_chunks(table(spark, d, "orders"), "o_orderkey", 8000))


@query("src11_ctid_chunks", f"SELECT o_orderkey // 100 // 7 AS chunk_index, {SUMS} FROM orders GROUP BY 1")
def src11_ctid(spark, d):
    return _chunk_sums(snapshot.read_chunks(_with_ctid(spark, d), "ctid", 7, "auto"))


@query(
    "src11_offset_chunks",
    f"SELECT chunk_index, {SUMS} FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS chunk_index FROM orders) "
    f"GROUP BY 1",
)
def src11_offset(spark, d):
    return _chunk_sums(snapshot.read_chunks(table(spark, d, "orders"), "o_orderkey", 700, "offset"))


def _chunks(spark, d):
    o = table(spark, d, "orders")
    status = F.element_at(F.array(F.lit("pending"), F.lit("in_progress"), F.lit("completed")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(
        F.concat(F.lit("slot"), (F.col("o_custkey") % 10).cast("string")).alias("slot_name"), F.lit("orders").alias("tbl"),
        F.col("o_orderkey").alias("chunk_index"), status.alias("status"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(secs=(F.col("o_orderkey") % 60))).alias("heartbeat_at"),
        F.when(status == "completed", F.col("o_custkey")).alias("rows_processed"),
    )


CHUNKS = "ck AS (SELECT 'slot' || (o_custkey % 10) AS slot_name, 'orders' AS tbl, o_orderkey AS chunk_index, (['pending', 'in_progress', 'completed'])[o_orderkey % 3 + 1] AS status, o_orderkey % 60 AS age, CASE WHEN o_orderkey % 3 = 2 THEN o_custkey END AS rows_processed FROM orders)"


@query(
    "src12_claimable_chunks",
    f"WITH {CHUNKS} SELECT slot_name, chunk_index, status FROM ck WHERE status = 'pending' OR (status = 'in_progress' AND age > "
    f"30)",
)
def src12(spark, d):
    return snapshot.claimable_chunks(_chunks(spark, d), NOW).select("slot_name", "chunk_index", "status")


@query(
    "src13_snapshot_progress",
    f"WITH {CHUNKS} SELECT slot_name, count(*) AS total_chunks, count(*) FILTER (status = 'completed') AS completed_chunks, CAST(coalesce(sum(rows_processed), "
    f"0) AS BIGINT) AS rows_processed, count(*) FILTER (status = 'completed') = count(*) AS completed FROM ck GROUP BY 1",
)
def src13(spark, d):
    return snapshot.snapshot_progress(_chunks(spark, d))


@query(
    "src14_hand_off",
    "WITH {CHG}, s AS (SELECT 0 AS phase, 0 AS lsn, 'r' AS op, CAST(c_custkey AS VARCHAR) AS id FROM customer) SELECT * FROM s "
    "UNION ALL SELECT 1, lsn, op, CAST(pk AS VARCHAR) FROM log WHERE lsn > 200",
)
def src14(spark, d):
    first = snapshot.snapshot_to_events(table(spark, d, "customer"), "accounts", "inst0", "c_custkey").withColumn("id", F.col("after")["c_custkey"])
    later = change_log(spark, d).select("lsn", "op", F.coalesce("before", "after")["id"].alias("id"))
    return snapshot.hand_off(first.select("lsn", "op", "id"), later, 200).select("phase", "lsn", "op", "id")


@query(
    "src14_hand_off_stream",
    "WITH {CHG}, s AS (SELECT 0 AS phase, 'r' AS op, CAST(c_custkey AS VARCHAR) AS id FROM customer) SELECT * FROM s "
    "UNION ALL SELECT 1, op, CAST(pk AS VARCHAR) FROM log WHERE lsn > 200",
)
def src14_stream(spark, d):
    """The same through a pipeline that is stopped inside the snapshot, between two of its four files, and
    started again."""
    out = scratch_dir(spark, "src14")
    table(spark, d, "customer").repartition(4).write.parquet(f"{out}/customer")
    _envelopes(spark, d).write.parquet(f"{out}/changes")
    source = pipeline.SourceSpec("inst0", "handoff", options={"path": f"{out}/customer", "table": "customer", "changes": f"{out}/changes", "lsn": 200, "files_per_trigger": 1})
    make = lambda: pipeline.Pipeline(spark, pipeline.PipelineSpec([source], log=f"{out}/log"), f"{out}/cursors")
    first = make().snapshots({"processingTime": "1 second"})
    while not first.recentProgress:
        time.sleep(0.05)
    first.stop()
    for _ in range(2):
        make().run_once()
    id_ = F.coalesce(F.col("after")["c_custkey"], F.coalesce("before", "after")["id"])
    return spark.read.parquet(f"{out}/log").select(F.when(F.col("op") == "r", 0).otherwise(1).alias("phase"), "op", id_.alias("id"))


@query("src15_read_offsets", f'WITH {OFFSETS} SELECT i.instance_id, coalesce(o, \'\') AS "offset" FROM inst i LEFT JOIN off ON off.instance_id = i.instance_id')
def src15(spark, d):
    return reading.read_offsets(_instances(spark, d), _offsets(spark, d))


@query(
    "jn2_offset_lookup",
    f"WITH {OFFSETS} SELECT count(*) AS n, count(*) FILTER (coalesce(o, '') = '') AS without FROM inst i LEFT JOIN off ON off.instance_id "
    f"= i.instance_id",
)
def jn2(spark, d):
    got = reading.read_offsets(_instances(spark, d), _offsets(spark, d))
    return got.agg(F.count("*").alias("n"), F.count_if(F.col("offset") == "").alias("without"))


# --- sinks -----------------------------------------------------------------------------


@query("io2_console_sink", """WITH {CHG}, p AS (SELECT *, '{"id":"' || pk || '","k":"' || k || '"' || CASE WHEN value_present THEN ',"value":' || coalesce('"' || value || '"', 'null') ELSE '' END || '}' AS payload FROM log)
  SELECT seq, '[' || instance_id || '] ' || op || ' ' || "schema" || '.' || tbl || ' lsn=' || lsn || ' offset=' || "offset" || ' size=' || length(payload) AS line FROM p""")
def io2(spark, d):
    return actions.console_lines(change_log(spark, d))


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").cast("long").alias("k"))


FOLD = """acc AS (SELECT * FROM log WHERE tbl = 'accounts'),
dp AS (SELECT pk, max(seq) AS dp FROM acc WHERE op = 'd' GROUP BY pk),
live AS (SELECT a.* FROM acc a LEFT JOIN dp ON dp.pk = a.pk WHERE op <> 'd' AND (dp.dp IS NULL OR seq > dp.dp)),
lv AS (SELECT pk, value, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS r FROM live WHERE value_present),
lk AS (SELECT pk, k, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS r FROM live),
f AS (SELECT lk.pk, lk.k, lv.pk IS NOT NULL AS has_v, lv.value FROM lk LEFT JOIN lv ON lv.pk = lk.pk AND lv.r = 1 WHERE lk.r = 1),
res AS (SELECT coalesce(b.c_custkey, f.pk) AS id, CASE WHEN f.has_v THEN f.value WHEN dp.dp IS NULL THEN b.c_acctbal END AS value, CASE WHEN f.pk IS NOT NULL THEN f.k WHEN dp.dp IS NULL THEN b.c_nationkey END AS k
  FROM customer b FULL JOIN f ON f.pk = b.c_custkey LEFT JOIN dp ON dp.pk = coalesce(b.c_custkey, f.pk) WHERE NOT (dp.dp IS NOT NULL AND f.pk IS NULL))"""


def _accounts(spark, d):
    rows = filters.select_image(change_log(spark, d).filter("tbl = 'accounts'"))
    known, _ = merge.split_ops(rows)
    return merge.split_keyless(known, kind="bigint")[0]


def apply_accounts(spark, d):
    return merge.apply_changes(_accounts(spark, d), _customers(spark, d), "id", ["lsn", "seq"])


query("io3_apply_changes", "WITH {CHG}, " + FOLD + " SELECT id, value, k FROM res")(apply_accounts)


@query(
    "io3_latest_rows",
    "WITH {CHG}, r AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY lsn DESC) AS r FROM log) SELECT pk, op, lsn, value, "
    "k FROM r WHERE r = 1 AND op <> 'd'",
)
def latest(spark, d):
    rows = change_log(spark, d).select("pk", "op", "lsn", "seq", "value", "k")
    return merge.latest_rows(rows, ["pk"], ["lsn", "seq"]).select("pk", "op", "lsn", "value", "k")


@query("io5_known_ops", "WITH {CHG} SELECT CASE WHEN k < 10 THEN 'x' ELSE op END AS op, k >= 10 AS known, count(*) AS n FROM log GROUP BY 1, 2")
def io5(spark, d):
    known, rejected = merge.split_ops(change_log(spark, d).withColumn("op", F.when(F.col("k") < 10, "x").otherwise(F.col("op"))))
    both = known.withColumn("known", F.lit(True)).select("op", "known").unionByName(rejected.withColumn("known", F.lit(False)).select("op", "known"))
    return both.groupBy("op", "known").agg(F.count("*").alias("n"))


def _routed(spark, d, **kw):
    return routing.route_target(filters.select_image(change_log(spark, d)), **kw)


@query("io7_append_sink", "WITH {CHG} SELECT seq, tbl AS target, op, pk AS id, value, k FROM log")
def io7(spark, d):
    return actions.append_rows(_routed(spark, d), {"id": "bigint", "value": "double", "k": "bigint"})


@query(
    "io8_bulk_actions",
    "WITH {CHG} SELECT seq, CASE WHEN op = 'd' THEN 'delete' ELSE 'index' END AS action, 'cdc_' || instance_id || '_' || tbl AS "
    "target, CAST(pk AS VARCHAR) AS doc_id, CASE WHEN op <> 'd' THEN k END AS k FROM log",
)
def io8(spark, d):
    return actions.bulk_actions(_routed(spark, d, prefix="cdc_")).select("seq", "action", "target", "doc_id", F.col("doc")["k"].cast("long").alias("k"))


@query(
    "io10_kv_commands",
    "WITH {CHG} SELECT seq, CASE WHEN op = 'd' THEN 'DEL' ELSE 'HSET' END AS command, 'cdc:' || instance_id || ':' || tbl || ':' "
    "|| pk AS key, CASE WHEN op <> 'd' THEN k END AS k, CASE WHEN op <> 'd' THEN 60 END AS ttl FROM log",
)
def io10(spark, d):
    rows = routing.build_key(filters.select_image(change_log(spark, d)))
    return actions.kv_commands(rows, "hset", 60).select("seq", "command", "key", F.try_element_at("args", F.lit("k")).cast("long").alias("k"), "ttl")


@query("io10_kv_set_commands", "WITH {CHG} SELECT seq, CASE WHEN op = 'd' THEN 'SREM' ELSE 'SADD' END AS command, CAST(k AS VARCHAR) AS member FROM log")
def io10b(spark, d):
    rows = routing.build_key(filters.select_image(change_log(spark, d)))
    return actions.kv_commands(rows, "sadd", value=routing.value_fields(F.col("image"), ["k"])).select("seq", "command", F.col("args")["member"].alias("member"))


@query("io11_kv_state", """WITH {CHG}, c AS (SELECT *, 'cdc:' || instance_id || ':' || tbl || ':' || pk AS key FROM log), cut AS (SELECT key, max(seq) FILTER (op = 'd') AS cut, max(seq) AS last, max(seq) FILTER (op <> 'd') AS live FROM c GROUP BY key),
  a AS (SELECT c.* FROM c JOIN cut USING (key) WHERE op <> 'd' AND (cut IS NULL OR seq > cut)), r AS (SELECT key, k, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM a),
  v AS (SELECT key, max(value_present) AS has_value FROM (SELECT key, value_present FROM a) GROUP BY key)
  SELECT r.key, 'hash' AS kind, k, CASE WHEN has_value THEN 3 ELSE 2 END AS n_fields FROM r JOIN v ON v.key = r.key WHERE r = 1""")
def io11(spark, d):
    rows = routing.build_key(filters.select_image(change_log(spark, d)))
    entries = merge.kv_entries(actions.kv_commands(rows, "hset"))
    k = F.max(F.when(F.col("field") == "k", F.col("value"))).cast("long")
    return entries.groupBy("key", "kind").agg(k.alias("k"), F.count("*").cast("int").alias("n_fields"))


def _fanned(spark, d):
    """The log of three more instances with the same, sparse numbers: no seq counts 1, 2, 3 ..."""
    log = change_log(spark, d).withColumn("seq", F.col("seq") * 1000)
    return log.unionByName(log.withColumn("instance_id", F.concat(F.lit("more"), "instance_id")))


@query(
    "io12_webhook_batches",
    "WITH {CHG} SELECT p || instance_id AS instance_id, op, tbl, \"offset\", lsn, true AS bounded FROM log, (VALUES (''), ('more')) AS v(p)",
)
def io12(spark, d):
    """What posts of at most 100 changes and 8,000 bytes hold."""
    posts = actions.webhook_batches(_fanned(spark, d), 100, max_bytes=8000)
    each = "array<struct<instance_id:string,table:string,op:string,offset:string,lsn:bigint>>"
    bounded = (F.col("n") <= 100) & (F.col("bytes") <= 8000) & (F.octet_length("value") == F.col("bytes")) & (F.size("c") == F.col("n"))
    rows = posts.withColumn("c", F.from_json("value", each)).select(F.explode("c").alias("e"), bounded.alias("bounded"))
    return rows.select("e.instance_id", "e.op", F.col("e.table").alias("tbl"), "e.offset", "e.lsn", "bounded")


@query(
    "io8_bulk_requests",
    "WITH {CHG} SELECT 'cdc_' || p || instance_id || '_' || tbl AS target, CAST(pk AS VARCHAR) AS doc_id, count(*) AS n, true AS bounded, true AS in_order FROM log, (VALUES (''), ('more')) AS v(p) GROUP BY 1, 2",
)
def io8_requests(spark, d):
    """Actions by document in requests of at most 50 actions, and whether they are in order of k, set
    here to count with seq."""
    rows = routing.route_target(filters.select_image(_fanned(spark, d).withColumn("after", F.create_map(F.lit("id"), F.col("pk").cast("string"), F.lit("at"), F.col("seq").cast("string"))).withColumn("op", F.lit("u"))), prefix="cdc_")
    requests = actions.bulk_requests(actions.bulk_actions(rows), 50)
    lines = requests.select("task", "request", (F.col("n") <= 50).alias("bounded"), F.posexplode(F.split("value", "\n")).alias("line", "text")).filter("text <> ''")
    lines = lines.select("task", "request", "bounded", (F.col("line") / 2).cast("int").alias("place"), (F.col("line") % 2).alias("part"), "text")
    pairs = lines.groupBy("task", "request", "place", "bounded").agg(F.max(F.when(F.col("part") == 0, F.col("text"))).alias("head"), F.max(F.when(F.col("part") == 1, F.col("text"))).alias("doc"))
    head = F.from_json("head", "index struct<_index:string,_id:string>")["index"]
    each = pairs.select(head["_index"].alias("target"), head["_id"].alias("doc_id"), "bounded", F.struct("task", "request", "place").alias("p"), F.get_json_object("doc", "$.at").cast("long").alias("at"))
    before = F.lag("at").over(W.partitionBy("target", "doc_id").orderBy("p"))
    each = each.withColumn("rises", F.coalesce(before < F.col("at"), F.lit(True)))
    return each.groupBy("target", "doc_id").agg(F.count("*").alias("n"), F.every("bounded").alias("bounded"), F.every("rises").alias("in_order"))


@query(
    "io13_publish_log",
    "WITH {CHG} SELECT seq, subject, instance_id || '-' || \"offset\" AS msg_id, 6 AS n_headers, CAST(lsn AS VARCHAR) AS lsn_header "
    "FROM log",
)
def io13(spark, d):
    path = scratch_dir(spark, "log")
    logs.publish_log(logs.to_messages(change_log(spark, d).drop("topic", "subject")), path)
    m = spark.read.parquet(path)
    return m.select("seq", "subject", "msg_id", F.size("headers").alias("n_headers"), F.col("headers")["lsn"].alias("lsn_header"))


@query(
    "io14_infer_sink_schema",
    "WITH {CHG} SELECT tbl AS target, unnest(['id', 'k', 'value', 'flag', 'note', 'tags']) AS \"column\", unnest(['DOUBLE PRECISION', "
    "'DOUBLE PRECISION', 'DOUBLE PRECISION', 'BOOLEAN', 'TEXT', 'JSONB']) AS type FROM (SELECT DISTINCT tbl FROM log)",
)
def io14(spark, d):
    rows = change_log(spark, d).select(
        F.col("tbl").alias("target"),
        F.to_json(F.struct(F.col("pk").alias("id"), "k", "value", (F.col("k") > 50).alias("flag"), F.col("event_type").alias("note"), F.array("k").alias("tags"))).alias("data"),
    )
    return actions.infer_sink_schema(rows)


@query(
    "io14_evolving_table",
    "SELECT o_orderkey AS id, o_orderkey % 3 AS part, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS note, "
    "CASE WHEN o_orderkey % 3 = 2 THEN o_custkey || 'x' ELSE CAST(o_custkey AS VARCHAR) END AS cust, 'bigint double string string' AS types FROM orders",
)
def io14_evolving(spark, d):
    """A table that is declared with its key alone. Of three batches the second has a field more, and
    the third another, and customers that are no numbers any more."""
    part = F.col("o_orderkey") % 3
    text = lambda c: F.col(c).cast("string")
    cust = F.when(part == 2, F.concat(text("o_custkey"), F.lit("x"))).otherwise(text("o_custkey"))
    names = F.array(*[F.lit(n) for n in ("id", "part", "cust", "price", "note")])
    image = F.map_filter(F.map_from_arrays(names, F.array(text("o_orderkey"), part.cast("string"), cust, text("o_totalprice"), text("o_orderstatus"))), lambda k, v: ((k != "price") | (part > 0)) & ((k != "note") | (part == 2)))
    rows = table(spark, d, "orders").select(part.alias("part"), F.col("o_orderkey").alias("key"), F.lit("c").alias("op"), image.alias("image"), F.col("o_orderkey").alias("lsn"), F.col("o_orderkey").alias("seq"))
    schema = spark.createDataFrame([], "id long").schema
    kept = tables.MergeTable(f"{scratch_dir(spark, 'io14')}/t", "id", schema, ["lsn", "seq"], buckets=4, compact=2, evolve=True)
    for i in range(3):
        kept.add(rows.filter(F.col("part") == i))
    got = kept.read(spark)
    kinds = " ".join(dict(got.dtypes)[c] for c in ("part", "price", "note", "cust"))
    return got.select("id", "part", "price", "note", "cust", F.lit(kinds).alias("types"))


# --- filters and projections -----------------------------------------------------------


@query("pf1_table_allowed", "WITH {CHG} SELECT seq FROM log WHERE tbl = 'purchases'")
def pf1(spark, d):
    return filters.table_allowed(change_log(spark, d), ["public.purchases", "other"]).select("seq")


@query("pf2_table_regex_allowed", "WITH {CHG} SELECT seq FROM log WHERE \"schema\" || '.' || tbl = 'public.accounts'")
def pf2(spark, d):
    return filters.table_regex_allowed(change_log(spark, d), ["public.accounts", "x.y"]).select("seq")


@query("pf3_apply_filters", "WITH {CHG} SELECT seq FROM log WHERE op <> 'd' AND value > 50")
def pf3(spark, d):
    return filters.apply_filters(change_log(spark, d), ["op <> 'd'", lambda df: df["value"] > 50]).select("seq")


@query("pf4_apply_transformers", "WITH {CHG} SELECT seq, upper(tbl) AS tbl FROM log WHERE k % 2 = 0")
def pf4(spark, d):
    steps = [lambda df: df.withColumn("tbl", F.upper("tbl")), lambda df: df.filter("k % 2 = 0")]
    return filters.apply_transformers(change_log(spark, d), steps).select("seq", "tbl")


@query("pf5_subject_match", "WITH {CHG} SELECT seq FROM log WHERE subject LIKE 'cdc.%.public.purchases' OR subject LIKE 'cdc.inst1.%'")
def pf5(spark, d):
    return change_log(spark, d).filter(filters.subject_match(F.col("subject"), ["cdc.*.public.purchases", "cdc.inst1.>"])).select("seq")


@query(
    "pf5_subject_filter",
    "WITH {CHG} SELECT seq, 'cdc.' || instance_id || '.public.' || tbl || '_v1' AS subject FROM log WHERE instance_id = 'inst1' "
    "AND tbl = 'purchases'",
)
def pf5_filter(spark, d):
    log = change_log(spark, d).withColumn("tbl", F.concat("tbl", F.lit(".v1")))
    log = log.withColumn("subject", routing.build_subject(F.col("topic"), F.col("instance_id"), F.col("schema"), F.col("tbl")))
    return filters.subject_filter(log, "cdc.inst1.public.purchases_v1").select("seq", "subject")


@query("so3_multi_subject", "WITH {CHG} SELECT instance_id, count(*) AS n FROM log WHERE instance_id IN ('inst0', 'inst2') GROUP BY 1")
def so3(spark, d):
    rows = change_log(spark, d).filter(filters.subject_match(F.col("subject"), ["cdc.inst0.>", "cdc.inst2.>", "cdc.inst0.*.*"]))
    return rows.groupBy("instance_id").agg(F.count("*").alias("n"))


@query("pf6_select_image", "WITH {CHG} SELECT seq, CAST(pk AS VARCHAR) AS id, value_present AS has_value FROM log")
def pf6(spark, d):
    return filters.select_image(change_log(spark, d)).select("seq", F.col("image")["id"].alias("id"), F.map_contains_key("image", F.lit("value")).alias("has_value"))


@query("pf7_rename_fields", "WITH {CHG} SELECT seq, CAST(pk AS VARCHAR) AS user, k, value_present AS has_amount FROM log")
def pf7(spark, d):
    image = filters.rename_fields(F.col("image"), {"id": "user", "value": "amount", "none": "k"})
    rows = filters.select_image(change_log(spark, d)).withColumn("image", image)
    return rows.select("seq", F.col("image")["user"].alias("user"), F.col("image")["k"].cast("long").alias("k"), F.map_contains_key("image", F.lit("amount")).alias("has_amount"))


@query("pf8_compute_fields", "WITH {CHG} SELECT seq, k * 2 AS twice, pk + 1 AS id, k + pk AS both FROM log")
def pf8(spark, d):
    rows = filters.compute_fields(
        filters.select_image(change_log(spark, d)),
        {"twice": "cast(data.k as bigint) * 2", "id": "cast(data['id'] as bigint) + 1", "both": "cast(data.k as bigint) + cast(data.id as bigint)"},
    )
    return rows.select("seq", *[F.col("image")[c].cast("long").alias(c) for c in ("twice", "id", "both")])


@query("ud3_field_expressions", "WITH {CHG} SELECT seq, round(coalesce(value, 0) * 1.5, 4) AS score FROM log")
def ud3(spark, d):
    rows = filters.compute_fields(filters.select_image(change_log(spark, d)), {"score": "coalesce(try_cast(try_element_at(data, 'value') as double), 0) * 1.5"})
    return rows.select("seq", F.round(F.col("image")["score"].cast("double"), 4).alias("score"))


@query("pf9_headers_to_event", "WITH {CHG} SELECT seq, topic, subject, instance_id, \"schema\", tbl, op, \"offset\", lsn FROM log")
def pf9(spark, d):
    return filters.headers_to_event(change_log(spark, d))


@query(
    "pf10_build_envelope",
    "WITH {CHG} SELECT seq, op, epoch_us(ts) // 1000 AS ts_ms, 'postgres' AS connector, 'false' AS snapshot, tbl AS \"table\", "
    "lsn, op = 'd' AS has_before FROM log",
)
def pf10(spark, d):
    e = filters.build_envelope(change_log(spark, d), "postgres")
    return e.select(
        "seq", "payload.op", "payload.ts_ms", "payload.source.connector", "payload.source.snapshot", "payload.source.table", "payload.source.lsn",
        F.col("payload.before").isNotNull().alias("has_before"),
    )


@query(
    "pf11_build_subject",
    "SELECT p_partkey, 'cdc.inst' || p_partkey || '.' || replace(p_brand, '.', '_') || '.' || replace(p_name || '.v1', '.', '_') "
    "AS subject FROM part",
)
def pf11(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey",
        routing.build_subject(F.lit(""), F.concat(F.lit("inst"), F.col("p_partkey").cast("string")), F.col("p_brand"), F.concat("p_name", F.lit(".v1"))).alias("subject"),
    )


ROUTE = {"inst0.accounts": "zero", "purchases": "buys"}
ROUTE_SQL = "CASE WHEN instance_id = 'inst0' AND tbl = 'accounts' THEN 'zero' WHEN tbl = 'purchases' THEN 'buys' ELSE 'cdc_' || instance_id || '_' || tbl END"


@query("pf12_route_target", "WITH {CHG} SELECT seq, " + ROUTE_SQL + " AS target FROM log")
def pf12(spark, d):
    return routing.route_target(change_log(spark, d), ROUTE, prefix="cdc_").select("seq", "target")


@query("jn5_route_by_table", "WITH {CHG} SELECT target, count(*) AS n FROM (SELECT " + ROUTE_SQL + " AS target FROM log) GROUP BY 1")
def jn5(spark, d):
    mapping = spark.createDataFrame(list(ROUTE.items()), "name string, to string")
    return routing.route_target(change_log(spark, d), mapping, prefix="cdc_").groupBy("target").agg(F.count("*").alias("n"))


@query("pf13_value_fields", "WITH {CHG} SELECT seq, CAST(k AS VARCHAR) AS one, CAST(NULL AS VARCHAR) AS none, pk AS some_id FROM log")
def pf13(spark, d):
    rows = filters.select_image(change_log(spark, d))
    some = F.get_json_object(routing.value_fields(F.col("image"), ["id", "k"]), "$.id").cast("long")
    return rows.select("seq", routing.value_fields(F.col("image"), ["k"]).alias("one"), routing.value_fields(F.col("image"), ["zz"]).alias("none"), some.alias("some_id"))


@query("pf14_build_key", "WITH {CHG} SELECT seq, CASE WHEN k >= 50 THEN 'k' || k ELSE 'cdc:' || instance_id || ':' || tbl || ':' || pk END AS key FROM log")
def pf14(spark, d):
    rows = routing.build_key(filters.select_image(change_log(spark, d)), "case when cast(data.k as bigint) >= 50 then concat('k', data.k) end")
    return rows.select("seq", "key")


@query("ud4_key_expression", "WITH {CHG} SELECT key, count(*) AS n FROM (SELECT tbl || '/' || pk AS key FROM log) GROUP BY 1")
def ud4(spark, d):
    rows = routing.build_key(filters.select_image(change_log(spark, d)), "concat(tbl, '/', data.id)")
    return rows.groupBy("key").agg(F.count("*").alias("n"))


@query(
    "pf15_extract_id",
    "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END, CASE WHEN p_size % 2 = 0 THEN p_brand "
    "END, p_type) AS id FROM part",
)
def pf15(spark, d):
    image = F.map_filter(
        F.create_map(
            F.lit("guid"), "p_type", F.lit("ID"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("id"),
            F.when(F.col("p_size") % 3 == 0, F.col("p_partkey").cast("string")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return table(spark, d, "part").select("p_partkey", routing.extract_id(image).alias("id"))


FLOOR = "fl AS (SELECT coalesce(min(seq) FILTER (NOT coalesce(a, false)) - 1, max(seq), 0) AS ack_floor FROM (SELECT log.seq, d.acked AS a FROM log LEFT JOIN (SELECT * FROM del WHERE sink = 'store') d ON d.seq = log.seq))"


def _floor(spark, d, sink="store"):
    return explorer.consumer_info(change_log(spark, d), _acks(spark, d), sink)


def _acks(spark, d):
    """Deliveries in which the first gap comes late enough for the floor to be of use."""
    return deliveries(spark, d).withColumn("acked", F.col("acked") | (F.col("seq") <= 300))


ACKS = DEL.replace("(seq - 1) % 7 <> 0 AS acked", "((seq - 1) % 7 <> 0 OR seq <= 300) AS acked")


@query("pf16_status_filter", f"WITH {CHG}, {ACKS}, {FLOOR} SELECT seq, seq <= ack_floor AS sent FROM log, fl")
def pf16(spark, d):
    log, floor = change_log(spark, d), _floor(spark, d)
    sent, unsent = (routing.status_filter(log, floor, s).select("seq", F.lit(s == "sent").alias("sent")) for s in ("sent", "unsent"))
    return sent.unionByName(unsent)


# --- joins -----------------------------------------------------------------------------


@query(
    "jn3_upsert",
    "WITH n AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier) SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE "
    "c_custkey NOT IN (SELECT id FROM n) UNION ALL SELECT id, v FROM n",
)
def jn3(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return merge.upsert(base, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")), "id")


@query("jn4_delete_by_key", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)")
def jn4(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return merge.delete_keys(base, table(spark, d, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "jn6_missing_tables",
    "WITH {CHG} SELECT DISTINCT 'cdc_' || instance_id || '_' || tbl AS target FROM log WHERE NOT (instance_id = 'inst0' AND tbl "
    "= 'accounts')",
)
def jn6(spark, d):
    have = table(spark, d, "region").filter("r_regionkey = 0").select(F.lit("cdc_inst0_accounts").alias("name"))
    return merge.missing_tables(_routed(spark, d, prefix="cdc_"), have)


# --- aggregates ------------------------------------------------------------------------


@query("ag1_component_stats", """WITH {DEL}, e AS (SELECT sink, error_class, row_number() OVER (PARTITION BY sink ORDER BY seq DESC) AS r FROM del WHERE NOT acked)
  SELECT sink AS component, CAST(sum(1 + seq % 3) AS BIGINT) AS events, count(*) AS batches, count(*) FILTER (acked) AS success_count, count(*) FILTER (NOT acked) AS failure_count, (SELECT error_class FROM e WHERE e.sink = del.sink AND r = 1) AS last_error FROM del GROUP BY sink""")
def ag1(spark, d):
    rows = deliveries(spark, d).select(
        F.col("sink").alias("component"), F.col("seq").alias("pos"), (1 + F.col("seq") % 3).alias("events"), F.col("acked").alias("ok"),
        F.col("error_class").alias("error"),
    )
    return metrics.component_stats(rows)


@query("ag2_batch_offsets", "WITH {CHG} SELECT instance_id, tbl, CAST(max(seq) AS VARCHAR) AS last_offset, max(lsn) AS max_lsn FROM log GROUP BY 1, 2")
def ag2(spark, d):
    return metrics.batch_offsets(change_log(spark, d), "tbl")


@query("ag3_flushed_position", "WITH {DEL} SELECT instance_id, max(lsn) AS flushed FROM del WHERE acked GROUP BY 1")
def ag3(spark, d):
    acked = deliveries(spark, d).filter("acked")
    return metrics.flushed_position(acked.filter("lsn % 2 = 0"), metrics.flushed_position(acked.filter("lsn % 2 = 1")))


@query(
    "ag4_consumer_info",
    f"WITH {CHG}, {ACKS}, j AS (SELECT s.sink, log.seq, d.seq AS dseq, d.acked FROM log CROSS JOIN (VALUES ('search'), ('store')) "
    f"s(sink) LEFT JOIN del d ON d.seq = log.seq AND d.sink = s.sink) SELECT sink, coalesce(min(seq) FILTER (NOT coalesce(acked, "
    f"false)) - 1, max(seq), 0) AS ack_floor, count(*) FILTER (dseq IS NULL) AS pending FROM j GROUP BY sink",
)
def ag4(spark, d):
    return explorer.consumer_info(change_log(spark, d), _acks(spark, d), "search", "store")


@query(
    "ag4_ack_runs",
    f"WITH {CHG}, {ACKS}, j AS (SELECT s.sink, log.seq, d.seq AS dseq, d.acked FROM log CROSS JOIN (VALUES ('search'), ('store')) "
    f"s(sink) LEFT JOIN del d ON d.seq = log.seq AND d.sink = s.sink) SELECT sink, coalesce(min(seq) FILTER (NOT coalesce(acked, "
    f"false)) - 1, max(seq), 0) AS ack_floor, count(*) FILTER (dseq IS NULL) AS pending FROM j GROUP BY sink",
)
def ag4_runs(spark, d):
    """The same from runs of numbers that three batches of acknowledgements, in no order, have grown."""
    log, dealt, span = change_log(spark, d).select(F.lit("log").alias("sink"), "seq"), _acks(spark, d), 10_000
    state = {k: spark.createDataFrame([], acks.STATE) for k in ("log", "delivered", "acked")}
    for i in (1, 2, 0):
        part = lambda df, i=i: df.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == i)
        new = {"log": part(log), "delivered": part(dealt), "acked": part(dealt).filter("acked")}
        state = {k: spark.read.schema(acks.STATE).parquet(_kept(spark, acks.extend_runs(state[k], new[k].select("sink", "seq"), span), f"runs-{k}")) for k in state}
    return acks.info_of_runs(state["log"], state["delivered"], state["acked"], "search", "store")


@query(
    "ag5_stream_stats",
    "WITH {DEL} SELECT count(*) AS messages, CAST(sum(length(subject)) AS BIGINT) AS bytes, min(seq) AS first_seq, max(seq) AS "
    "last_seq, (SELECT count(DISTINCT sink) FROM del) AS consumers FROM log",
)
def ag5(spark, d):
    return explorer.stream_stats(change_log(spark, d).withColumn("bytes", F.octet_length("subject")), deliveries(spark, d))


@query("ag6_list_topics", "WITH {CHG} SELECT topic, count(*) AS message_count, count(DISTINCT subject) AS partition_count FROM log GROUP BY 1")
def ag6(spark, d):
    return explorer.list_topics(change_log(spark, d))


@query("ag7_list_partitions", "WITH {CHG} SELECT topic, subject, count(*) AS message_count FROM log GROUP BY 1, 2")
def ag7(spark, d):
    return explorer.list_partitions(change_log(spark, d), "cdc")


@query(
    "ag8_event_counters",
    "WITH {DEL} SELECT instance_id, CASE WHEN acked THEN 'success' ELSE 'failure' END AS status, count(*) AS total FROM del GROUP "
    "BY 1, 2",
)
def ag8(spark, d):
    return metrics.counters(deliveries(spark, d).withColumn("status", F.when(F.col("acked"), "success").otherwise("failure")), "instance_id", "status")


@query("ag9_error_counters", "WITH {DEL} SELECT instance_id, sink, error_class, count(*) AS total FROM del WHERE NOT acked GROUP BY 1, 2, 3")
def ag9(spark, d):
    return metrics.counters(deliveries(spark, d).filter("not acked"), "instance_id", "sink", "error_class")


def _bounds_sql(bounds: tuple) -> str:
    return ", ".join(f"('{b:g}', {b:g})" for b in bounds) + ", ('+Inf', CAST('inf' AS DOUBLE))"


@query(
    "ag10_batch_size_histogram",
    "WITH o AS (SELECT o_custkey % 7 AS grp, o_custkey AS v FROM orders) SELECT grp, le, count(*) FILTER (v <= b) AS n, count(*) AS total, CAST(sum(v) AS DOUBLE) AS sum FROM o, (VALUES " + _bounds_sql(metrics.BATCH_BOUNDS) + ") AS x(le, b) GROUP BY grp, le",
)
def ag10(spark, d):
    return metrics.histogram(table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("grp"), F.col("o_custkey").alias("v")), "v", metrics.BATCH_BOUNDS, "grp")


@query(
    "ag11_latency_histogram",
    "WITH o AS (SELECT l_linestatus AS sink, l_quantity / 8 AS v FROM lineitem) SELECT sink, le, count(*) FILTER (v <= b) AS n, count(*) AS total, sum(v) AS sum FROM o, (VALUES " + _bounds_sql(metrics.SECOND_BOUNDS) + ") AS x(le, b) GROUP BY sink, le",
)
def ag11(spark, d):
    return metrics.histogram(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("sink"), (F.col("l_quantity") / 8).alias("v")), "v", metrics.SECOND_BOUNDS, "sink")


@query("ag12_backlog_ratio", "SELECT o_orderkey AS name, o_custkey / (o_orderkey % 50) AS ratio FROM orders WHERE o_orderkey % 50 > 0")
def ag12(spark, d):
    return metrics.backlog_ratio(table(spark, d, "orders").select(
        F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("pending"), (F.col("o_orderkey") % 50).alias("capacity"),
    ))


@query(
    "ag14_dashboard_totals",
    "WITH {DEL} SELECT count(DISTINCT instance_id) AS sources, count(DISTINCT sink) AS sinks, count(*) FILTER (acked) AS processed "
    "FROM del",
)
def ag14(spark, d):
    return metrics.dashboard_totals(deliveries(spark, d))


@query("ag15_dlq_total", "WITH {DEL} SELECT count(*) AS dlq_total, (SELECT count(*) FROM log) AS total_messages FROM del WHERE NOT acked AND attempts >= 10")
def ag15(spark, d):
    failed = logs.route_failures(deliveries(spark, d).filter("not acked")).filter("route = 'dlq'")
    total = explorer.list_topics(change_log(spark, d)).agg(metrics.of_total("message_count").alias("total_messages"))
    return failed.agg(F.count("*").alias("dlq_total")).join(F.broadcast(total))  # one row each


@query("ag16_sink_latency_ms", "SELECT l_linestatus AS sink, round(sum(l_quantity) * 1000, 2) AS latency_ms FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def ag16(spark, d):
    name = F.when(F.col("l_returnflag") == "A", "cdc_sink_write_duration_seconds_sum").otherwise("other")
    return metrics.sink_latency_ms(table(spark, d, "lineitem").select(
        name.alias("name"), F.create_map(F.lit("sink"), "l_linestatus").alias("labels"), F.col("l_quantity").alias("value"),
    ))


# --- windows, sorts, pages -------------------------------------------------------------


@query("wn1_throughput_delta", "WITH {CHG} SELECT instance_id, seq, k, k - lag(k) OVER (PARTITION BY instance_id ORDER BY seq) AS delta FROM log")
def wn1(spark, d):
    return metrics.throughput_delta(change_log(spark, d).select("instance_id", "seq", "k"), "instance_id", "seq", "k", span=1000)


@query(
    "wn2_recent_history",
    "WITH {CHG} SELECT instance_id, seq, r AS rank FROM (SELECT instance_id, seq, CAST(row_number() OVER (PARTITION BY instance_id "
    "ORDER BY seq DESC) AS INTEGER) AS r FROM log) WHERE r <= 20",
)
def wn2(spark, d):
    return metrics.recent_history(change_log(spark, d).select("instance_id", "seq"), "instance_id", "seq")


@query("sl1_order_changes", "WITH {CHG} SELECT instance_id, seq, lsn FROM log")
def sl1(spark, d):
    return explorer.order_changes(change_log(spark, d).select("instance_id", "seq", "lsn"))


@query("sl2_paginate", "WITH {CHG} SELECT seq, k FROM log ORDER BY seq LIMIT 50 OFFSET 100")
def sl2(spark, d):
    return explorer.paginate(change_log(spark, d).select("seq", "k").orderBy("seq"), 50, 3)


@query(
    "sl3_page_info",
    "WITH {CHG} SELECT count(*) AS total, CAST(ceil(count(*) / 30.0) AS BIGINT) AS total_pages, 2 < ceil(count(*) / 30.0) AS has_next, "
    "true AS has_prev FROM log",
)
def sl3(spark, d):
    return explorer.page_info(change_log(spark, d), 30, 2)


@query(
    "sl4_list_messages",
    f"WITH {CHG}, {ACKS}, {FLOOR} SELECT seq, subject FROM log, fl WHERE seq > ack_floor AND subject LIKE 'cdc.%.public.purchases' "
    f"ORDER BY seq LIMIT 20 OFFSET 20",
)
def sl4(spark, d):
    return explorer.list_messages(change_log(spark, d), _floor(spark, d), "unsent", "cdc", "cdc.*.public.purchases", page=2).select("seq", "subject")


def _indexed(spark, log, by):
    """A log that three batches have written in folders, and its index after each was followed."""
    path, index = scratch_dir(spark, "seek-log"), None
    for i in range(3):
        part = log.filter(F.pmod(F.shiftright("seq", 9), F.lit(3)) == i)
        part.repartitionByRange(*by).sortWithinPartitions("seq").write.mode("append").partitionBy(*by[:-1]).parquet(path)
        index = index or seek.SeekIndex(spark, scratch_dir(spark, "seek-index"), path, log.schema, compact=2)
        index.follow().awaitTermination()
    return path, index


@query(
    "sl4_seek_pages",
    f"WITH {CHG}, {ACKS}, {FLOOR}, p AS (SELECT 'deep' AS listing, * FROM (SELECT seq, subject FROM log ORDER BY seq LIMIT 50 OFFSET 800) UNION ALL "
    f"SELECT 'newest', * FROM (SELECT seq, subject FROM log WHERE topic = 'cdc' ORDER BY seq DESC LIMIT 20 OFFSET 60) UNION ALL SELECT 'unsent', * FROM (SELECT seq, subject "
    f"FROM log, fl WHERE seq > ack_floor AND subject LIKE 'cdc.%.public.purchases' ORDER BY seq LIMIT 20 OFFSET 20)) SELECT * FROM p",
)
def sl4_seek(spark, d):
    """Pages by the seek index: a deep one, the newest, and that of ``sl4_list_messages``."""
    log = change_log(spark, d).select("seq", "ts", "subject", "topic", "instance_id", "schema", "tbl")
    _, index = _indexed(spark, log, ["topic", "instance_id", "schema", "tbl", "seq"])
    floor = _floor(spark, d).collect()[0]["ack_floor"]  # one row
    pages = {
        "deep": index.page(50, 17), "newest": index.page(20, 4, topic="cdc", newest=True),
        "unsent": index.page(20, 2, "cdc", "cdc.*.public.purchases", status="unsent", floor=floor),
    }
    parts = [rows.select(F.lit(name).alias("listing"), "seq", "subject") for name, rows in pages.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("sl5_sort_spec", "WITH {CHG} SELECT seq, k, tbl FROM log ORDER BY k DESC, tbl, seq LIMIT 100")
def sl5(spark, d):
    return explorer.sort_spec(change_log(spark, d).select("seq", "k", "tbl"), [("k", "desc"), ("tbl", "unspecified")]).limit(100)


@query("sl6_first_dead_letters", "WITH {DEL} SELECT seq, sink FROM del WHERE NOT acked AND attempts >= 10 AND sink = 'store' ORDER BY seq LIMIT 100")
def sl6(spark, d):
    dead = logs.route_failures(deliveries(spark, d).filter("not acked and sink = 'store'")).filter("route = 'dlq'")
    return logs.first_dead_letters(dead).select("seq", "sink")


@query(
    "so1_fan_in",
    "SELECT tbl, count(*) AS n FROM (SELECT 'orders' AS tbl FROM orders UNION ALL SELECT 'customer' FROM customer UNION ALL SELECT "
    "'supplier' FROM supplier) GROUP BY 1",
)
def so1(spark, d):
    parts = [snapshot.snapshot_to_events(table(spark, d, t), t, f"src-{t}", k) for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    return reading.fan_in(*parts).groupBy("tbl").agg(F.count("*").alias("n"))


# --- functions -------------------------------------------------------------------------


@query(
    "fn2_parse_flex_time",
    "SELECT event_id, epoch_ms(date_trunc('second', ts)) AS blank_ms, epoch_ms(date_trunc('second', ts)) AS iso_ms, epoch_us(ts) "
    "// 1000 AS micro_ms, CAST(NULL AS BIGINT) AS day_ms FROM events",
)
def fn2(spark, d):
    t = table(spark, d, "events")
    text = lambda p: F.date_format("ts", p)
    return t.select(
        "event_id", scalars.parse_flex_time(F.concat(text("yyyy-MM-dd HH:mm:ss"), F.lit("+00"))).alias("blank_ms"),
        scalars.parse_flex_time(F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("iso_ms"),
        scalars.parse_flex_time(text("yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("micro_ms"), scalars.parse_flex_time(text("yyyy-MM-dd")).alias("day_ms"),
    )


@query(
    "fn4_quote_ident",
    "SELECT p_partkey, '\"' || p_brand || '\".\"' || replace(p_type || '.x\"y', '\"', '\"\"') || '\"' AS quoted, '`' || p_brand "
    "|| '`' AS ticked FROM part",
)
def fn4(spark, d):
    name = F.concat("p_brand", F.lit("."), "p_type", F.lit('.x"y'))
    return table(spark, d, "part").select("p_partkey", scalars.quote_ident(name).alias("quoted"), scalars.quote_ident(F.col("p_brand"), "backtick").alias("ticked"))


@query(
    "fn5_split_table_ident",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'public' ELSE p_brand END AS \"schema\", CASE WHEN p_size % 2 = 0 THEN p_type "
    "ELSE p_type || '.z' END AS tbl FROM part",
)
def fn5(spark, d):
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat("p_brand", F.lit("."), "p_type", F.lit(".z")))
    return table(spark, d, "part").select("p_partkey", scalars.split_table_ident(name).alias("s")).select("p_partkey", "s.schema", "s.tbl")


@query("fn6_msg_id", "WITH {CHG} SELECT seq, CASE WHEN k >= 10 THEN instance_id || '-' || \"offset\" END AS msg_id FROM log")
def fn6(spark, d):
    return change_log(spark, d).select("seq", scalars.msg_id(F.col("instance_id"), F.when(F.col("k") >= 10, F.col("offset")).otherwise("")).alias("msg_id"))


@query("fn7_topic_of", "WITH {CHG} SELECT seq, CASE WHEN k % 2 = 0 THEN instance_id ELSE '' END AS topic FROM log")
def fn7(spark, d):
    subject = F.when(F.col("k") % 2 == 0, F.col("subject")).otherwise(F.concat(F.lit("x."), "subject"))
    return change_log(spark, d).select("seq", scalars.topic_of(subject).alias("topic"))


@query("fn8_dlq_subject", "WITH {CHG} SELECT seq, 'dlq.' || subject AS dlq_subject FROM log")
def fn8(spark, d):
    return change_log(spark, d).select("seq", scalars.dlq_subject(F.col("subject")).alias("dlq_subject"))


@query("fn9_json_field", "SELECT event_id, regexp_extract(props, '[0-9]+') AS k, CAST(NULL AS VARCHAR) AS zz FROM events")
def fn9(spark, d):
    return table(spark, d, "events").select("event_id", scalars.json_field(F.col("props"), "k", "zz").alias("f")).select("event_id", "f.k", "f.zz")


@query("fn10_decode_payload", "SELECT event_id, event_type AS plain, '{' AS other FROM events")
def fn10(spark, d):
    return table(spark, d, "events").select(
        "event_id", scalars.decode_payload(F.base64(F.col("event_type").cast("binary"))).alias("plain"), scalars.decode_payload(F.lit("{")).alias("other"),
    )


@query("fn11_parse_metrics_text", "SELECT event_id, 'cdc_total' AS name, event_type AS type, value FROM events")
def fn11(spark, d):
    line = F.concat(F.lit('cdc_total{type="'), "event_type", F.lit('",user="u"} '), F.col("value").cast("string"))
    rows = table(spark, d, "events").select("event_id", F.explode(F.array(F.lit("# HELP cdc_total x"), F.lit(""), line)).alias("line"))
    return rows.select("event_id", scalars.parse_metrics_line(F.col("line")).alias("m")).filter("m is not null").select("event_id", "m.name", F.col("m.labels")["type"].alias("type"), "m.value")


@query("fn12_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def fn12(spark, d):
    return table(spark, d, "events").select("event_id", scalars.epoch_ms(F.col("ts")).alias("ms"))


# --- log and recovery ------------------------------------------------------------------


def _redelivered(spark, d):
    log = change_log(spark, d).select("seq", "ts", scalars.msg_id(F.col("instance_id"), F.col("offset")).alias("msg_id"))
    event = F.col("seq") - 1
    soon = log.filter(event % 10 == 0).withColumn("ts", F.col("ts") + F.expr("interval 30 seconds"))
    late = log.filter(event % 10 == 1).withColumn("ts", F.col("ts") + F.expr("interval 5 minutes"))
    return log.unionByName(soon).unionByName(late)


@query(
    "st1_dedup_messages",
    "WITH {CHG} SELECT seq, ts, instance_id || '-' || \"offset\" AS msg_id FROM log UNION ALL SELECT seq, ts + INTERVAL 5 MINUTE, "
    "instance_id || '-' || \"offset\" FROM log WHERE (seq - 1) % 10 = 1",
)
def st1(spark, d):
    return logs.dedup_messages(_redelivered(spark, d))


@query(
    "st1_dedup_stream",
    "WITH {CHG} SELECT seq, ts, instance_id || '-' || \"offset\" AS msg_id FROM log UNION ALL SELECT seq, ts + INTERVAL 5 MINUTE, "
    "instance_id || '-' || \"offset\" FROM log WHERE (seq - 1) % 10 = 1",
)
def st1_stream(spark, d):
    """The same messages as a stream of four parts by time, with a restart after the second, and the first part
    delivered anew at the end: what is accepted is what ``dedup_messages`` accepts."""
    out, rows = scratch_dir(spark, "st1"), _redelivered(spark, d)
    day = F.to_date("ts")
    days = rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).select("a", (F.datediff("b", "a") + 1).alias("n")).collect()[0]
    part = F.floor(F.datediff(day, F.lit(days["a"])) * 4 / days["n"])
    for i, again in ((0, False), (1, False), (2, False), (3, False), (0, True)):
        rows.filter(part == i).withColumn("again", F.lit(again)).write.mode("append").parquet(f"{out}/in")
        if i != 0 or again:
            stream = spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).parquet(f"{out}/in")
            logs.dedup_stream(stream).writeStream.option("checkpointLocation", f"{out}/cursor").option("path", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/log").select("seq", "ts", "msg_id")


@query("st2_expire_log", "WITH {CHG} SELECT seq FROM log WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def st2(spark, d):
    return logs.expire_log(change_log(spark, d), NOW).select("seq")


@query("st2_expired_files", "WITH {CHG} SELECT seq, subject FROM log WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def st2_files(spark, d):
    """What is on the disk when the expired files of a log, in folders by day, are deleted."""
    log = change_log(spark, d).select("seq", "ts", "subject", "topic", F.to_date("ts").alias("day"))
    path, index = _indexed(spark, log, ["day", "seq"])
    index.expire(NOW, 7)
    return spark.read.schema(log.schema).parquet(path).select("seq", "subject")


@query("st3_assign_batches", "WITH {CHG} SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 100 AS batch FROM log WHERE op <> 'd'")
def st3(spark, d):
    return logs.assign_batches(change_log(spark, d).filter("op <> 'd'").select("seq"), 100)


@query("st6_route_failures", "WITH {DEL} SELECT sink, seq, CASE WHEN attempts >= 10 THEN 'dlq' ELSE 'redeliver' END AS route FROM del WHERE NOT acked")
def st6(spark, d):
    return logs.route_failures(deliveries(spark, d).filter("not acked")).select("sink", "seq", "route")


@query(
    "st7_reprocess_dlq",
    "WITH {DEL}, x AS (SELECT l.* FROM log l JOIN del ON del.seq = l.seq WHERE NOT acked AND attempts >= 10 AND sink = 'store'), "
    "f AS (SELECT * FROM x ORDER BY seq LIMIT 100) SELECT seq, 'replayed' AS state FROM f WHERE op <> 'd' UNION ALL SELECT seq, "
    "'left' FROM x WHERE seq NOT IN (SELECT seq FROM f WHERE op <> 'd')",
)
def st7(spark, d):
    failed = logs.route_failures(deliveries(spark, d).filter("not acked and sink = 'store'")).filter("route = 'dlq'").select("seq")
    dlq = change_log(spark, d).join(failed, "seq", "left_semi")
    replayed, left, ended = logs.reprocess_dlq(dlq, ["op <> 'd'"])
    return replayed.select("seq", F.lit("replayed").alias("state")).unionByName(left.select("seq", F.lit("left").alias("state")))


@query(
    "st7_replay_letters",
    "WITH {DEL}, x AS (SELECT l.* FROM log l JOIN del ON del.seq = l.seq WHERE NOT acked AND attempts >= 10 AND sink = 'store'), "
    "f AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM x) SELECT seq, CASE WHEN op <> 'd' AND r <= 60 THEN 'replayed' ELSE 'left' END AS state FROM f",
)
def st7_letters(spark, d):
    """Letters kept in two folders; a replay of the first 60 that breaks off in its delivery, and what is
    begun after it: each letter is delivered once or left."""
    out = scratch_dir(spark, "st7")
    failed = logs.route_failures(deliveries(spark, d).filter("not acked and sink = 'store'")).filter("route = 'dlq'").select("seq")
    dlq = change_log(spark, d).join(failed, "seq", "left_semi")
    for i in range(2):
        dlq.filter(F.col("seq") % 2 == i).write.parquet(f"{out}/dlq/sink=store/query=q/batch={i}-failed")
    kept = letters.DeadLetters(spark, f"{out}/dlq")

    def deliver(rows, number):
        rows.select("seq").write.mode("overwrite").parquet(f"{out}/delivered/replay={number}")

    def broken(rows, number):
        deliver(rows, number)
        raise RuntimeError("broken off")

    try:
        kept.replay(broken, ["op <> 'd'"], first=60)
    except RuntimeError:
        kept.replay(deliver, ["false"])  # ends the first, and takes none itself
    replayed = spark.read.parquet(f"{out}/delivered").select("seq", F.lit("replayed").alias("state"))
    return replayed.unionByName(kept.read().select("seq", F.lit("left").alias("state")))


@query(
    "st8_classify_error",
    "WITH {DEL} SELECT error_class, error_class NOT IN ('validation', 'schema') AS retryable, count(*) AS n FROM del WHERE NOT "
    "acked GROUP BY 1, 2",
)
def st8(spark, d):
    rows = deliveries(spark, d).filter("not acked").withColumn("retryable", logs.classify_error(F.col("error_class")))
    return rows.groupBy("error_class", "retryable").agg(F.count("*").alias("n"))


@query("st9_retry_schedule", "WITH {DEL} SELECT sink, seq, least(100 * pow(2, attempts - 1), 1000) AS delay_ms FROM del WHERE NOT acked")
def st9(spark, d):
    return logs.retry_schedule(deliveries(spark, d).filter("not acked")).select("sink", "seq", "delay_ms")


@query(
    "st12_pending_redelivery",
    "WITH {DEL} SELECT sink, seq FROM del WHERE NOT acked AND attempts < 10 AND last_attempt < TIMESTAMP '{NOW}' - INTERVAL 30 "
    "SECOND",
)
def st12(spark, d):
    return logs.pending_redelivery(deliveries(spark, d), NOW).select("sink", "seq")


@query(
    "io16_source_offsets",
    "WITH {DEL}, s AS (SELECT sink, instance_id, max(lsn) AS lsn FROM del WHERE acked GROUP BY 1, 2) SELECT instance_id, min(lsn) "
    "AS lsn FROM s GROUP BY 1",
)
def io16(spark, d):
    new = deliveries(spark, d).filter("acked").groupBy("sink", "instance_id").agg(F.max("lsn").alias("lsn"))
    old = deliveries(spark, d).groupBy("sink", "instance_id").agg(F.min("lsn").alias("lsn"))
    return logs.source_offsets(logs.save_offsets(old, new))


# --- decoded rows ----------------------------------------------------------------------


@query(
    "src2_wal_rows_to_events",
    "WITH r(relation_id, name) AS (VALUES (0, 'orders_even'), (1, 'orders_odd')) SELECT o_orderkey AS lsn, r.name AS tbl, CASE "
    "o_orderkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'u' ELSE 'd' END AS op, CASE WHEN o_orderkey % 3 = 2 THEN CAST(o_orderkey AS VARCHAR) "
    "END AS old_id, CASE WHEN o_orderkey % 3 <> 2 THEN o_totalprice END AS price FROM orders JOIN r ON r.relation_id = o_custkey "
    "% 3",
)
def src2(spark, d):
    cell = lambda c: F.struct(F.lit("text").alias("kind"), c.cast("string").alias("value"))
    none = F.lit(None).cast("array<struct<kind:string,value:string>>")
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(F.lit("insert"), F.lit("update"), F.lit("delete")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    image = F.array(cell(F.col("o_orderkey")), cell(F.col("o_totalprice")))
    wal = o.select(
        F.col("o_orderkey").alias("lsn"), F.lit(0).cast("long").alias("ts"), kind.alias("kind"), (F.col("o_custkey") % 3).alias("relation_id"),
        F.when(kind == "delete", image).otherwise(none).alias("old"), F.when(kind != "delete", image).otherwise(none).alias("new"),
    )
    columns = F.array(F.struct(F.lit("id").alias("name"), F.lit(20).alias("oid")), F.struct(F.lit("price").alias("name"), F.lit(1700).alias("oid")))
    # relations 0 and 1 are known, rows of relation 2 are dropped
    relations = o.select((F.col("o_custkey") % 2).alias("relation_id")).distinct().select(
        "relation_id", F.lit("public").alias("namespace"), F.when(F.col("relation_id") == 0, "orders_even").otherwise("orders_odd").alias("name"),
        columns.alias("columns"),
    )
    events = decode.wal_rows_to_events(wal, relations, "pg")
    return events.select("lsn", "tbl", "op", F.col("before")["id"].alias("old_id"), F.col("after")["price"].cast("double").alias("price"))


@query(
    "src3_decode_tuple",
    "SELECT p_partkey, p_size % 2 = 0 AS flag, CASE WHEN p_size % 3 <> 0 THEN p_size END AS size, p_size % 5 <> 0 AS has_name, "
    "false AS has_extra FROM part",
)
def src3(spark, d):
    columns = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("oid")) for n, o in (("flag", 16), ("size", 23), ("name", 25))])
    cell = lambda k, v: F.struct(k.alias("kind"), v.cast("string").alias("value"))
    text = F.lit("text")
    cells = F.array(
        cell(text, F.when(F.col("p_size") % 2 == 0, "t").otherwise("f")), cell(F.when(F.col("p_size") % 3 == 0, "null").otherwise(text), F.col("p_size")),
        cell(F.when(F.col("p_size") % 5 == 0, "unchanged").otherwise(text), F.col("p_name")), cell(text, F.lit("over")),
    )
    rows = table(spark, d, "part").withColumn("image", decode.decode_tuple(columns, cells))
    return rows.select(
        "p_partkey", (F.col("image")["flag"] == "true").alias("flag"), F.col("image")["size"].cast("int").alias("size"),
        F.map_contains_key("image", F.lit("name")).alias("has_name"), (F.size("image") > 3).alias("has_extra"),
    )


@query("src4_binlog_rows_to_events", """WITH b AS (SELECT c_custkey AS pos, (['insert', 'update', 'delete'])[c_custkey % 3 + 1] AS action, c_nationkey % 4 AS n FROM customer),
  e AS (SELECT pos, action, n, unnest(range(CASE WHEN action = 'update' THEN CAST(ceil(n / 2.0) AS BIGINT) ELSE n END)) AS ordinal FROM b)
  SELECT pos AS lsn, ordinal, CASE action WHEN 'insert' THEN 'c' WHEN 'update' THEN 'u' ELSE 'd' END AS op, 'f1:' || pos AS "offset",
  CASE WHEN action = 'delete' THEN ordinal WHEN action = 'update' AND 2 * ordinal + 1 < n THEN 2 * ordinal END AS old_v, CASE WHEN action = 'insert' THEN ordinal WHEN action = 'update' AND 2 * ordinal + 1 < n THEN 2 * ordinal + 1 END AS new_v FROM e""")
def src4(spark, d):
    n = (F.col("c_nationkey") % 4).cast("int")
    images = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.col("c_custkey").cast("string"), i.cast("string"))), lambda r: r[1].cast("int") < n)
    action = F.element_at(F.array(F.lit("insert"), F.lit("update"), F.lit("delete")), (F.col("c_custkey") % 3 + 1).cast("int"))
    feed = table(spark, d, "customer").select(
        F.lit("f1").alias("file"), F.col("c_custkey").alias("pos"), action.alias("action"), F.lit("db").alias("db"), F.lit("customer").alias("table"),
        F.array(F.lit("id"), F.lit("v")).alias("columns"), images.alias("rows"), F.lit(0).cast("long").alias("ts"),
    )
    e = decode.binlog_rows_to_events(feed, "my")
    return e.select(
        "lsn", F.col("ordinal").cast("long").alias("ordinal"), "op", "offset", F.col("before")["v"].cast("long").alias("old_v"),
        F.col("after")["v"].cast("long").alias("new_v"),
    )


@query(
    "src6_poll_rows_to_events",
    "WITH {CHG}, p AS (SELECT seq, k, unnest(range(k % 3)) AS ordinal FROM log WHERE k % 5 <> 0 AND k % 7 <> 0) SELECT seq AS "
    "lsn, ordinal, k FROM p",
)
def src6(spark, d):
    items = F.filter(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct(F.col("k").alias("k"), i.alias("i"))), lambda s: s["i"] < F.col("k") % 3)
    body = F.when(F.col("k") % 7 == 0, F.lit('{"k":1}')).otherwise(F.to_json(items))
    polls = change_log(spark, d).select(F.col("seq").alias("poll_ts"), F.when(F.col("k") % 5 == 0, 500).otherwise(200).alias("status"), body.alias("body"))
    e = decode.poll_rows_to_events(polls, "rest", "items")
    return e.select("lsn", F.col("ordinal").cast("long").alias("ordinal"), F.col("after")["k"].cast("long").alias("k"))


@query(
    "src16_parse_binlog_offset",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'bin' END AS file, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS "
    "pos FROM orders",
)
def src16(spark, d):
    text = F.element_at(
        F.array(F.concat(F.lit("bin:"), F.col("o_custkey").cast("string")), F.lit("bin"), F.lit("bin:1:2"), F.lit("bin:4294967296")),
        (F.col("o_orderkey") % 4 + 1).cast("int"),
    )
    return table(spark, d, "orders").select("o_orderkey", decode.parse_binlog_offset(text).alias("p")).select("o_orderkey", "p.file", "p.pos")


@query(
    "io4_key_selection",
    "WITH {CHG} SELECT seq, k >= 20 AS keyed, CASE WHEN k >= 20 THEN CASE WHEN tbl = 'purchases' THEN k ELSE pk END END AS key "
    "FROM log",
)
def io4(spark, d):
    rows = filters.select_image(change_log(spark, d)).withColumn("image", F.when(F.col("k") >= 20, F.col("image")).otherwise(F.map_filter("image", lambda c, v: c == "value")))
    keyed, dead = merge.split_keyless(rows, {"purchases": "k"}, kind="bigint")
    return keyed.select("seq", F.lit(True).alias("keyed"), "key").unionByName(dead.select("seq", F.lit(False).alias("keyed"), F.lit(None).cast("bigint").alias("key")))


@query(
    "io9_bulk_item_errors",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'index' ELSE 'delete' END AS action, CAST(400 + o_custkey % 100 AS INTEGER) "
    "AS status, o_orderstatus AS reason FROM orders WHERE o_orderkey % 3 = 0",
)
def io9(spark, d):
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("_id"), F.when(F.col("o_orderkey") % 3 == 0, 400 + F.col("o_custkey") % 100).otherwise(200).alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.lit("t").alias("type"), F.col("o_orderstatus").alias("reason"))).alias("error"),
    )
    body = F.to_json(F.struct(
        (F.col("o_orderkey") % 3 == 0).alias("errors"),
        F.array(F.create_map(F.when(F.col("o_orderkey") % 2 == 0, "index").otherwise("delete"), item)).alias("items"),
    ))
    got = actions.bulk_item_errors(table(spark, d, "orders").select(body.alias("body")))
    return got.select(F.col("doc_id").cast("bigint").alias("o_orderkey"), "action", "status", "reason")


@query(
    "io15_dead_letters",
    "WITH {DEL} SELECT seq, sink, error_class AS reason, subject AS original_subject, 'dlq.' || subject AS dlq_subject FROM del "
    "WHERE NOT acked AND attempts >= 10",
)
def io15(spark, d):
    failed = logs.route_failures(deliveries(spark, d).filter("not acked")).filter("route = 'dlq'")
    return logs.dead_letters(failed, F.col("error_class")).select("seq", "sink", "reason", "original_subject", "dlq_subject")


@query("pf17_record_validity", "WITH {CHG} SELECT seq, CASE WHEN k % 5 = 0 THEN 'bad json' WHEN k % 5 = 1 THEN 'missing image' ELSE 'ok' END AS state FROM log")
def pf17(spark, d):
    log = change_log(spark, d)
    data = F.when(F.col("k") % 5 == 0, F.lit("{nope")).when(F.col("k") % 5 == 1, F.to_json(F.struct("op"))).otherwise(F.to_json(F.struct("op", "before", "after")))
    good, bad = filters.split_valid(log.select("seq", data.alias("data")))
    return good.select("seq", F.lit("ok").alias("state")).unionByName(bad.select("seq", F.col("reason").alias("state")))


@query(
    "fn1_parse_oid",
    "SELECT p_partkey, p_size % 2 = 0 AS flag, CASE WHEN p_size % 3 = 0 THEN p_size END AS number, p_size % 3 <> 0 AS bad, p_retailprice "
    "AS price FROM part",
)
def fn1(spark, d):
    number = scalars.parse_oid(F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise("x1"), F.lit(23))
    p = table(spark, d, "part").withColumn("n", number)
    flag = scalars.parse_oid(F.when(F.col("p_size") % 2 == 0, "t").otherwise("f"), F.lit(16))["value"] == "true"
    price = scalars.parse_oid(F.col("p_retailprice").cast("string"), F.lit(701))["value"].cast("double")
    return p.select("p_partkey", flag.alias("flag"), F.col("n.value").cast("int").alias("number"), F.col("n.bad").alias("bad"), price.alias("price"))


@query(
    "fn3_sanitize_doc",
    "SELECT event_id, '' AS metadata, CAST(epoch_ms(date_trunc('second', ts)) AS VARCHAR) AS created_at, event_type AS lifetime "
    "FROM events",
)
def fn3(spark, d):
    doc = F.create_map(F.lit("metadata"), F.lit("{}"), F.lit("created_at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("lifetime"), F.col("event_type"))
    rows = table(spark, d, "events").select("event_id", scalars.sanitize_doc(doc).alias("doc"))
    return rows.select("event_id", *[F.col("doc")[c].alias(c) for c in ("metadata", "created_at", "lifetime")])


# --- streams over the change log -------------------------------------------------------


@query("io1_sink_contract", "WITH {CHG} SELECT seq, op, tbl FROM log WHERE tbl = 'purchases'")
def io1(spark, d):
    src, out = _kept(spark, _envelopes(spark, d), "io1-log"), scratch_dir(spark, "io1")
    sink = sinks.AppendSink("store", f"{out}/rows", lambda df: df.select("seq", "op", "tbl"), ["cdc.*.public.purchases"])
    sinks.run_sink(reading.read_changes(spark, src, stream=True), sink, f"{out}/cursors").awaitTermination()
    return spark.read.schema("seq long, op string, tbl string").parquet(f"{out}/rows").select("seq", "op", "tbl")


@query("io6_table_sink", "WITH {CHG}, " + FOLD + " SELECT id, value, k FROM res")
def io6(spark, d):
    """The customers' table after four batches of the log that came in no order, with a restart
    between any two: it is the one of ``apply_changes``."""
    out, log = scratch_dir(spark, "io6"), _envelopes(spark, d)
    customers = _customers(spark, d)
    make = lambda: sinks.TableSink("store", f"{out}/table", "id", ["lsn", "seq"], customers, ["cdc.*.public.accounts"], compact=3, buckets=4)
    make().table.seed(customers)
    for i in (2, 0, 3, 1):
        log.filter(F.pmod(F.xxhash64("seq"), F.lit(4)) == i).write.mode("append").parquet(f"{out}/log")
        sinks.run_sink(reading.read_changes(spark, f"{out}/log", stream=True), make(), f"{out}/cursors").awaitTermination()
    return make().read(spark)


@query("io17_bulk_retry", "WITH {CHG} SELECT seq, CASE WHEN op = 'd' THEN 'delete' ELSE 'index' END AS action, 3 AS tries FROM log")
def io17(spark, d):
    """Each batch fails twice before it is taken."""
    src, out = _kept(spark, _envelopes(spark, d), "io17-log"), scratch_dir(spark, "io17")
    tries: dict[int, int] = {}

    def write(batch, epoch):
        tries[epoch] = tries.get(epoch, 0) + 1
        if tries[epoch] < 3:
            raise logs.DeliveryError("not now", "network")
        rows = actions.bulk_actions(routing.route_target(filters.select_image(batch)))
        rows.select("seq", "action", F.lit(tries[epoch]).alias("tries")).write.mode("overwrite").parquet(f"{out}/rows/batch={epoch}")

    sinks.run_sink(reading.read_changes(spark, src, stream=True), sinks.FunctionSink("bulk", write), f"{out}/cursors", tries=5, base=1).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("seq", "action", "tries")


def _progress(spark, d):
    """What a listener saw of two sinks over the log, of which one was started again."""
    src, out, seen = _kept(spark, _envelopes(spark, d), "progress-log"), scratch_dir(spark, "progress"), observe.ProgressTable(spark)
    spark.streams.addListener(seen)
    for name in ("search", "store", "store"):
        sink = sinks.AppendSink(name, f"{out}/{name}")
        sinks.run_sink(reading.read_changes(spark, src, stream=True), sink, f"{out}/cursors").awaitTermination()
    for _ in range(100):  # a listener hears of an end some time after it
        if seen.seen("end") == 3:
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    return seen.table(spark)


@query(
    "ag13_active_workers",
    "WITH {CHG} SELECT s AS sink, CAST(n AS BIGINT) AS reconnects, 0 AS active_workers FROM (VALUES ('search', 0), ('store', 1)) "
    "AS v(s, n), (SELECT count(*) AS c FROM log) WHERE c > 0",
)
def ag13(spark, d):
    seen = _progress(spark, d)
    return observe.reconnects(seen).join(observe.active_workers(seen), "sink")


@query(
    "ag17_worker_duration_histogram",
    "WITH {CHG} SELECT s AS sink, count(*) AS rows, true AS complete FROM log, (VALUES ('search'), ('store')) AS v(s) GROUP BY "
    "1",
)
def ag17(spark, d):
    """Rows by sink, and whether its buckets of seconds rise up to all its batches."""
    seen = _progress(spark, d)
    buckets = observe.worker_duration_histogram(seen).groupBy("sink").agg(F.max("n").alias("n"), F.max("total").alias("total"), F.count("*").alias("b"))
    rows = seen.filter("kind = 'batch'").groupBy("sink").agg(F.sum("rows").alias("rows"), F.count("*").alias("batches"))
    complete = (F.col("n") == F.col("total")) & (F.col("total") == F.col("batches")) & (F.col("b") == len(metrics.SECOND_BOUNDS) + 1)
    return rows.join(buckets, "sink").select("sink", "rows", complete.alias("complete"))


@query(
    "so2_fan_out",
    "WITH {CHG} SELECT 'all' AS sink, tbl, count(*) AS n FROM log GROUP BY 2 UNION ALL SELECT 'buys', tbl, count(*) FROM log WHERE "
    "tbl = 'purchases' GROUP BY 2",
)
def so2(spark, d):
    src, out = _kept(spark, _envelopes(spark, d), "so2-log"), scratch_dir(spark, "so2")
    specs = [pipeline.SinkSpec("all", options={"path": f"{out}/all"}), pipeline.SinkSpec("buys", subjects=["cdc.*.*.purchases"], options={"path": f"{out}/buys"})]
    pipeline.Pipeline(spark, pipeline.PipelineSpec([pipeline.SourceSpec("i", options={"path": src})], specs), f"{out}/cursors").run_once()
    parts = [spark.read.parquet(f"{out}/{s.name}").groupBy("tbl").agg(F.count("*").alias("n")).select(F.lit(s.name).alias("sink"), "tbl", "n") for s in specs]
    return reading.fan_in(*parts)


@query(
    "ud7_pipeline",
    "WITH {CHG} SELECT seq, CASE WHEN op = 'd' THEN 'DEL' ELSE 'HSET' END AS command, tbl || '/' || pk AS key, CASE WHEN op <> "
    "'d' THEN k END AS rank, CASE WHEN op <> 'd' THEN 2 * pk END AS twice FROM log WHERE event_type <> 'view'",
)
def ud7(spark, d):
    """Sources to a message log, with a second delivery of each change, and from it to a
    key-value sink with renamed and computed fields and keys of its own."""
    log, out = _envelopes(spark, d).filter("op <> 'u' or map_contains_key(after, 'value')"), scratch_dir(spark, "ud7")
    src = _kept(spark, log.unionByName(log), "ud7-changes")
    sink = pipeline.SinkSpec(
        "kv", "kv", options={"path": f"{out}/kv"}, mapping={"k": "rank"}, expressions={"twice": "2 * cast(data.id as bigint)"}, key="concat(tbl, '/', data.id)",
    )
    spec = pipeline.PipelineSpec([pipeline.SourceSpec("i", options={"path": src})], [sink], log=f"{out}/log", dlq=f"{out}/dlq")
    pipeline.Pipeline(spark, spec, f"{out}/cursors").run_once()
    args = F.col("args")
    return spark.read.parquet(f"{out}/kv").select("seq", "command", "key", args["rank"].cast("long").alias("rank"), args["twice"].cast("long").alias("twice"))


@query("st5_at_least_once", "WITH {CHG} SELECT seq, op, 2 AS tries FROM log")
def st5(spark, d):
    """A sink that breaks off after its write, before its batch counts as done, and is started
    again: the batch is written anew in place of what was left."""
    src, out = _kept(spark, _envelopes(spark, d), "st5-log"), scratch_dir(spark, "st5")
    tries: list[int] = []

    def write(batch, epoch):
        tries.append(epoch)
        batch.select("seq", "op", F.lit(len(tries)).alias("tries")).write.mode("overwrite").parquet(f"{out}/rows/batch={epoch}")
        if len(tries) == 1:
            raise RuntimeError("broken off")

    for _ in range(2):
        query = sinks.run_sink(reading.read_changes(spark, src, stream=True), sinks.FunctionSink("store", write), f"{out}/cursors")
        try:
            query.awaitTermination()
        except StreamingQueryException:
            continue
    return spark.read.parquet(f"{out}/rows").select("seq", "op", "tries")


@query("st13_hot_add_remove", "WITH {CHG} SELECT s AS sink, count(*) AS n FROM log, (VALUES ('early'), ('late')) AS v(s) GROUP BY 1")
def st13(spark, d):
    """A sink that is added to a running pipeline reads the log from its beginning; one that is
    removed leaves the others running."""
    src, out = _kept(spark, _envelopes(spark, d), "st13-log"), scratch_dir(spark, "st13")
    pipe = pipeline.Pipeline(spark, pipeline.PipelineSpec([pipeline.SourceSpec("i", options={"path": src})], []), f"{out}/cursors")
    for name in ("early", "late"):
        pipe.add_sink(pipeline.SinkSpec(name, options={"path": f"{out}/{name}"}, flush_ms=100)).processAllAvailable()
    pipe.remove_sink("early")
    pipe.queries["late"].processAllAvailable()
    pipe.stop()
    return reading.fan_in(*[spark.read.parquet(f"{out}/{s}").agg(F.lit(s).alias("sink"), F.count("*").alias("n")) for s in ("early", "late")])


@query("ud5_handle_rows", "SELECT c_custkey AS id, upper(c_name) AS name FROM customer WHERE c_custkey % 2 = 0")
def ud5(spark, d):
    def even(rows):
        rows = rows[rows["id"] % 2 == 0]
        return rows.assign(name=rows["name"].str.upper())

    return snapshot.handle_rows(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name")), even)


@query(
    "ud6_types_by_name",
    "WITH {CHG} SELECT 'inst1_purchases' AS target, count(*) AS n FROM log WHERE instance_id = 'inst1' AND tbl = 'purchases' "
    "UNION ALL SELECT 'crm_orders', count(*) FROM orders",
)
def ud6(spark, d):
    """A log kept as JSON and a table's snapshot, both to one sink that routes by table."""
    out, orders = scratch_dir(spark, "ud6"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    _envelopes(spark, d).write.json(f"{out}/log")
    sources = [
        pipeline.SourceSpec("log", "json", ["purchases"], {"path": f"{out}/log"}),
        pipeline.SourceSpec("crm", "snapshot", options={"path": _kept(spark, orders, "ud6-orders"), "table": "orders"}),
    ]
    sink = pipeline.SinkSpec("rows", "routed", ["cdc.inst1.>", "cdc.crm.>"], {"path": f"{out}/rows", "columns": {"id": "bigint"}}, prefix="")
    pipeline.Pipeline(spark, pipeline.PipelineSpec(sources, [sink], log=f"{out}/messages"), f"{out}/cursors").run_once()
    return spark.read.parquet(f"{out}/rows").groupBy("target").agg(F.count("*").alias("n"))
