"""Requests of bounded size, whatever the numbers of their changes."""

import json
import math

import pytest
from pyspark.sql import functions as F

from changefold.operators import actions


def texts(spark, values, parts=3):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, value string").repartitionByRange(parts, "seq")


@pytest.mark.parametrize("seq", ["sparse", "same", "dense"])
@pytest.mark.parametrize("size", [1, 7, 100])
def test_counts_follow_partitions(spark, seq, size):
    number = {"sparse": F.col("id") * 1_000_003, "same": F.lit(5).cast("long"), "dense": F.col("id")}[seq]
    rows = spark.range(0, 1000, 1, 4).select(number.alias("seq"), F.col("id").cast("string").alias("value")).repartition(5)
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    got = actions.pack_requests(rows, size, 1 << 20, ["seq"]).collect()
    assert max(r["n"] for r in got) <= size and sum(r["n"] for r in got) == 1000
    assert len(got) == sum(math.ceil(n / size) for n in sizes)
    assert sorted(x for r in got for x in r["value"].split()) == sorted(str(i) for i in range(1000))
    assert len({(r["task"], r["request"]) for r in got}) == len(got)


def test_bytes_are_bounded(spark):
    values = ["é" * (k % 50) + str(k) for k in range(500)] + ["x" * 5000, None, ""]
    got = actions.pack_requests(texts(spark, values), 100, 400, ["seq"], frame=("[", ",", "]")).collect()
    for r in got:
        assert r["bytes"] == len(r["value"].encode()) and (r["bytes"] <= 400 or r["n"] == 1)
    assert sum(r["n"] for r in got) == 502
    # no request could have taken the first text of the next one
    for a, b in zip(sorted(got, key=lambda r: (r["task"], r["request"])), sorted(got, key=lambda r: (r["task"], r["request"]))[1:], strict=False):
        if a["task"] == b["task"]:
            assert a["n"] == 100 or a["bytes"] + 1 + len(b["value"][1:-1].split(",")[0].encode()) > 400


def test_documents_stay_in_order(spark):
    rows = [(s, "index", "t", str(s % 3), {"at": str(s)}) for s in range(300)]
    frame = spark.createDataFrame(rows, "seq long, action string, target string, doc_id string, doc map<string,string>").repartition(8)
    got = sorted(actions.bulk_requests(frame, 10).collect(), key=lambda r: (r["task"], r["request"]))
    last: dict[str, int] = {}
    for r in got:
        lines = [json.loads(x) for x in r["value"].split("\n") if x]
        assert len(lines) == 2 * r["n"] <= 20
        for head, doc in zip(lines[::2], lines[1::2], strict=True):
            assert int(doc["at"]) > last.get(head["index"]["_id"], -1)
            last[head["index"]["_id"]] = int(doc["at"])
    assert last == {"0": 297, "1": 298, "2": 299}


def test_one_hot_document_is_cut_too(spark):
    frame = spark.range(5000).select(F.lit(7).alias("seq"), F.lit("index").alias("action"), F.lit("t").alias("target"), F.lit("1").alias("doc_id"), F.create_map(F.lit("a"), F.lit("b")).alias("doc"))
    got = actions.bulk_requests(frame).collect()
    assert len(got) == 50 and all(r["n"] == 100 for r in got)


def test_no_rows(spark):
    assert actions.pack_requests(texts(spark, []), 10, 10, ["seq"]).collect() == []
