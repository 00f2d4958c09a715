"""Current tables on files: any order of arrival, what a batch rewrites, restarts."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.operators import merge
from changefold.streaming.tables import MergeTable

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.LongType()), T.StructField("y", T.StringType())])
CHANGES = "key long, op string, image map<string,string>, lsn long, seq long"


def some_changes(rng, n, keys=40):
    rows = []
    for i in range(n):
        op, key = rng.choice("cuurd"), rng.randrange(keys)
        image = {"id": str(key)} | ({"x": str(rng.randrange(99))} if rng.random() < 0.7 else {}) | ({"y": rng.choice(["p", None])} if rng.random() < 0.5 else {})
        rows.append((key, op, image, i // 2, i))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_equals_the_log(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = some_changes(rng, 300)
    base = spark.createDataFrame([(i, i, "b") for i in range(20)], SCHEMA)
    table = lambda: MergeTable(str(tmp_path / "t"), "id", SCHEMA, ["lsn", "seq"], buckets=4, compact=2)
    table().seed(base)
    rng.shuffle(data)
    for k in range(6):
        table().add(spark.createDataFrame(data[50 * k : 50 * k + 50], CHANGES), "q", k)
        so_far = merge.apply_changes(spark.createDataFrame(data[: 50 * k + 50], CHANGES), base, "id", ["lsn", "seq"])
        assert rows_of(table().read(spark)) == rows_of(so_far)
        table().add(spark.createDataFrame(data[:9], CHANGES), "q", k)  # done already
    assert rows_of(table().read(spark)) == rows_of(so_far)


def test_late_changes_of_deleted_keys_stay_dead(spark, tmp_path):
    table = MergeTable(str(tmp_path / "t"), "id", SCHEMA, ["lsn", "seq"], buckets=2, compact=1)
    for row in [(1, "d", {"id": "1"}, 10, 0), (1, "u", {"id": "1", "x": "5"}, 9, 0), (2, "u", {"id": "2", "x": "7"}, 8, 0), (2, "u", {"id": "2", "x": "6"}, 3, 0)]:
        table.add(spark.createDataFrame([row], CHANGES))
    assert rows_of(table.read(spark)) == [(2, 7, None)]
    table.add(spark.createDataFrame([(1, "c", {"id": "1", "y": "new"}, 11, 0)], CHANGES))
    assert rows_of(table.read(spark)) == [(1, None, "new"), (2, 7, None)]


def files_of(path):
    return {f for f in path.joinpath("data").rglob("*.parquet")}


def test_a_batch_rewrites_the_buckets_it_fills_and_no_others(spark, tmp_path):
    path = tmp_path / "t"
    table = MergeTable(str(path), "id", SCHEMA, ["lsn", "seq"], buckets=50, compact=100)
    table.seed(spark.range(5000).select("id", F.col("id").alias("x"), F.lit("a").alias("y")))
    before = files_of(path)
    size = sum(f.stat().st_size for f in before)
    assert len(before) == 50
    # a hundredth of the keys, from anywhere: one small delta a bucket at most, no base
    some = spark.range(0, 5000, 100).select(F.col("id").alias("key"), F.lit("u").alias("op"), F.create_map(F.lit("x"), F.lit("1")).alias("image"), F.lit(1).alias("lsn"), F.lit(1).alias("seq"))
    table.add(some)
    assert before <= files_of(path) and not any(p["base"][0] != "000000" for p in table.pointer(spark)["parts"].values())
    # all keys of one bucket: it alone gets a new base
    mine = spark.range(5000).filter(F.pmod(F.xxhash64("id"), F.lit(50)) == 7)
    table.add(mine.select(F.col("id").alias("key"), F.lit("u").alias("op"), F.create_map(F.lit("x"), F.lit("-2")).alias("image"), F.lit(2).alias("lsn"), F.lit(1).alias("seq")))
    parts = table.pointer(spark)["parts"]
    assert [b for b, p in parts.items() if p["base"][0] != "000000"] == ["7"]
    rewritten = [f for f in files_of(path) if "version=000002m" in str(f)]
    assert len(rewritten) == 1 and rewritten[0].stat().st_size < size / 25
    assert table.read(spark).filter("x = -2").count() == mine.count() and table.read(spark).count() == 5000
    # files that are replaced go with the next batch, others stay
    table.add(some)
    left = files_of(path)
    assert sum(f in left for f in before) == 49


def test_many_small_deltas_become_one(spark, tmp_path):
    table = MergeTable(str(tmp_path / "t"), "id", SCHEMA, ["lsn", "seq"], buckets=1, compact=3)
    table.seed(spark.range(1000).select("id", F.col("id").alias("x"), F.lit("a").alias("y")))
    for k in range(7):
        table.add(spark.createDataFrame([(k, "u", {"x": "-1"}, k, 0)], CHANGES))
        assert len(table.pointer(spark)["parts"]["0"]["deltas"]) <= 3
    assert table.pointer(spark)["parts"]["0"]["base"][0] == "000000"
    assert table.read(spark).filter("x = -1").count() == 7


def test_clean_buckets_are_read_without_a_shuffle(spark, tmp_path):
    table = MergeTable(str(tmp_path / "t"), "id", SCHEMA, ["lsn", "seq"], buckets=4)
    table.seed(spark.range(100).select("id", F.col("id").alias("x"), F.lit("a").alias("y")))
    assert "Exchange" not in table.read(spark)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="rows already"):
        table.seed(spark.range(1).select("id", F.col("id").alias("x"), F.lit("a").alias("y")))


def test_nothing_in_a_table_and_nothing_in_a_batch(spark, tmp_path):
    table = MergeTable(str(tmp_path / "t"), "id", SCHEMA, ["lsn", "seq"])
    assert table.read(spark).collect() == []
    table.add(spark.createDataFrame([], CHANGES), "q", 0)
    assert table.read(spark).collect() == [] and table.pointer(spark)["done"] == {"q": 0}


def test_new_fields_become_columns_and_types_widen(spark, tmp_path):
    table = lambda: MergeTable(str(tmp_path / "t"), "id", SCHEMA, ["lsn", "seq"], buckets=2, compact=2, evolve=True)
    batches = [
        [(1, "c", {"id": "1", "x": "5", "n": "7", "on": "true"}, 1, 0)], [(2, "c", {"id": "2", "n": "1.5", "x": None}, 2, 0), (1, "u", {"late": None}, 3, 0)],
        [(3, "c", {"id": "3", "x": "five", "on": "2", "late": "1"}, 4, 0)], [(1, "d", {"id": "1"}, 5, 0), (2, "u", {"n": "3"}, 6, 0)],
    ]
    for k, rows in enumerate(batches):
        table().add(spark.createDataFrame(rows, CHANGES), "q", k)
    got = table().read(spark)
    assert got.dtypes == [("id", "bigint"), ("x", "string"), ("y", "string"), ("n", "double"), ("on", "string"), ("late", "string")]
    assert rows_of(got) == [(2, None, None, 3.0, None, None), (3, "five", None, None, "2", "1")]
    altered = [(r["version"], r["column"], r["type"], r["ddl"].split()[2]) for r in table().alterations(spark).collect()]
    assert altered == [(0, "n", "bigint", "ADD"), (0, "on", "boolean", "ADD"), (1, "late", "string", "ADD"), (1, "n", "double", "ALTER"), (2, "on", "string", "ALTER"), (2, "x", "string", "ALTER")]
    plain = MergeTable(str(tmp_path / "p"), "id", SCHEMA, ["lsn", "seq"])
    plain.add(spark.createDataFrame(batches[0], CHANGES))
    assert plain.read(spark).columns == ["id", "x", "y"]
