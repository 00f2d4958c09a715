"""Dead letters and their replays: crashes at any step, and what is left on disk."""

import pyarrow.parquet as pq
import pytest

from changefold.streaming.letters import DeadLetters

SCHEMA = "seq long, msg_id string, subject string, before map<string,string>, after map<string,string>"


def kept(spark, path):
    for sink, batch, seqs in (("a", 0, range(1, 21)), ("a", 1, range(21, 41)), ("b", 0, range(1, 11))):
        rows = [(s, f"{sink}{s}", "x", None, {"id": str(s)}) for s in seqs] + ([(1, "same-seq", "x", None, {"id": "0"})] if sink == "b" else [])
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/sink={sink}/query=q/batch={batch}-failed")
    return DeadLetters(spark, str(path))


def ids(df):
    return sorted(r["msg_id"] for r in df.collect())


@pytest.mark.parametrize("breaks", [None, "before", "after"])
def test_each_letter_is_delivered_once_or_left(spark, tmp_path, breaks):
    letters, got, broken = kept(spark, tmp_path / "dlq"), {}, []
    everything = ids(letters.read())

    def deliver(rows, number):
        if breaks == "before" and not broken:
            broken.append(1)
            raise RuntimeError("broken off")
        got[number] = ids(rows)
        if breaks == "after" and not broken:
            broken.append(1)
            raise RuntimeError("broken off")

    def replay():
        try:
            letters.replay(deliver, ["seq % 2 = 0"], first=15)
        except RuntimeError:
            assert DeadLetters(spark, letters.path).pointer()["under_way"]

    replay()
    if not breaks:
        assert (tmp_path / "dlq/sink=a/query=q/batch=1-failed").exists() and not (tmp_path / "dlq/sink=a/query=q/batch=0-failed").exists()
    replay()
    delivered = sorted(x for ids_ in got.values() for x in ids_)
    assert sorted(delivered + ids(letters.read())) == everything and all(int(x[1:]) % 2 == 0 for x in delivered) and delivered
    on_disk = sum(pq.read_metadata(f).num_rows for f in (tmp_path / "dlq").rglob("*.parquet"))
    assert on_disk == letters.read().count() < len(everything) and not list((tmp_path / "dlq/_replays").glob("staged=*"))


def test_letters_that_arrive_meanwhile_count(spark, tmp_path):
    letters, got = kept(spark, tmp_path / "dlq"), []
    letters.replay(lambda rows, n: got.extend(ids(rows)), first=1000)
    assert len(got) == 51 and letters.read().count() == 0
    spark.createDataFrame([(99, "late", "x", None, {"id": "9"})], SCHEMA).write.parquet(f"{tmp_path}/dlq/sink=a/query=q/batch=2-failed")
    assert ids(letters.read()) == ["late"]
    letters.replay(lambda rows, n: got.extend(ids(rows)))
    assert got[-1] == "late" and letters.read().count() == 0
    assert DeadLetters(spark, f"{tmp_path}/none").read() is None and DeadLetters(spark, f"{tmp_path}/none").replay(print) == 0
