"""Runs of acknowledged numbers against sets."""

import random

from changefold.operators import acks, explorer

NUMBERS = "sink string, seq long"


def by_run(state):
    out = {}
    for r in state.collect():
        out.setdefault(r["sink"], []).append((r["start"], r["end"]))
    return {s: sorted(x) for s, x in out.items()}


def test_runs_grow_to_the_set_and_stay_maximal(spark):
    rng = random.Random(4)
    held = {"a": set(), "b": set(), None: set()}
    state = spark.createDataFrame([], acks.STATE)
    for _ in range(5):
        new = [(rng.choice(["a", "b", None]), rng.randrange(60)) for _ in range(40)] + [("a", None)]
        for s, n in new:
            if n is not None:
                held[s].add(n)
        state = acks.extend_runs(state, spark.createDataFrame(new, NUMBERS), span=20)
        state = spark.createDataFrame(state.collect(), acks.STATE)
        for s, runs in by_run(state).items():
            assert [n for a, b in runs for n in range(a, b + 1)] == sorted(held[s])
            assert all(a // 20 == b // 20 for a, b in runs) and all(b + 1 < c or c % 20 == 0 for (_, b), (c, _) in zip(runs, runs[1:], strict=False))


def test_info_equals_the_join_with_the_log(spark):
    rng = random.Random(6)
    for holes, acked in ((0, 1.0), (0, 0.9), (5, 0.97), (9, 0.0), (3, 1.0)):
        log = sorted(set(range(1, 100)) - set(rng.sample(range(1, 100), holes)))
        dealt = [(s, n, rng.random() < acked) for s in ("x", "y") for n in log if rng.random() < (0.95 if s == "x" else 1.0)]
        if acked == 1.0:
            dealt = [(s, n, True) for s in ("x", "y") for n in log if s == "x" or n < 40]
        frame = spark.createDataFrame(dealt, "sink string, seq long, acked boolean")
        want = {tuple(r) for r in explorer.consumer_info(spark.createDataFrame([(n,) for n in log], "seq long"), frame, "x", "y", "z").collect()}
        runs = lambda rows: acks.runs_of(spark.createDataFrame(rows, NUMBERS), 20)
        got = acks.info_of_runs(runs([("log", n) for n in log]), runs([(s, n) for s, n, _ in dealt]), runs([(s, n) for s, n, a in dealt if a]), "x", "y", "z")
        assert {tuple(r) for r in got.collect()} == want


def test_spans_that_nothing_touches_are_not_looked_at(spark):
    """A prefix that is acknowledged whole is a row per span."""
    whole = acks.runs_of(spark.range(1, 5001).selectExpr("'s' sink", "id seq"), 1000)
    assert whole.count() == 6
    state = acks.extend_runs(whole, spark.createDataFrame([("s", 5003), ("s", 5001)], NUMBERS), 1000)
    assert by_run(state)["s"][-2:] == [(5000, 5001), (5003, 5003)] and state.count() == 7
