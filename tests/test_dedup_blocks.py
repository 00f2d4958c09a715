"""Messages pass the dedup of streams by block; what is held of a batch are its ids."""

import random
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa

from changefold.streaming import log as logs


def messages(n, start=0):
    ids = [i % 97 for i in range(start, start + n)]
    numbers = [pa.array(c, pa.int64()) for c in (ids, ids, range(n), range(n))]
    columns = [pa.array([i % 5 for i in ids], pa.int32()), *numbers, pa.array([False] * n), pa.array([7] * n, pa.int64()), pa.array([f"{i}" * 50 for i in range(n)])]
    return pa.RecordBatch.from_arrays(columns, ["m_bucket", *logs.IDS, "m_arrived", "c0"])


def test_blocks_are_made_as_messages_come(monkeypatch):
    """A task hands blocks on before it has read all of its messages, and they come out as they went in."""
    monkeypatch.setattr(logs, "PACK_BYTES", 200_000)
    read = []

    def batches():
        for k in range(20):
            read.append(k)
            yield messages(1000, k)

    first = next(logs.pack_blocks(batches()))
    assert len(read) < 10 and first.num_rows == 1
    blocks = list(logs.pack_blocks(messages(1000, k) for k in range(20)))
    assert {b.column("m_bucket")[0].as_py() for b in blocks} == set(range(5)) and len(blocks) > 5
    accepted = [pa.RecordBatch.from_arrays([b.column("m_rows"), pa.array([None], pa.binary())], ["rows", "ok"]) for b in blocks]
    out = [v for b in logs.unpack_blocks(accepted) for v in b.column("c0").to_pylist()]
    assert sorted(out) == sorted(f"{i}" * 50 for i in range(1000) for _ in range(20))


def test_accepted_ids_against_plain_python():
    rng, window = random.Random(5), 100
    for _ in range(50):
        known = [(a, a, rng.randrange(600)) for a in range(6) for _ in range(rng.randrange(3))]
        rows = [(a := rng.randrange(8), a, rng.randrange(600), rng.choice([None, 1, 2, 3]), rng.random() < 0.1) for _ in range(40)]
        times = {}
        for a, _, t in known:
            insort(times.setdefault(a, []), t)
        want = [r[4] for r in rows]
        for i in sorted(range(40), key=lambda i: (rows[i][2], rows[i][3] is None, rows[i][3] or 0)):
            before = times.setdefault(rows[i][0], [])
            at = bisect_right(before, rows[i][2])
            if not rows[i][4] and not (at and rows[i][2] - before[at - 1] < window):
                insort(before, rows[i][2])
                want[i] = True
        ids = pa.table([pa.array([r[k] for r in rows]) for k in range(5)], names=list(logs.IDS))
        got = logs.accept_ids(ids, np.array(known, dtype=np.int64).reshape(-1, 3), window)
        assert got.tolist() == want
