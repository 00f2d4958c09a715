"""Mixing, line dedup, decontamination, licences and quality against brute force."""

import hashlib
import random
import re
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from changefold.llm import decontam, licenses
from changefold.llm import lines as lines_module
from changefold.llm.common import shared_dir
from changefold.llm.decontam import decontaminate, report
from changefold.llm.licenses import ISC, MIT, known_licenses, scan_licenses
from changefold.llm.lines import LineRuns, dedup_lines
from changefold.llm.mixing import apportion, mix_sources, shard_quotas, targets
from changefold.llm.quality import NAMES, fit, score_quality, statistics

WORDS = re.compile("[^\x20\x09-\x0d]+")
UNITS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- mixing ----------------------------------------------------------------------------


def fill(sizes, weights, share, cap):
    """Targets by dealing out and resharing the excess until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, got, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return got | {s: level * weight[s] for s in free}
        for s in over:
            got[s] = cap * sizes[s]
            left -= got[s]
        free -= over
    return got


def seats_by_hand(claims, seats):
    got = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = max(sorted(k for k in claims if claims[k] > 0), key=lambda k: (claims[k] / (2 * got[k] + 1), -k))
        got[best] += 1
    return got


def test_targets(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 17):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 4000]) for i in range(n)} | {None: 50, "é": 9}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = fill(sizes, (5, 2, 1), 1.5, 2.0)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1003])
def test_apportion(spark, seats):
    claims = {i: float(c) for i, c in enumerate([50, 1, 1, 0, 333, 20, 20, 7])}
    df = spark.createDataFrame([(k, v, seats) for k, v in claims.items()], "k long, claim double, seats long")
    got = {r["k"]: r["quota"] for r in apportion(df, [], [F.col("k")], "claim", "seats").collect()}
    assert got == seats_by_hand(claims, seats)


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "ç", None])) for i in range(800)] + [(None, None, "a"), (7, "same", "b"), (7, "same", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("taken", F.lit(1))
    one, two = (sorted((tuple(r) for r in mix_sources(d).drop("shard").collect()), key=repr) for d in (df, df.repartition(7)))
    assert one == two and len(one) == len(docs)
    taken, target = {}, {}
    for _, source, size, _, goal, got in one:
        assert 0 <= got <= 2 * size
        taken[source], target[source] = taken.get(source, 0) + got, goal
    assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in target)
    assert mix_sources(df.limit(0)).count() == 0
    assert [r["taken"] for r in mix_sources(df.withColumn("text", F.lit(None).cast("string"))).select("taken").distinct().collect()] == [0]


def slim(df):
    return df.select(F.col("source"), F.coalesce(F.regexp_count("text", F.lit("[^ ]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id").alias("key"))


def test_sources_of_any_size_come_to_their_targets(spark):
    """A source of a few words shares the blocks of the others: its seats are cut."""
    docs = [(i, "w " * 2000, "ab"[i % 2]) for i in range(200)] + [(900, "a few words", "tiny"), (901, "x " * 5000, "small"), (902, None, "none")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mix_sources(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"), F.min("taken").alias("least")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.5 and r["over"] <= 0 and r["least"] >= 0 for r in rows), rows


def test_quotients_decide_for_sources_and_shards(spark):
    """On the smaller test tables too, every source with words takes its seats by quotient, and sources have several shards
    that do; seats are those of the plain method."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, shards = shard_quotas(slim(df), (5, 2, 1), 1.5, 2.0, 256)
    rows = shards.collect()
    sources = {r["source"]: (r["target"], r["seats"]) for r in rows}
    goal = {s: t for s, (t, _) in sources.items()}
    all_seats = int(sum(goal.values()) / 256 + 0.5)
    order = sorted((s for s in goal if s is not None), key=lambda s: s.encode()) + [s for s in goal if s is None]
    want = seats_by_hand({order.index(s): t for s, t in goal.items()}, all_seats)
    assert {order.index(s): n for s, (_, n) in sources.items()} == want and sum(n > 0 for n in want.values()) > 10
    several = 0
    for s, (_, seats) in sources.items():
        mine = [r for r in rows if r["source"] == s]
        several += len(mine) > 1
        quota = seats_by_hand({r["shard"]: float(r["tokens"]) for r in mine}, seats)
        assert all(r["quota"] == min(quota[r["shard"]], 2 * -(-r["tokens"] // 256)) for r in mine)
    assert several > 10


# --- lines -----------------------------------------------------------------------------


def test_lines(spark):
    rng = random.Random(2)
    pool = [f"line number {i} with enough text" for i in range(30)] + ["short", ""]
    docs = []
    for i in range(120):
        picked = [rng.choice(pool) for _ in range(rng.randrange(1, 8))]
        docs.append((i, "\n".join(rng.choice([x, x.upper(), f" \t{x}\r"]) for x in picked)))
    docs += [(None, pool[0]), (None, None), (500, ""), (119, docs[119][1])]
    keys = lambda t: [fold(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    held, top = {}, {}
    for d, t in docs:
        for k in {k for k in keys(t) if len(k) >= 20}:
            held[k] = held.get(k, 0) + 1
            top[k] = max(top.get(k, -(2**63)), -(2**63) if d is None else d)
    want = []
    for d, t in docs:
        stay = [x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if not (held.get(k, 0) >= 3 and top[k] != (-(2**63) if d is None else d))]
        n = (t or "").count("\n") + 1
        want.append((d, n, n - len(stay), "\n".join(stay)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_lines", "_did", "_rid", "h1", "g1", "top")})
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in dedup_lines(df, batches=batches, fanout=fanout).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert dedup_lines(df.limit(0)).count() == 0


def test_runs_stay_few_and_know_what_is_fresh(spark):
    runs = LineRuns(spark, 2)
    for b in range(5):
        runs.add(spark.createDataFrame([(h, h, b) for h in (1, 100 + b)], "h1 long, h2 long, did long"))
        assert all(len(level) < 2 for level in runs.levels)
    got = {r["h1"]: (r["n"], r["top"]) for r in runs.totals().collect()}
    assert got == {1: (5, 4)} | {100 + b: (1, b) for b in range(5)}
    assert runs.runs().filter("h1 = 1 and fresh").count() == 1


def test_anti_join_decides_what_enters_a_run(spark, monkeypatch):
    rng = random.Random(9)
    batches = [[(rng.randrange(40), b * 100 + i) for i in range(60)] for b in range(6)]
    want = {}
    for h, d in (x for batch in batches for x in batch):
        n, top = want.get(h, (0, -1))
        want[h] = (n + 1, max(top, d))

    def totals():
        runs = LineRuns(spark, 3)
        for batch in batches:
            runs.add(spark.createDataFrame([(h, h * h, d) for h, d in batch], "h1 long, h2 long, did long"))
        fresh = runs.runs().filter("fresh")
        assert fresh.count() == fresh.select("h1", "h2").distinct().count()
        return [(r["h1"], (r["n"], r["top"])) for r in runs.totals().collect()]

    got = totals()
    assert len(got) == len(want) and dict(got) == want
    monkeypatch.setattr(LineRuns, "unseen", lambda self, own: own.withColumn("held", F.lit(False)))
    with pytest.raises(AssertionError):
        totals()


def test_joins_with_runs_move_no_run(spark):
    runs = LineRuns(spark, 4)
    lines = spark.createDataFrame([(h, h, 1) for h in range(50)], "h1 long, h2 long, did long")
    for _ in range(3):
        runs.add(lines)
    own = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("did").alias("top")).repartition(runs.buckets, "h1", "h2")
    before = spark.conf.get(lines_module.ORDERED)
    spark.conf.set(lines_module.ORDERED, "true")
    plan = runs.unseen(own)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(lines_module.ORDERED, before)
    # only the batch itself is dealt out, for its sums and to the buckets, and only it is sorted
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 2 and plan.count("SelectedBucketsCount") == 3
    assert len(re.findall(r"\bSort \[", plan)) == 1
    runs.close()


def test_runs_leave_nothing_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    root = Path(shared_dir(spark).removeprefix("file:"))
    runs = set(root.glob("line-runs-*"))
    docs = spark.createDataFrame([(i, f"a line that recurs in many documents\nand one of its own {i}") for i in range(40)], "doc_id long, text string")
    assert dedup_lines(docs).filter("n_dropped = 1").count() == 39
    assert {t.name for t in spark.catalog.listTables()} == before and set(root.glob("line-runs-*")) == runs


def test_buckets_have_a_bound(spark, monkeypatch):
    """Beyond it buckets hold more lines."""
    seen = []
    monkeypatch.setattr(lines_module, "BUCKET_LINES", 1)
    monkeypatch.setattr(lines_module, "MOST_BUCKETS", 16)
    monkeypatch.setattr(LineRuns, "__init__", lambda self, *a, f=LineRuns.__init__, **k: seen.append(k["buckets"]) or f(self, *a, **k))
    docs = spark.createDataFrame([(i, f"a line that recurs in many documents\nand one of its own {i}") for i in range(40)], "doc_id long, text string")
    assert dedup_lines(docs).filter("n_dropped = 1").count() == 39 and seen == [16] and lines_module.MOST_BUCKETS == 16


# --- decontamination -------------------------------------------------------------------


def contamination(docs, bench, n):
    windows = {}
    for item, text in bench:
        w = UNITS.findall(fold(text))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, items = UNITS.findall(fold(t)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    items |= found
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_windows_have_a_bound(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for n in (0, decontam.PLACE):
        with pytest.raises(ValueError, match="n must be"):
            report(rows, rows.withColumnRenamed("doc_id", "item_id"), n)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "MOST_ANCHORS", most)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "É", "é", "C3"]) + str(rng.randrange(4))
    bench = [(i, " ".join(word() for _ in range(rng.choice([12, 15, 30])))) for i in range(12)] + [(20, "a1, b2! C3"), (21, "solo"), (22, None), (23, "--"), (24, "one two three four five six seven")]
    bench.append((99, bench[0][1]))
    docs = []
    for i in range(150):
        w = [word() for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            src = UNITS.findall(rng.choice(bench[:12])[1])
            a = rng.randrange(0, 3)
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.choice([8, 9, 10, 11, 30])]
        docs.append((i, rng.choice([" ", "-", "\n"]).join(w).upper()))
    docs += [(None, "x SOLO"), (5, None), (5, None), (6, bench[1][1]), (6, bench[1][1]), (7, ("z " * 20_000) + bench[2][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("anchor", "rid", "_d", "_r", "_rid")}), spark.createDataFrame(bench, "item_id long, text string")
    assert sorted((tuple(r) for r in report(d, b).collect()), key=repr) == contamination(docs, bench, 10)
    long_only = b.filter("item_id < 20 or item_id = 99")
    want = contamination(docs, [x for x in bench if x[0] < 20 or x[0] == 99], 10)
    assert sorted((tuple(r) for r in report(d, long_only).collect()), key=repr) == want
    clean = decontaminate(d, long_only)
    assert clean.columns == d.columns and clean.count() == sum(not x[5] for x in want)
    cut = decontaminate(d, long_only, remove="spans")
    assert cut.count() == len(docs)
    n = {(d_, n_ - hit) for d_, n_, hit, *_ in want}
    assert {(r["doc_id"], len(UNITS.findall(fold(r["text"])))) for r in cut.collect()} == n
    assert report(d.limit(0), b).count() == 0 and report(d, b.limit(0)).filter("contaminated").count() == 0


# --- licences --------------------------------------------------------------------------


def test_licenses(spark):
    docs = [
        (1, "MIT  License\n\n© 2020 Someone\n" + MIT.replace("sublicense", "sub-license").lower()), (2, "Copyright (c) X\n" + ISC), (3, MIT + " more"), (4, None), (4, ""),
        (5, "text\nReleased under the MIT Licence!\nAll rights reserved\nmore"), (6, "x " * 30_000),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit(1))
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in scan_licenses(df).collect()}
    assert got == {1: ("MIT", ""), 2: ("ISC", ""), 3: (None, ""), 4: (None, ""), 5: (None, "MIT,proprietary"), 6: (None, "")}
    assert scan_licenses(df).count() == len(docs) and scan_licenses(df.limit(0)).count() == 0
    own = known_licenses(spark, [("X", "My Licence, v 2"), ("A", "my license version 2")])
    assert scan_licenses(spark.createDataFrame([(1, "MY LICENSE VERSION 2")], "doc_id long, text string"), own).collect()[0]["license_id"] == "A"


def test_entire_texts_of_every_licence(spark):
    folder = Path(licenses.__file__).with_name("license_texts")
    texts = {p.stem: p.read_text() for p in folder.glob("*.txt")} | {"MIT": MIT, "ISC": ISC}
    assert set(texts) == {
        "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC",
        "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
    }
    docs, want = [], []
    for name, text in texts.items():
        unwrapped = re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", text)
        for form in (text, f"Copyright 2021 The Some Authors\n{text}", unwrapped, unwrapped.upper().replace("\n\n", "\n"), *("\n".join(textwrap.wrap(" ".join(text.split()), width)) for width in range(30, 100, 7) if name in ("MIT", "ISC", "Zlib", "Unlicense"))):
            docs.append((len(docs), form))
            want.append(name)
    docs.append((len(docs), texts["GPL-3.0"].replace("a free, copyleft license", "a license")))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in scan_licenses(df).collect()}
    assert [got[i] for i in range(len(docs))] == [*want, None]


TITLED = {
    "MIT": ["MIT License", "The MIT License (MIT)", "The MIT License"], "ISC": ["ISC License", "ISC License (ISC)", "The ISC License"],
    "Zlib": ["zlib License", "The zlib License", "zlib License (Zlib)"], "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \u201cNew\u201d or \u201cRevised\u201d License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)"],
}


def test_titles_wrappings_and_quotes_of_short_licences(spark):
    folder = Path(licenses.__file__).with_name("license_texts")
    docs, want = [], []
    for name, titles in TITLED.items():
        text = {"MIT": MIT, "ISC": ISC, "0BSD": licenses.ZERO_BSD}.get(name) or (folder / f"{name}.txt").read_text()
        for title in titles:
            for width in (0, 60, 78):
                paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text)]
                body = "\n\n".join("\n".join(textwrap.wrap(p, width)) if width else p for p in paragraphs)
                for curly in (False, True):
                    form = f"{title}\n\nCopyright (c) 2023 Some One\n\n{body}"
                    form = re.sub(r'"([^"]*)"', "\u201c\\1\u201d", form).replace("'", "\u2019") if curly else form
                    docs.append((len(docs), form))
                    want.append(name)
    got = {r["doc_id"]: r["license_id"] for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(docs))] == want and len(docs) == 108


def test_copyright_statements_only(spark):
    gone = ["Copyright (c) 2020 A", "  # Copyright 2020, A", "(C) 2020 A", "© A", "Copyright Some One", "copyright [yyyy] [name]", "(c) Copyright A"]
    stay = ["copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE", "copyright and related rights", "(c) You must retain", "copyright", "the copyright 2020"]
    frame = spark.createDataFrame([(x,) for x in gone + stay], "t string").select(F.size(licenses.canonical_lines(F.col("t")))).collect()
    assert [r[0] for r in frame] == [0] * len(gone) + [1] * len(stay)


# --- quality ---------------------------------------------------------------------------


def test_statistics_against_plain_python():
    texts = ["Aa aa AA!! b", "", "x\ny|z 12", "é é é", "word " * 1000]
    got = statistics([t.encode() for t in texts])
    for row, text in zip(got, texts, strict=True):
        w = [fold(x) for x in WORDS.findall(text)]
        size = max(1, len(text.encode()))
        at = dict(zip(NAMES, row, strict=True))
        assert at["words"] == pytest.approx(np.log1p(len(w))) and at["bytes"] == pytest.approx(np.log1p(len(text.encode())))
        assert at["upper"] == pytest.approx(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / size)
        assert at["line"] == pytest.approx(text.count("\n") / size) and at["high"] == pytest.approx(sum(b > 127 for b in text.encode()) / size)
        assert at["distinct"] == pytest.approx(len(set(w)) / max(1, len(w)))
        assert at["echo"] == pytest.approx(sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(1, len(w)))
        assert at["top"] == pytest.approx(max(map(w.count, set(w)), default=0) / max(1, len(w)))


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    by_hand = []
    for row in x[1500:1520]:
        margin = model.base
        for f, limit, leaf in zip(model.feature, model.limit, model.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > limit[at] else 1)
            margin += leaf[at - len(f)]
        by_hand.append(1 / (1 + np.exp(-margin)))
    assert np.allclose(model.score(x[1500:1520]), by_hand)
    assert fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def tree_by_hand(x, grad, hess, edges, depth, least=1.0, ridge=1.0, rate=0.2):
    """One tree by trying every limit of every statistic at every node: a function of a row."""
    g, h = grad.sum(), hess.sum()
    if depth == 0:
        return lambda row: -rate * g / (h + ridge) if len(grad) else 0.0
    best = (1e-9, None, None)
    for k, limits in enumerate(edges):
        for limit in limits:
            left = x[:, k] <= limit
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            if hl >= least and h - hl >= least and gain > best[0] + 1e-12:
                best = (gain, k, limit)
    _, k, limit = best
    if k is None:
        return tree_by_hand(x, grad, hess, edges, depth - 1, least, ridge, rate)
    left = x[:, k] <= limit
    low, high = (tree_by_hand(x[m], grad[m], hess[m], edges, depth - 1, least, ridge, rate) for m in (left, ~left))
    return lambda row: low(row) if row[k] <= limit else high(row)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fitting_against_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(300, 4)), 1)
    x[:, 3] = 7.0  # tells nothing
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=300) * 0.5) > 0).astype(float)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 64 + 1)[1:-1])) for k in range(4)]
    margin = np.full(300, np.log((y.sum() + 1) / (302 - y.sum() - 1)))
    for n_trees in range(1, 5):
        p = 1 / (1 + np.exp(-margin))
        tree = tree_by_hand(x, p - y, np.maximum(p * (1 - p), 1e-12), edges, 3)
        margin = margin + np.array([tree(row) for row in x])
        assert np.allclose(fit(x, y, n_trees=n_trees, depth=3).score(x), 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_quality_on_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (None, ""), (-2, "a" * 200_000)], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True).withColumn("score", F.lit("clash"))
    got = score_quality(both, labels)
    held = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(held) > 50 and (held["predicted"] == held["quality"]).mean() > 0.95
    assert got.count() == docs.count() + 3 and got.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    assert score_quality(both, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert score_quality(both.limit(0), labels).count() == 0
