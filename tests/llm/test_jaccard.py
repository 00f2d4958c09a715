"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from changefold.llm import jaccard
from changefold.llm.components import components, extended

WORDS = re.compile("[^\x20\x09-\x0d]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = WORDS.findall(fold(text))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, n, percent):
    """(size, smallest reachable id) per row."""
    sets = [shingles(t, n) for _, t in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def corpus(seed, families=12, size=14):
    """Families of near copies, with edits from none to many, and a passage many texts share."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    common = " ".join(word() for _ in range(25))
    texts = [None, "", " \t", "One", "one", "one two", "A b c d", "a B c D"]
    for _ in range(families):
        base = [word() for _ in range(rng.choice([4, 20, 60, 150]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[word()], [], [w[at], word()]])
                w = w or ["x"]
            texts.append(" ".join(w) + ("\n" + common if rng.random() < 0.3 else ""))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (3, 90, 2), (5, 80, 3), (2, 60, 4)])
def test_equals_brute_force(spark, n, percent, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_groups(df, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, n, percent)


def test_hot_ngrams_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_BITS", 1)
    docs = corpus(7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_groups(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, 3, 90)


def test_ties_nulls_and_extra_columns(spark):
    docs = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (None, None), (8, "q " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "n", "tid", "token", "_id", "_tid", "group")})
    got = [tuple(r) for r in jaccard.jaccard_groups(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == sorted([(5, 4, 5), (5, 4, 5), (None, 4, 5), (7, 0, 7), (None, 0, None), (8, 1, 8)], key=repr)
    kept = jaccard.keep_one(df, 3, 90)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [5, 7, 8, None]
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (5, 5)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(201)} | {(300, 300), (301, 300)}


def test_components_grow_by_more_links(spark):
    rng = random.Random(6)
    links = lambda n: [(rng.randrange(60), rng.randrange(60)) for _ in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for first, more in ((links(25), links(15)), ([], links(8)), (links(8), []), ([(1, 2), (3, 4)], [(2, 4), (9, 8), (4, 8)])):
        got = sorted(map(tuple, extended(components(frame(first)), frame(more)).collect()))
        assert got == sorted(map(tuple, components(frame(first + more)).collect()))


def test_keep_one_groups_by_links_alone(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda k, last="": " ".join(f"{k}{w}" for w in words) + last
    docs = [
        (1, text("a")), (1, text("b")), (2, text("b", " end")), (1, text("c")),  # one id, unlike texts, one of them with a near copy
        (None, text("d")), (None, text("d", " end")), (None, text("d", " stop")), (None, text("e")),  # near copies without ids
        (9, text("f")), (7, text("f", " end")),
    ]
    kept = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80).collect()]
    assert sorted(k for k in kept if k[0] is not None) == sorted([(1, text("a")), (1, text("b")), (1, text("c")), (7, text("f", " end"))])
    none = [t for i, t in kept if i is None]
    assert len(none) == 2 and text("e") in none


def test_small_tiles_and_blocks(spark, monkeypatch):
    for name, value in (("TILE", 3), ("PAIRS", 16), ("BLOCK", 2), ("TOGETHER", 200)):
        monkeypatch.setattr(jaccard, name, value)
    docs = corpus(11)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_groups(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, 3, 90)


def test_documents_of_one_form_give_few_pairs(spark, monkeypatch):
    """Texts that share most words, few of them similar: pairs that share an n-gram grow with
    the square of their number; those that become rows don't."""
    rng = random.Random(1)
    docs = []
    for i in range(900):
        w = [f"w{k}" for k in range(60)]
        for slot in range(12):
            w[5 * slot] = f"s{slot}_{rng.randrange(4)}"
        docs.append((i, " ".join(w)))
    seen, plain = [], jaccard.verified

    def counted(pairs, *args):
        seen.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = jaccard.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert sum(seen) < len(docs) and sorted(map(tuple, got), key=repr) == brute(docs, 3, 90)
