"""Fill-in-middle, byte-level BPE and spelling variants against plain Python and tiktoken."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changefold.llm import bpe, fim, queries, variants

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, n int, form string, ids string, word string"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "x", "y", "z") for i, t in rows], SCHEMA)


ROWS = [
    (1, None), (2, ""), (3, "a"), (4, "plain words, in a row\nand a line"), (4, "plain words, in a row\nand a line"), (5, "漢字 and é𝄞 mixed"), (6, "has <M> in it"), (None, "no id"),
    (7, "x" * 70_000), (8, "é" * 70_000), (9, "xé" * 50_000 + "\n" * 20_000), (10, "it's 12 o'clock <|endoftext|>  \n\n done"),
    *[(k, "some text é " * (k % 37)) for k in range(11, 120)],
]


# --- fill in the middle ----------------------------------------------------------------


def cut_plainly(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_cuts_equal_slices_of_text(spark):
    got = fim.fill_in_middle(docs_of(spark, ROWS)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:-1] for r in got], key=key) == sorted([(i, *cut_plainly(i, t)) for i, t in ROWS], key=key)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in ROWS)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_registered_query_has_digests_of_the_cuts(spark, tmp_path):
    docs_of(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op11_fill_in_middle(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {(i, *cut_plainly(i, t)[:4], sha(cut_plainly(i, t)[4]), sha(t or "")) for i, t in ROWS}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_cuts_of_words_and_lines_fall_between_them(spark, unit):
    whole = {"word": r"\s+\S*|\S+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    for r in fim.fill_in_middle(docs_of(spark, ROWS), unit=unit, plain_percent=0).collect():
        if r["form"] != "plain":
            parts = re.split("<[PSM]>", r["output"])[1:]
            prefix, middle = (parts[0], parts[2]) if r["form"] == "psm" else (parts[1], parts[2])
            assert len(re.findall(whole, prefix)) == r["prefix_units"] and len(re.findall(whole, middle)) == r["middle_units"], r


def test_own_marks_and_no_rows(spark):
    marks = ("[p]", "[s]", "(m)")
    rows = fim.fill_in_middle(docs_of(spark, ROWS), plain_percent=0, spm_percent=100, marks=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert sorted(r["back"] for r in rows) == sorted(t or "" for _, t in ROWS) and {r["form"] for r in rows} == {"plain", "spm"}
    assert fim.fill_in_middle(docs_of(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "é", "漢", "𝄞", "a é"]), st.integers(1, 9000)), max_size=25))
def test_select_on_all_containers(parts):
    text = "".join(c * n for c, n in parts)
    held = fim.BoundarySet(np.frombuffer(text.encode(), np.uint8))
    assert len(held) == len(text)
    for k in {0, len(text), len(text) // 2, len(text) // 3, *random.Random(len(text)).choices(range(len(text) + 1), k=5)}:
        assert held.select(k) == len(text[:k].encode())


def test_each_container_is_used_where_it_is_least():
    kind = lambda mask: type(fim.container(np.array(mask, dtype=bool))[0])
    assert kind([True] * fim.SPAN) is fim.RunContainer
    assert kind(([True] + [False] * 40) * 1500) is fim.ArrayContainer
    assert kind(([True] + [False]) * (fim.SPAN // 2)) is fim.BitmapContainer


# --- byte-level BPE --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec_of(bpe.read_vocabulary(PATH))


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_texts_equal_the_library(spark, library):
    rows = bpe.decode_texts(bpe.encode_texts(docs_of(spark, ROWS), PATH), PATH).collect()
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows)
    want = Counter()
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()] += 1
    assert got == want
    assert bpe.encode_texts(docs_of(spark, []), PATH).collect() == []


def test_registered_query_equals_the_library(spark, library, tmp_path):
    docs_of(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op12_byte_bpe(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = {(i, t): library.encode_ordinary(t or "") for i, t in ROWS}
    assert got == {(i, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for (i, t), x in ids.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text_equals_the_library(codec, library, text):
    assert ids_of(codec, text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=300))
def test_ascii_texts_equal_the_library(codec, library, text):
    assert codec.ascii and ids_of(codec, text) == library.encode_ordinary(text)
    assert codec.ascii.findall(text) == codec.pattern.findall(text)


@pytest.mark.parametrize("letters", ["a", "ab", "aé漢", "abcdefghijklmnopqrstuvwxyz", "-=", "  \n", "etaoin", "0123456789"])
def test_long_pieces_go_through_the_tree(codec, library, letters):
    rng = random.Random(len(letters))
    for n in (63, 64, 65, 127, 128, 129, 1000, 5000):
        for text in ("".join(rng.choices(letters, k=n)), letters[0] * n):
            assert ids_of(codec, text) == library.encode_ordinary(text)


def test_joins_of_any_halves_equal_the_whole(codec):
    rng = random.Random(5)
    for _ in range(200):
        data = "".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 150))).encode()
        at = rng.randrange(1, len(data))
        assert codec.join(codec.merge(data[:at]), codec.merge(data[at:])) == codec.merge(data)


def test_windows_stay_small(codec, monkeypatch):
    """A join encodes a few bytes anew, not the halves."""
    seen, merge = [], codec.merge
    monkeypatch.setattr(codec, "merge", lambda data: seen.append(len(data)) or merge(data))
    codec.encode_piece(("internationalization" * 500).encode())
    assert max(seen) < 1000


def test_texts_are_cut_only_where_matches_end(codec, library):
    words = "".join("word %d  \n" % k for k in range(20_000))
    for text in (words, "x" * 40_000 + words, words + "x" * 40_000, "a b " + "y" * 50_000, "\n" * 50_000):
        assert ids_of(codec, text) == library.encode_ordinary(text)


def test_vocabularies_need_all_bytes():
    with pytest.raises(ValueError, match="single byte"):
        bpe.Codec({b"a": 0})


# --- spelling variants -----------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_plainly(counts, ratio=5):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def some_words(rng, n, letters="abcé"):
    return {"".join(rng.choices(letters, k=rng.randrange(0, 9))): rng.choice([1, 2, 5, 6, 30, 150, 800]) for _ in range(n)}


@pytest.mark.parametrize("part", [2048, 7])
def test_pairs_equal_brute_force_with_any_parts(spark, part):
    counts = some_words(random.Random(part), 300)
    rows = variants.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long"), part).collect()
    got = Counter((r["word"], r["near"], r["near_n"]) for r in rows)
    assert got == Counter((a, b, counts[b]) for a in counts for b in counts if one_edit(a, b))


def test_groups_equal_brute_force(spark):
    counts = some_words(random.Random(3), 300)
    rows = variants.variant_groups(spark.createDataFrame([*counts.items(), (None, 3), ("lost", None)], "word string, n long")).collect()
    assert {tuple(r) for r in rows} == groups_plainly(counts) and len(rows) == len(counts)
    assert any(r["root"] not in (r["word"], r["form"]) for r in rows), "no chain of two forms was tried"


def test_registered_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    base = ["sentence", "sentense", "Sentences", "élégance", "elegance", "straßen", "strassen", "straten", "window", "windows", "widow", "wondow"]
    texts = [(k, " ".join(rng.choices(base, weights=[90, 3, 15, 60, 8, 40, 5, 4, 99, 12, 6, 3], k=80)) + ".") for k in range(120)]
    texts += [(500, None), (501, ""), (502, "1234 -- 漢字"), (None, "sentence sentence"), (7, texts[7][1]), (503, "sentencesentence" * 5000)]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    rows = [tuple(r) for r in queries.op13_spelling_variants(spark, str(tmp_path)).collect()]
    assert len(rows) == len(counts) and set(rows) == groups_plainly(counts)


def test_no_words_and_bad_ratio(spark):
    assert variants.spelling_variants(docs_of(spark, [(1, None), (2, "")])).collect() == []
    with pytest.raises(ValueError, match="ratio"):
        variants.variant_groups(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_frequent_words_are_added_up_before_the_shuffle(spark):
    plan = variants.vocabulary(variants.runs(docs_of(spark, ROWS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
