"""The corpus pipeline, stage by stage, against brute force."""

import corpus_pipeline as cp
from changefold.llm.common import saved, shared_dir
from changefold.llm.quality import score_quality

from tests.llm.test_jaccard import brute
from tests.llm.test_text_operators import contamination, fold

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for name, stage in cp.STAGES:
        after = saved(stage(spark, docs, SF), f"test-{name}")
        if name != "mix":
            assert after.columns == list(cp.COLUMNS)
        before, got = as_rows(docs), as_rows(after) if name != "mix" else None
        if name == "quality":
            want = {r["doc_id"] for r in score_quality(docs, labels).filter("predicted = 1").collect()}
            assert set(got) == want and all(got[d] == before[d] for d in got)
        elif name == "lines":
            key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
            held = {}
            for d, t in before.items():
                for k in {key(x) for x in t.split("\n")}:
                    held.setdefault(k, set()).add(d)
            gone = {k for k, ds in held.items() if len(k) >= 20 and len(ds) >= 3}
            assert got == {d: "\n".join(x for x in t.split("\n") if key(x) not in gone or max(held[key(x)]) == d) for d, t in before.items()}
        elif name == "near_duplicates":
            groups = brute(list(before.items()), 5, 80)
            want = {c for _, n, c in groups if n} | {d for d, n, _ in groups if not n}
            assert set(got) == want and all(got[d] == before[d] for d in got)
        elif name == "benchmark":
            clean = {d for d, *_, bad in contamination(list(before.items()), bench, 10) if not bad}
            assert got == {d: t for d, t in before.items() if d in clean}
        else:
            rows = after.collect()
            assert all(0 < r["taken"] <= 2 * r["size"] for r in rows) and {r["doc_id"] for r in rows} <= set(before)
            goal = {r["source"]: r["target"] for r in rows}
            took = {s: sum(r["taken"] for r in rows if r["source"] == s) for s in goal}
            assert all(abs(took[s] - goal[s]) <= max(2, 0.02 * goal[s]) for s in goal)
        seen.append(name)
        docs = after
    assert seen == ["quality", "lines", "near_duplicates", "benchmark", "mix"]


def test_stages_on_edge_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table."""
    form = "doc_id long, text string, lang string, source string, n_chars long"
    real = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    odd = [(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0), (-2, "word " * 100_000, None, "s", None), (-3, None, "en", None, 0), (None, "a b c", "en", "s", 5), (-4, "\n\n \n", "en", "s", 4)]
    docs = real.unionByName(spark.createDataFrame(odd, form))
    for docs in (docs, real.limit(0), spark.createDataFrame(odd, form)):
        for name, stage in cp.STAGES:
            before, docs = docs, saved(stage(spark, docs, SF), f"edge-{name}")
            if name != "mix":
                assert docs.columns == list(cp.COLUMNS) and docs.count() <= before.count()
                if name != "quality":  # what has no words is no copy and no passage
                    blank = "coalesce(trim(translate(text, chr(10), ' ')), '') = ''"
                    keys = lambda df: {(r["doc_id"], r["source"]) for r in df.filter(blank).collect()}
                    assert keys(before) <= keys(docs)
            else:
                assert docs.filter("taken <= 0 or taken > 2 * size").count() == 0


def test_run_keeps_only_its_result(spark):
    def tables():
        root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        return {s.getPath().getName() for s in files.listStatus(root)} if files.exists(root) else set()

    before, named = tables(), spark.catalog.listTables()
    done = cp.run(spark, SF)
    made = tables() - before
    assert done.count() > 0 and {x.rsplit("-", 1)[0] for x in made} == {f"pipeline-{name}" for name, _ in cp.STAGES}
    assert spark.catalog.listTables() == named
