"""The driver contract, with and without the optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["id", "value", "k"] and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_optional_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(q) == set(e.oracle_sql()); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
