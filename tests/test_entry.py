"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

from courtline import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), set(e.oracle_sql()) <= set(q))"


def counted(folder) -> list[str]:
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def copy_without(tmp_path, *left_out: str):
    folder = tmp_path / "copy"
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md", *left_out))
    return folder


def test_rest_loads_without_the_subpackage(tmp_path):
    entries = catalog.entries()
    want = [str(len(entries)), str(sum(bool(e.sql) for e in entries.values())), "True"]
    assert counted(copy_without(tmp_path, "llm")) == want


def test_rest_loads_without_subpackage_and_pipeline(tmp_path):
    assert counted(copy_without(tmp_path, "llm", "corpus_pipeline.py"))[0] == str(len(catalog.entries()))
