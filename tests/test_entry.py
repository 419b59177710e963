"""The entry point with and without the training-data subpackage, each in an interpreter of its own."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n == 'pipeline' or n.startswith('op1_')), len(e.queries()), len(e.oracle_sql()), set(e.oracle_sql()) <= set(e.queries()))"


def said(folder) -> str:
    run = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(folder)})
    assert run.returncode == 0, run.stderr
    return run.stdout


@pytest.mark.parametrize("gone", [["quern/llm", "tests/llm"], ["quern/llm", "tests/llm", "corpus_pipeline.py"]])
def test_without_the_subpackage(tmp_path, gone):
    folder = tmp_path / "copy"
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *[os.path.basename(g) for g in gone]))
    assert said(folder).startswith("[]") and said(folder).strip().endswith("True")


def test_without_the_pipeline_only(tmp_path):
    if not os.path.isdir(f"{ROOT}/quern/llm"):
        pytest.skip("the subpackage is not there")
    folder = tmp_path / "copy"
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "corpus_pipeline.py"))
    assert "pipeline" not in said(folder)
