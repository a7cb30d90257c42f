"""The library without the text operators: both of their folders deleted, the pipeline's file left or gone."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_and_tests_stand_alone(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    check = "import __spark_entry__ as e, loomstream.plans.queries as p; assert set(e.queries()) == set(p.Q) and set(e.oracle_sql()) == set(p.SQL)"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-B", "-c", check], cwd=copy, env=env, check=True, timeout=120)
    collected = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert collected.returncode == 0, collected.stdout[-2000:]
