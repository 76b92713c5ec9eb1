"""The entry point with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def copied(tmp_path, *left_out):
    skip = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "metastore_db", *left_out)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    return [x.split() for x in said.stdout.splitlines()]


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_survey_queries_stand_alone(tmp_path, left_out):
    queries, oracles = copied(tmp_path, *left_out)
    assert "altitude_mae" in queries and "altitude_mae" in oracles
    assert "pipeline" not in queries
    if "llm" in left_out:
        assert not [x for x in queries + oracles if x.startswith("op") and x[2].isdigit()]
