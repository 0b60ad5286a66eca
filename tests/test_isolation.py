"""The library without the training-data subpackage: everything else still imports and runs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert found and not [k for k in found if k.startswith("op") and k[2:3].isdigit()] and "pipeline" not in found
assert set(sql) <= set(found)
import sys
assert not [m for m in sys.modules if m.startswith("platewright.llm")]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("gone", [("corpus_pipeline.py", "platewright/llm", "tests/llm"), ("platewright/llm", "tests/llm")])
def test_without_the_subpackage(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = tmp_path / "repo" / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONSTARTUP")}
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
