"""The entry module with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from framelake.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["file_id", "crop_filter", "required", "multiple_ratios", "message", "total_samples"] and df.count() > 1000


def test_every_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.oracle_sql()) == set(registry.queries())


def test_stands_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))]
