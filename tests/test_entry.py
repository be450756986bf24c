"""The driver's entry points, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [k for k in e.queries() if k.startswith('op') or k == 'pipeline'])"


def run(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, env=os.environ | {"PYTHONPATH": folder}, capture_output=True, text=True, timeout=120)


def test_imports_without_the_training_data_operators(tmp_path):
    for pipeline in (True, False):
        to = tmp_path / str(pipeline)
        shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
        got = run(str(to))
        assert got.returncode == 0, got.stderr
        assert got.stdout.strip().endswith("[]") and int(got.stdout.split()[0]) > 60


def test_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
