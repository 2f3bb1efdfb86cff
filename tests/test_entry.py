"""The entry point with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from learnspark.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_has_its_own_sql_name():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_without_the_training_data_folders(tmp_path):
    ignore = shutil.ignore_patterns("__pycache__", "llm", "corpus_pipeline.py")
    for keep_pipeline in (False, True):
        at = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT / "learnspark", at / "learnspark", ignore=ignore)
        shutil.copy(ROOT / "__spark_entry__.py", at)
        if keep_pipeline:
            (at / "corpus_pipeline.py").write_text("import learnspark.llm.packing\n")
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, check=True).stdout.split()
        assert out == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))]
