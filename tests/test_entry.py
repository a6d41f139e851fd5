"""The driver's contract, also without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_oracles(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["chunk_id", "document", "words", "delta", "level", "verdict"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_optional_parts(tmp_path):
    shutil.copytree(ROOT / "inkwell", tmp_path / "inkwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
