"""The driver's contract, with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parents[1]


def test_core_never_imports_llm():
    for path in (REPO / "docloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "docloom.llm" not in path.read_text(), path


@pytest.mark.parametrize("gone", [("docloom/llm", "tests/llm"), ("docloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_llm(tmp_path, gone):
    """The whole repository but for what is taken out: with and without corpus_pipeline.py."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(o) <= set(q) and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True)


def test_flagship(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["question", "corpus", "block", "full", "partial", "precision", "coverage", "rank"] and frame.count() > 0
