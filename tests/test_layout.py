"""The library stands without the llm package; nothing but the entry module knows of it."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_nothing_else_names_llm():
    for path in (REPO / "grainmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "grainmill.llm" not in path.read_text(), path


def test_keys_have_queries():
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
