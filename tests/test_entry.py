"""The driver's functions work with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_lives_without_llm(tmp_path):
    import shutil

    for name in ("threadloom", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'g23_sentiment_edges' in q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_library_lives_where_llm_cannot_be_imported(tmp_path):
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'g23_sentiment_edges' in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"})


def test_nothing_else_imports_llm():
    for path in (ROOT / "threadloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "threadloom").parts:
            assert "llm" not in path.read_text(), path
