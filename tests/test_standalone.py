"""The library stands without the training-data subpackage and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_them(tmp_path):
    shutil.copytree(ROOT / "ledgerfold", tmp_path / "ledgerfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__", "test_standalone.py", "test_engine.py", "test_model.py"))
    out = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-x", "-q", "-p", "no:cacheprovider", "-k", "kernels or live_scan or record_log or prefix_and_cursor"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and " passed" in out.stdout, out.stdout


def test_a_broken_subpackage_is_an_error(tmp_path):
    """Only a missing subpackage is passed over; one that can't be imported must not lose its queries in silence."""
    shutil.copytree(ROOT / "ledgerfold", tmp_path / "ledgerfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "ledgerfold" / "llm").mkdir()
    (tmp_path / "ledgerfold" / "llm" / "__init__.py").write_text("")
    (tmp_path / "ledgerfold" / "llm" / "queries.py").write_text("import a_package_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode != 0 and "a_package_that_is_not_there" in out.stderr


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "ledgerfold").rglob("*.py"):
        if "llm" not in f.parts:
            assert "ledgerfold.llm" not in f.read_text()
