"""The corpus operators are an optional part: without them the rest imports and has its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "termlake", tmp_path / "termlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from termlake import catalog; assert e.queries().keys() == catalog.QUERIES.keys() and e.oracle_sql() == catalog.SQL"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_an_error_within_them_is_not_passed_over(tmp_path):
    shutil.copytree(ROOT / "termlake", tmp_path / "termlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "termlake" / "llm").mkdir()
    (tmp_path / "termlake" / "llm" / "__init__.py").write_text("")
    (tmp_path / "termlake" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode and "no_such_module_at_all" in done.stderr


def test_nothing_else_imports_them():
    for path in (ROOT / "termlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
