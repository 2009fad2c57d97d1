"""The repository without its training-data subpackage, and what may import it."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quern").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"quern\.llm|from quern import llm", path.read_text()), path


def test_entry_works_without_it(tmp_path):
    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_errors_inside_it_are_not_hidden(tmp_path):
    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "quern/llm").mkdir()
    (tmp_path / "quern/llm/__init__.py").write_text("")
    (tmp_path / "quern/llm/registry.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
