"""The library stands without the subpackage for training data and its pipeline."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "lakequill", tmp_path / "lakequill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "lakequill").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import)[^\n]*\bllm\b", p.read_text()), p
