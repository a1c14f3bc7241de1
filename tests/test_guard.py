"""The rest of the repository works without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "gristmill", tmp_path / "gristmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_llm():
    for p in (ROOT / "gristmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "gristmill").parts:
            assert "gristmill.llm" not in p.read_text(), p
