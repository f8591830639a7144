"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k[:2] == 'op' and k[2:3].isdigit() for k in q) + ('pipeline' in q))"


def ask(folder: Path) -> list[int]:
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    said = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return [int(x) for x in said.stdout.split()]


def test_rest_stands_alone(tmp_path):
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, corpus = ask(tmp_path)
    assert n > 250 and corpus == 0


def test_a_broken_dependency_is_an_error(tmp_path):
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "quillon" / "llm").mkdir()
    (tmp_path / "quillon" / "llm" / "__init__.py").write_text("")
    (tmp_path / "quillon" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    said = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode != 0 and "no_such_module_at_all" in said.stderr
