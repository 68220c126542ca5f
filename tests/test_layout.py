"""The library stands without its llm subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_llm_imports_it():
    for path in [*ROOT.glob("postlake/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path != Path(__file__).resolve():
            assert "postlake.llm" not in path.read_text(), path


def test_entry_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "postlake", tmp_path / "postlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
