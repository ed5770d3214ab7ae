"""The rest works without the subpackage for training data."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "stratum").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "stratum").parts:
            assert not re.search(r"stratum\.llm|from \.+llm|import llm", p.read_text()), p


def test_entry_without_them(tmp_path):
    shutil.copytree(ROOT / "stratum", tmp_path / "stratum", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'e2e_triage' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
