import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql_belong_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_a_session_and_without_training_data(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "warpweft", tmp_path / "warpweft", ignore=lambda _, names: [n for n in names if n in ("llm", "__pycache__")])
    code = "import __spark_entry__ as e; print(sum(1 for q in e.queries() if q.startswith('p1_')), len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    training, every, sql = map(int, said.stdout.split())
    assert training == 0 and every >= sql > 50


def test_core_never_names_the_training_data_package():
    for p in (ROOT / "warpweft").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"warpweft\.llm|from warpweft import llm", p.read_text()), p


def test_flagship(spark):
    if Path("/root/testdata/sf0.001").exists():
        first = entry.entry(spark).first()
        assert first["freq"] > 1 and first["type"]
