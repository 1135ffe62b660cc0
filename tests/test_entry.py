from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_ranks_methods(spark):
    got = entry.entry(spark).collect()
    assert len(got) == 15 and {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) >= 70


def test_entry_stands_without_the_training_data_operators():
    code = "import sys; sys.modules['tabassay.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op')])"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.strip().endswith("[]"), done.stderr


def test_library_does_not_import_them():
    for path in (ROOT / "tabassay").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tabassay.llm" not in path.read_text(), path
