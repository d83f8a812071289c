import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from parity import connect, difference

SF = "/root/testdata/sf0.001"
ROOT = Path(entry.__file__).resolve().parent
NAMES = sorted(set(entry.oracle_sql()) & set(entry.queries()))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    assert difference(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_llm_folder(tmp_path):
    for p in ROOT.rglob("*.py"):
        at = p.relative_to(ROOT)
        if "llm" not in at.parts and at.name != "corpus_pipeline.py":
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_text(p.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()), *e.oracle_sql())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    names = said.stdout.split()
    assert "attempt_costs" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
