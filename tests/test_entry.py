import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_names_and_sql():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60


def test_flagship(spark):
    path = "/root/testdata/sf0.001"
    if Path(path).exists():
        assert entry.entry(spark).count() > 0


def test_imports_without_the_training_data_part(tmp_path):
    """The entry module and the rest stand without corpus_pipeline.py and the llm folders."""
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("cairn.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not [k for k in e.queries() if k.startswith("op") or k == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)


def test_nothing_else_imports_the_training_data_part():
    for p in REPO.glob("cairn/**/*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
