import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_queries_and_sql_fit():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p4_found", "bm25_topk"} <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "lawmill").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "lawmill.llm" not in f.read_text(), f


def test_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['lawmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    assert importlib.import_module("lawmill").__version__


def test_query_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["snapshot", "title", "change"] and df.count() > 0
