"""The driver contract, with and without the optional corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    frame = entry.entry(spark)
    assert {"s_suppkey", "score", "ranking", "class"} <= set(frame.columns) and frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "waymark", tmp_path / "waymark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_subpackage():
    for path in [*ROOT.glob("waymark/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts and path.name != "test_entry.py":
            assert "waymark.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
