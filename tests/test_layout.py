"""The library stands without its training-data subpackage."""

import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if path.parent.name == "llm":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tidemark.llm") for n in names), path


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession

q, o = e.queries(), e.oracle_sql()
assert len(q) > 80 and set(o) <= set(q) and not any(n.startswith('op') for n in q)
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'UTC').getOrCreate()
assert q['a1_count'](spark, '/root/testdata/sf0.001').first()[0] > 0 and q['d5_steps'](spark, '/root/testdata/sf0.001').count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
