"""The library without its training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_operators(tmp_path):
    for name in ("gemello", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'm1_manifest' in q and not any(k.startswith('op1') or k == 'pipeline' for k in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_else_imports_the_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "gemello")):
        if "llm" not in folder.split(os.sep):
            for f in (x for x in files if x.endswith(".py")):
                with open(os.path.join(folder, f)) as text:
                    assert "gemello.llm" not in text.read(), f
