"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_stands_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bt_summary' in q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, check=True, timeout=120)


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "barlab")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "barlab.llm" not in f.read(), name
