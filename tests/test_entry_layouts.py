"""The driver's entry with and without the optional subpackage."""
from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SHOW = "import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); assert set(o) <= set(q); print(len(q), sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"


def shown(folder: str) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_entry_without_the_subpackage(tmp_path):
    for pipeline in (True, False):
        to = tmp_path / str(pipeline)
        shutil.copytree(os.path.join(ROOT, "evalspark"), to / "evalspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), to)
        if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
            shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), to)
        said = shown(str(to))
        assert said.rstrip().endswith("[]") and int(said.split()[0]) >= 103


def test_entry_of_this_layout():
    said = shown(ROOT)
    if os.path.isdir(os.path.join(ROOT, "evalspark", "llm")) and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        assert "pipeline" in said and "op10_decontam" in said
    else:
        assert "op1" not in said
