"""The entry module works without the optional parts, whichever of them are gone."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), sorted(q for q in e.queries() if q.startswith(('op', 'pipeline'))), len(e.oracle_sql()))"


@pytest.mark.parametrize("path", [None, ROOT])  # a path that holds this repository offers its corpus_pipeline too
@pytest.mark.parametrize("gone", [["folium/llm", "tests/llm"], ["folium/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone, path):
    for name in ("folium", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    for name in gone:
        target = tmp_path / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": path} if path else {})
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "pipeline" not in done.stdout
    if "folium/llm" in gone:
        assert "op1_" not in done.stdout
