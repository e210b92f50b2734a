"""The driver contract without the training-data operators: in a copy, with and without the pipeline's file."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parents[1]
SCRIPT = "import __spark_entry__ as e; print(sorted(set(e.queries()) - set(e.QUERIES)), set(e.oracle_sql()) == set(e.ORACLES))"


@pytest.mark.parametrize("gone", [["gleanery/llm"], ["gleanery/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        path = tmp_path / "r" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(tmp_path / "r"), "PYTHONDONTWRITEBYTECODE": "1"}
    said = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    if "gleanery/llm" in gone:
        assert said.stdout.strip() == "[] True"


def test_a_broken_import_is_not_swallowed(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "llm"))
    (tmp_path / "r/gleanery/llm").mkdir()
    (tmp_path / "r/gleanery/llm/__init__.py").write_text("")
    (tmp_path / "r/gleanery/llm/queries.py").write_text("import no_such_module_anywhere\n")
    env = os.environ | {"PYTHONPATH": str(tmp_path / "r"), "PYTHONDONTWRITEBYTECODE": "1"}
    said = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
    assert said.returncode != 0 and "no_such_module_anywhere" in said.stderr
