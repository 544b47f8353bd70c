"""The library stands without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


CODE = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def entry_of_a_copy(tmp_path, *left_out, before=""):
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json", *left_out))
    said = subprocess.run([sys.executable, "-c", before + CODE], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
    return *map(int, said.stdout.split()), said.stderr


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_operators(tmp_path, left_out):
    n, corpus, said = entry_of_a_copy(tmp_path, *left_out)
    assert n > 30 and corpus == 0 and "left out" not in said


def test_a_missing_library_is_named(tmp_path):
    n, corpus, said = entry_of_a_copy(tmp_path, before="import sys; sys.modules['zstandard'] = None; ")
    assert n > 30 and corpus == 0 and "left out" in said and "zstandard" in said


def test_nothing_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "skylattice")):
        if os.path.basename(folder) != "llm":
            for name in files:
                if name.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, name), encoding="utf-8").read(), name
