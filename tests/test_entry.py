"""The library without the corpus operators' folders."""

import os
import shutil
import subprocess
import sys

import pomelo

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(pomelo.__file__)))


def test_entry_imports_without_the_corpus_folders(tmp_path):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "pomelo"), tmp_path / "pomelo", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline'), len(e.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert got.stdout.startswith("[] 1")


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "pomelo")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    text = open(os.path.join(folder, name)).read()
                    assert "pomelo.llm" not in text and "from .llm" not in text and "corpus_pipeline" not in text
