"""The engine and its tests work where the training-data subpackage has been deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def without(tmp_path):
    """A copy of the repository without the subpackage, its tests and the pipeline."""
    for name in ("panelspark", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_import_without_the_subpackage(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=without(tmp_path), check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def run(tmp_path, *what):
    """pytest in the copy. What the parent's path holds besides this repository stays; on failure the
    inner output is shown."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and ROOT not in (Path(p).resolve(), *Path(p).resolve().parents)]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), str(tmp_path / "tests"), *paths]), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "--rootdir", str(tmp_path), *what], cwd=tmp_path, env=env, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
    assert done.returncode == 0, done.stdout[-6000:]


def test_other_tests_without_the_subpackage(tmp_path):
    """All are collected, and those of evidence and the flagship query pass."""
    without(tmp_path)
    run(tmp_path, "--collect-only", "tests")
    run(tmp_path, "tests/test_evidence.py", "tests/test_queries.py::test_entry")
