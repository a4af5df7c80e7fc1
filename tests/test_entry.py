"""The entry without the corpus operators, in a copy of the repository."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 150 and not [n for n in names if n.startswith("op") or n == "pipeline"]
assert set(e.oracle_sql()) <= names
"""


@pytest.mark.parametrize("left", ["nothing", "empty folder"])
def test_entry_when_the_folders_are_deleted(tmp_path, left):
    for name in ("palimpsest", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path)
    if left == "empty folder":
        (tmp_path / "palimpsest" / "llm").mkdir()
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
