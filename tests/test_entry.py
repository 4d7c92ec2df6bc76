import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SHUTIL = """
import re, sys, pathlib, shutil, tempfile
root = pathlib.Path(sys.argv[1])
copy = pathlib.Path(tempfile.mkdtemp()) / "repo"
shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
sys.path.insert(0, str(copy))
import __spark_entry__ as e
assert e.__file__.startswith(str(copy))
names = set(e.queries())
assert "dedupe_smart" in names and not any(re.match(r"op\\d+_|pipeline", n) for n in names)
assert set(e.oracle_sql()) <= names
import pytest
import bibspark
assert bibspark.__file__.startswith(str(copy))
code = pytest.main(["-q", "-p", "no:cacheprovider", str(copy / "tests" / "test_scanner.py"), str(copy / "tests" / "test_splits.py") + "::test_functions_of_pieces"])
shutil.rmtree(copy.parent)
sys.exit(int(code))
"""


def test_works_without_the_llm_subpackage():
    done = subprocess.run([sys.executable, "-c", SHUTIL, str(ROOT)], capture_output=True, text=True, cwd="/tmp", env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stdout + done.stderr


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
