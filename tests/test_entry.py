"""The entry module without the subpackage that may be left out."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDE = """
import sys
sys.path.insert(0, {root!r})

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r} or name.startswith("readpaths.llm."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
print(sorted(n for n in entry.queries() if n == "pipeline" or n.startswith("op")), len(entry.queries()) > 40, set(entry.oracle_sql()) <= set(entry.queries()))
"""


def run(*names):
    code = HIDE.format(root=ROOT, names=names)
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)


def test_without_subpackage_and_pipeline():
    assert run("readpaths.llm", "corpus_pipeline").stdout.strip() == "[] True True"


def test_without_subpackage_the_pipeline_goes_too():
    assert run("readpaths.llm").stdout.strip() == "[] True True"


def test_other_missing_modules_are_reported():
    out = run("readpaths.llm", "readpaths.plans")
    assert out.returncode and "readpaths.plans" in out.stderr
