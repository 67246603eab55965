"""The entry with and without what the training-data operators need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys, warnings
sys.modules[{blocked!r}] = None
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    import __spark_entry__ as e
assert len(e.queries()) == len(e.catalog.QUERIES) >= 187 and set(e.oracle_sql()) <= set(e.queries())
assert not any(n.startswith("op1_") for n in e.queries()) and any({blocked!r} in str(w.message) for w in told)
"""


@pytest.mark.parametrize("blocked", ["regex", "zstandard", "corpus_pipeline", "engram.llm"])
def test_missing_dependency(blocked):
    if not (ROOT / "corpus_pipeline.py").exists() and blocked not in ("corpus_pipeline", "engram.llm"):
        pytest.skip("the operators are not here")
    done = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_whole_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.catalog.QUERIES) >= 187
