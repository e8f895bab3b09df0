"""The entry keeps its own queries where the optional subpackage or one of its libraries is missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), sum(q.startswith("op") for q in entry.queries()))
"""


@pytest.mark.parametrize("blocked", [["tenderloom.llm"], ["corpus_pipeline"], ["ahocorasick"], ["tokenizers"]])
def test_missing_parts(blocked):
    done = subprocess.run(
        [sys.executable, "-W", "always", "-c", CODE.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, check=True
    )
    queries, statements, optional = map(int, done.stdout.split())
    assert queries == statements > 100 and optional == 0
    library = blocked[0] in ("ahocorasick", "tokenizers")
    assert ("training-data queries are left out" in done.stderr) <= library or os.path.isdir(f"{ROOT}/tenderloom/llm")
