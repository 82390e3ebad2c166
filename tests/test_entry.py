"""The entry module works without the training-data operators, and says so when something they need is missing."""

from __future__ import annotations

import subprocess
import sys
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys, warnings
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hide())
with warnings.catch_warnings(record=True) as caught:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
    names, sql = entry.queries(), entry.oracle_sql()
print(len(names), sum(n.startswith("op") and n[2].isdigit() for n in names), len(set(sql) - set(names)),
      sum("left out" in str(w.message) for w in caught))
"""


def counts(*hidden: str) -> list[int]:
    done = subprocess.run([sys.executable, "-c", HIDE.format(hidden=set(hidden))], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return list(map(int, done.stdout.split()))


def test_without_the_subpackage_or_what_it_needs():
    found, operators, orphans, warned = counts("ledgerscope.llm")
    assert found > 190 and operators == 0 and orphans == 0 and warned == 0
    there = os.path.isdir(os.path.join(ROOT, "ledgerscope", "llm"))
    *names, warned = counts("xxhash")
    assert names == [found, 0, 0] and (warned > 0) == there
    assert (counts("no_such_module")[0] > found) == there
