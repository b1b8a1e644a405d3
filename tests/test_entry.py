import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
HIDE = """
import importlib.abc, sys
hidden = {hidden!r}
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in hidden:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hide())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from lodestone.catalog import ORACLES, QUERIES
names = set(entry.queries())
assert set(QUERIES) <= names and set(ORACLES) <= set(entry.oracle_sql())
print(*sorted(names - set(QUERIES)))
"""


@pytest.mark.parametrize("hidden", [["lodestone.llm", "corpus_pipeline"], ["lodestone.llm"], ["corpus_pipeline"]])
def test_entry_without_training_data_operators(hidden):
    script = HIDE.format(hidden=hidden, root=str(ROOT))
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=ROOT)
    assert run.returncode == 0, run.stderr
    added = run.stdout.split()
    assert "pipeline" not in added
    assert (added == []) == ("lodestone.llm" in hidden)
