"""The entry module imports without the training-data operators or a library they need."""

import subprocess
import sys

from conftest import ROOT

COUNT = "import __spark_entry__ as E; q = E.queries(); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"


def _run(before: str) -> list[str]:
    out = subprocess.run([sys.executable, "-c", f"import sys; {before}; {COUNT}"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_a_missing_library_costs_only_its_operators():
    n, ops, pipeline = _run("sys.modules['panelcast.llm'] = None")
    assert (ops, pipeline) == ("0", "False") and int(n) > 60
    assert _run("sys.modules['corpus_pipeline'] = None") == [n, "0", "False"]
    assert _run("sys.modules['xxhash'] = None")[0] >= n
