"""The driver contract also holds where the training-data subpackage and the pipeline are not there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
SHOW = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sum(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in q), len(q))"


@pytest.mark.parametrize("without", [("almoner/llm",), ("almoner/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *[w.rsplit("/", 1)[-1] for w in without]))
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    numbered, all_queries = map(int, done.stdout.split())
    assert numbered == 0 and all_queries > 80
