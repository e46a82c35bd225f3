"""The entry file imports, with the corpus operators and in a copy without them."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
TELL = "import __spark_entry__ as e; print(*sorted(set(e.queries())), sep='\\n')"


def _copy(to: Path, *left_out: str) -> list[str]:
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out))
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", TELL], cwd=to, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_import_without_corpus_operators(tmp_path, left_out):
    assert _copy(tmp_path / "copy", *left_out) == sorted(entry.QUERIES)


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.LLM_QUERIES).isdisjoint(entry.QUERIES)
