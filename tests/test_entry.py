"""The entry module in a checkout without the text subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
PROBE = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(sum(n.startswith('op') or n == 'pipeline' for n in q), 'exact_duplicates' in q)"


def _copy(tmp_path, leave_out=()):
    where = tmp_path / "copy"
    where.mkdir()
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in leave_out and (REPO / name).exists():
            shutil.copy(REPO / name, where)
    shutil.copytree(REPO / "shelfsift", where / "shelfsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    return where


@pytest.mark.parametrize("leave_out", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_text_subpackage(tmp_path, leave_out):
    where = _copy(tmp_path, leave_out)
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=where, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(where)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert run.stdout.split() == ["0", "True"]


def test_a_folder_of_caches_is_not_the_subpackage(tmp_path):
    where = _copy(tmp_path)
    (where / "shelfsift" / "llm" / "__pycache__").mkdir(parents=True)
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=where, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(where)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert run.stdout.split() == ["0", "True"]
