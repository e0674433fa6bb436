from __future__ import annotations

import subprocess
import sys
from pathlib import Path


def test_the_entry_is_imported_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
