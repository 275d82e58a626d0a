"""The entry module can be imported before there is a session."""

import subprocess
import sys
from pathlib import Path


def test_import_without_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert int(done.stdout) >= 30
