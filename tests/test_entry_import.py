"""The entry imports without a session."""

import os
import subprocess
import sys


def test_entry_needs_no_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
