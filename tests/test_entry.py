"""The entry gives the rest of the queries where the optional subpackage, or what it needs, can't be imported."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_what_the_subpackage_needs():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') and n[2].isdigit() for n in q), len(q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-500:]
