"""The driver contract holds with and without the subpackage llm."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

#: Imports the entry as if the subpackage and the pipeline were not there.
WITHOUT = """
import sys
sys.modules["stormglass.llm"] = sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
names = set(e.queries())
assert len(names) >= 49 and not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["provider", "severity_normalized", "phase", "n"] and df.count() > 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "stormglass").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path
