"""The entry module without the optional subpackage or a library that only it needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["shelfwatch.llm", "ahocorasick", "corpus_pipeline"])
def test_core_queries_without(missing):
    code = f"""
import sys, warnings
warnings.simplefilter("ignore")
sys.modules["{missing}"] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert "sales_trends" in names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
assert set(entry.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
