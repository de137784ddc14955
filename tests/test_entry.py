"""The registered queries of the engine, whatever else can be imported."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[1])


@pytest.mark.parametrize("missing", ["tarnflow.llm", "corpus_pipeline", "zstandard", "xxhash", "tokenizers"])
def test_core_queries_do_without(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; from tarnflow.plans import catalog; assert set(catalog.QUERIES) <= set(e.queries()); assert set(catalog.ORACLES) <= set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=REPO, env=os.environ | {"PYTHONPATH": REPO})
