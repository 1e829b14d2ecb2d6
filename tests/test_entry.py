"""The entry works without the optional subpackage, with and without the pipeline file beside it."""

import json
import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("emptied", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline, emptied):
    tree = tmp_path / "tree"
    tree.mkdir()
    shutil.copy(f"{HERE}/__spark_entry__.py", tree)
    shutil.copytree(f"{HERE}/tablelens", tree / "tablelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if pipeline:
        (tree / "corpus_pipeline.py").write_text("from tablelens.llm import queries\nQUERIES, ORACLE = {'pipeline': None}, {}\n")
    if emptied:
        (tree / "tablelens" / "llm").mkdir()
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=tree, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    names, with_sql = json.loads(out.stdout)
    assert "lineitem_profile" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]
    assert set(with_sql) <= set(names)
