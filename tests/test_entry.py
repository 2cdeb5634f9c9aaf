"""The entry file without the document operators."""

import os
import shutil
import subprocess
import sys

import pytest

from tabwright.plans import catalogue

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())), any(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("without", [["tabwright/llm", "tests/llm"], ["tabwright/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_alone(tmp_path, without):
    shutil.copytree(os.path.join(HERE, "tabwright"), tmp_path / "tabwright", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(os.path.join(HERE, name)):
            shutil.copy(os.path.join(HERE, name), tmp_path)
    assert not (tmp_path / "tabwright/llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert found.stdout.split() == [str(len(catalogue.QUERIES)), "0", "False"], found.stderr
