"""The entry points without the training-data folders, with emptied ones, and with broken ones."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def queries(folder):
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=folder, capture_output=True, text=True, timeout=120)
    return done.stdout.split(), done.stderr


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    return tmp_path


def test_without_the_folders(copy):
    shutil.rmtree(copy / "tessera/llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    bare = queries(copy)[0]
    assert int(bare[0]) > 70
    (copy / "tessera/llm/__pycache__").mkdir(parents=True)  # an emptied folder, with and without the pipeline
    assert queries(copy)[0] == bare
    (copy / "corpus_pipeline.py").write_text("from tessera.llm import mixing\n")
    assert queries(copy)[0] == bare


def test_other_errors_are_not_swallowed(copy):
    if not (copy / "tessera/llm/common.py").exists():
        pytest.skip("the folder is absent")
    with open(copy / "tessera/llm/common.py", "a") as f:
        f.write("\nimport nothing_here\n")
    out, err = queries(copy)
    assert out == [] and "nothing_here" in err
