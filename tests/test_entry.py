import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert [r["owned"] for r in entry.entry(spark).orderBy("label").collect()] and entry.entry(spark).columns == ["label", "owned"]


@pytest.mark.parametrize("gone", [("orrery/llm", "tests/llm"), ("orrery/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_training_data_part(tmp_path, gone):
    here = pathlib.Path(entry.__file__).parent
    tree = shutil.copytree(here, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    for name in gone:
        shutil.rmtree(tree / name) if (tree / name).is_dir() else (tree / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; names = e.queries(); assert set(e.oracle_sql()) <= set(names); print(*names)"
    names = subprocess.run([sys.executable, "-c", code], cwd=tree, env={"PYTHONPATH": "", "PATH": ""}, capture_output=True, text=True, check=True).stdout.split()
    assert "owned_cells" in names and "pipeline" not in names and any(n.startswith("op1_") for n in names) == ("orrery/llm" not in gone and (here / "orrery/llm").is_dir())
