"""The driver's entry points, with and without the llm package."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        d = entry.entry(spark)
        assert d.count() > 0 and "severity" in d.columns
    else:
        pytest.skip("no test tables here")


_REST = "import __spark_entry__ as e; q = e.queries(); assert 'dropout_context' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"


def _run(folder, *command):
    subprocess.run([sys.executable, *command], cwd=folder, check=True, capture_output=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.parametrize("caches", [False, True])
@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_works_without_the_llm_folders(tmp_path, caches, pipeline):
    """Both folders deleted: queries register, all other tests are collected, also where caches or the pipeline are left."""
    for name in ("tidemark", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    if caches:
        (tmp_path / "tidemark/llm/__pycache__").mkdir(parents=True)
    _run(tmp_path, "-c", _REST)
    _run(tmp_path, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")


def test_nothing_outside_imports_the_llm_package():
    for folder, _, names in os.walk(f"{ROOT}/tidemark"):
        if "llm" in os.path.relpath(folder, ROOT).split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, n), encoding="utf-8").read()
