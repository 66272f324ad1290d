"""The library works without its optional parts."""

import shutil
import subprocess
import sys

from conftest import ROOT


def test_entry_without_the_optional_parts(tmp_path):
    """A copy without training-data operators, their tests and the pipeline still registers all other queries."""
    parts = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.json", "spark-warehouse")
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("foldsafe", "tests"):
        shutil.copytree(ROOT / name, copy / name, ignore=parts)
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, copy / name)
    code = (
        "import __spark_entry__ as e, foldsafe.plans as p; "
        "assert set(e.queries()) == set(p.REGISTRY) and set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 90
    # The pipeline without its operators is left out too, and its own import error is not swallowed.
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", copy / "corpus_pipeline.py")
        assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True).returncode == 0
        alone = subprocess.run([sys.executable, "-c", "import corpus_pipeline"], cwd=copy, capture_output=True, text=True)
        assert alone.returncode != 0 and "foldsafe.llm" in alone.stderr
