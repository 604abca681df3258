"""The entry module with and without the optional training-data files."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); e.oracle_sql()"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": root}, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return set(out.stdout.split("NAMES ")[1].split())


def test_entry_works_without_the_optional_files(tmp_path):
    from logvigil.plans.catalog import QUERIES
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    assert names(str(tmp_path / "repo")) == set(QUERIES)


def test_errors_inside_optional_files_are_raised(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    pkg = tmp_path / "repo" / "logvigil" / "llm"
    pkg.mkdir()
    (pkg / "__init__.py").write_text("")
    (pkg / "queries.py").write_text("import a_module_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo",
                         capture_output=True, text=True, timeout=120)
    assert out.returncode and "a_module_that_is_not_there" in out.stderr
