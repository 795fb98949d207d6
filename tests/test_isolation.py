"""The library without the corpus subpackage: it imports, and nothing else refers to it."""

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'link_production' in q and not any(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    done = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0 and "error" not in done.stdout.lower(), done.stdout


def test_a_broken_subpackage_is_seen(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", "tests"))
    (copy / "tallyweave" / "llm").mkdir()
    (copy / "tallyweave" / "llm" / "__init__.py").write_text("import nothing_of_that_name\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True)
    assert done.returncode != 0 and "nothing_of_that_name" in done.stderr


def test_nothing_else_imports_the_subpackage():
    files = [f for f in (ROOT / "tallyweave").rglob("*.py") if "llm" not in f.parts] + list((ROOT / "tests").glob("*.py"))
    assert files and not [f for f in files if re.search(r"^\s*(from|import) .*llm", f.read_text(), re.M)]
