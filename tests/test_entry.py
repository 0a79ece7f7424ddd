"""The entry module, with and without the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__ as entry
from cuewright.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["query_id", "rank"] and df.count() > 0


def test_names():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES)


def test_without_the_optional_subpackage(tmp_path):
    """The module imports in a tree that lacks it."""
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "cuewright"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    (tmp_path / "cuewright").mkdir()
    for name in os.listdir(f"{ROOT}/cuewright"):
        if name != "llm":
            os.symlink(f"{ROOT}/cuewright/{name}", tmp_path / "cuewright" / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    (tmp_path / "run.py").write_text(code)
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[-2:] == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))]
