import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_corpus_folders(tmp_path):
    for name in ("pointweave", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "pointweave" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'dsm' in q and 'pipeline' not in q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["row", "col", "z"] and out.count() == 4067
