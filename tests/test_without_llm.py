"""The entry module and the core stand without the llm subpackage and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "quillspark", tmp_path / "quillspark", ignore=lambda d, names: ["llm", "__pycache__"])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 60


def test_nothing_imports_the_subpackage():
    for path in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
