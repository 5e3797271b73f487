import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_subpackage(tmp_path):
    for p in ("kithara", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "kithara" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'enrichment_summary' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    own = "kithara." + "llm"
    for p in (ROOT / "kithara").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert own not in p.read_text(), p
