"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "cooccur_type" in entry.queries()


def test_entry_without_the_subpackage(tmp_path):
    (tmp_path / "tesserae").mkdir()
    for x in (ROOT / "tesserae").iterdir():
        if x.name not in ("llm", "__pycache__"):
            (tmp_path / "tesserae" / x.name).symlink_to(x)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pagerank' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=60)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "tesserae").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
