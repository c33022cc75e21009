"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 140 and all(isinstance(s, str) for s in e.oracle_sql().values())


def test_library_imports_without_a_session():
    modules = [str(p.relative_to(ROOT)).removesuffix(".py").replace("/", ".").removesuffix(".__init__") for p in (ROOT / "spectroloom").rglob("*.py") if "llm" not in p.parts and p.name != "__main__.py"]
    code = f"import importlib, sys; sys.path.insert(0, {str(ROOT)!r}); [importlib.import_module(m) for m in {modules!r}]; assert not any('.llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_nothing_outside_names_the_corpus_package():
    for p in (ROOT / "spectroloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "spectroloom.llm" not in p.read_text(), p
