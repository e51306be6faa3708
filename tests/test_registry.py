"""The registry holds every query, whichever catalog module a process imports first."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
MODULES = sorted(p.stem for p in (ROOT / "croupier").glob("catalog_*.py"))


def _names(first: str) -> list[str]:
    code = f"{first}\nimport __spark_entry__ as e\nprint(*sorted(e.queries()))"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout.split()


@pytest.fixture(scope="module")
def full() -> list[str]:
    return _names("")


@pytest.mark.parametrize("module", MODULES)
def test_any_catalog_module_may_be_imported_first(module, full):
    names = _names(f"import croupier.{module}")
    assert names == full and len(names) >= 250
