import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import local

    return local("4", 8, "4g")


@pytest.fixture(scope="session")
def sf_dir():
    found = DATA / "sf0.001"
    if not found.exists():
        pytest.skip("no test tables")
    return str(found)
