import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from hirespan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("8", shuffle_partitions=8)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
