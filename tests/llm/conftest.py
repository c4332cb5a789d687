import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))

import fixture


@pytest.fixture(scope="session")
def dirty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dirty"))
    fixture.dirty(spark, folder)
    return folder


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    fixture.empty(spark, folder)
    return folder
