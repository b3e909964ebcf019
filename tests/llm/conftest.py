import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session", autouse=True)
def checkpoint_dir(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
