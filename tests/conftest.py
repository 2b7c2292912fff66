import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from keytally.session import build_session

    session = build_session("local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def make_stream(spark):
    """A stream from a list of keys or of (key, weight) pairs, over several partitions."""

    def make(rows, kind="long", partitions=3):
        pairs = [r if isinstance(r, tuple) else (r, 1) for r in rows]
        df = spark.createDataFrame(pairs, f"key {kind}, weight long")
        return df.repartition(partitions) if partitions else df

    return make
