import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import compare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = compare.session(4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    from sightline.plans import ship_package
    from sightline.streaming.ordered import use_rocksdb

    ship_package(session)
    use_rocksdb(session)
    yield session
    session.stop()
