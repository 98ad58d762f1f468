import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyfold.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="tallyfold-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from tallyfold.session import scratch_path

    return lambda name: scratch_path(spark, name)


UPDATE_DDL = "seq BIGINT, id STRING, type STRING, delta BIGINT, value DOUBLE"


def shortest_plain(v):
    """Shortest round-trip digits of a finite double, written without exponent."""
    from decimal import Decimal

    out = format(Decimal(repr(v)), "f")
    return out.rstrip("0").rstrip(".") if "." in out else out


def rows(df, *cols):
    """Rows as sorted tuples (order-insensitive compare)."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
