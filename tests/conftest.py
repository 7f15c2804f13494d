import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from siltmark.session import build_session

    session = build_session(
        "siltmark-tests", "local[8]",
        spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def rows(df, *order):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t)) if not order else out


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]
