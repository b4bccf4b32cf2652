import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lawmill.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    return lambda df, *cols: sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
