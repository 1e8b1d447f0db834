import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftlog.session import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def approx(a, b, tol=1e-9):
    return abs(a - b) <= tol


EVENT = "session_id string, line_no bigint, ts timestamp, cluster_id int, parameters array<string>"


@pytest.fixture(scope="session")
def make_events(spark):
    """events from {session: [cluster ids]} with a second between lines, or explicit times."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)

    def make(sessions, times=None, params=None):
        rows, line = [], 0
        for sid, ids in sessions.items():
            for i, c in enumerate(ids):
                t = times[sid][i] if times and sid in times else i
                ts = None if t is None else start + dt.timedelta(seconds=t)
                p = params[sid][i] if params and sid in params else []
                rows.append((sid, line, ts, c, p))
                line += 1
        return spark.createDataFrame(rows, EVENT)

    return make
