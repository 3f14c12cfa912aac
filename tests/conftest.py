import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent), str(HERE)]

from helpers import envelope  # noqa: E402

from paywright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "paywright-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    """Raw log (off, value) from payload texts, offsets in list order."""

    def build(payloads):
        rows = [(i, envelope(p)) for i, p in enumerate(payloads)]
        return spark.createDataFrame(rows, "off bigint, value string")

    return build


@pytest.fixture
def make_events(make_log):
    from paywright.sources.event_log import events_of

    return lambda payloads: events_of(make_log(payloads))
