import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from logsift.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Collect a DataFrame as a list of tuples."""
    return lambda df: [tuple(r) for r in df.collect()]


def events_frame(spark, data):
    """Unified events from ``(time text, ip, type, status, message, process, destination)`` tuples, cut short at will."""
    padded = [tuple(list(r) + [None] * (7 - len(r))) for r in data]
    schema = (
        "event_timestamp string, source_ip string, event_type string, status_code int, raw_message string, "
        "process_name string, destination_ip string"
    )
    df = spark.createDataFrame(padded, schema)
    return df.withColumn("event_timestamp", df["event_timestamp"].cast("timestamp_ntz"))
