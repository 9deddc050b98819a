import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from forescale.session import configure, small_table  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Small typed table from tuples; naive datetimes are UTC."""

    def build(rows, schema):
        utc = [tuple(v.replace(tzinfo=timezone.utc) if isinstance(v, datetime) and v.tzinfo is None else v for v in row) for row in rows]
        return small_table(spark, utc, schema)

    return build


@pytest.fixture(scope="session")
def folder():
    return FOLDER
