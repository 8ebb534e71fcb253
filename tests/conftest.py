import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DAY0 = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture
def drives(spark):
    """Frames from {serial: [(day number, failure, value), ...]}."""
    def make(spec, value="smart_5_raw"):
        rows = [(s, day(d), "ST1", 10, f, None if v is None else float(v)) for s, days in spec.items() for d, f, v in days]
        return spark.createDataFrame(rows, f"serial_number string, date date, model string, capacity_bytes long, failure int, {value} double")
    return make
