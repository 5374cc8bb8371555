"""Written dates and the session time zone."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabscope.functions.dates import parse_date

# written form -> its value
WRITTEN = {
    "2024-01-15": datetime(2024, 1, 15),
    "2024-1-5 7:08": datetime(2024, 1, 5, 7, 8),
    "2024-03-10 02:30:00": datetime(2024, 3, 10, 2, 30),
    "2024-03-10T10:00:00Z": datetime(2024, 3, 10, 10),
    "2024-03-10T10:00:00+0200": datetime(2024, 3, 10, 8),
    "2024-03-10 10:00:00.25 -05:00": datetime(2024, 3, 10, 15, 0, 0, 250000),
    "3/10/2024 2:30": datetime(2024, 3, 10, 2, 30),
    "1/2/2024 3:04 PM": datetime(2024, 1, 2, 15, 4),
    "1/2/2024 12:04:05 am": datetime(2024, 1, 2, 0, 4, 5),
    "2024-01-15 10:30:00 AM": datetime(2024, 1, 15, 10, 30),
    "15.01.2024": datetime(2024, 1, 15),
    "15.01.2024 09:10": datetime(2024, 1, 15, 9, 10),
    "01/02/24": datetime(2024, 1, 2),
    "01/02/99": datetime(1999, 1, 2),
    "1/2/68 3:04": datetime(2068, 1, 2, 3, 4),
    "Jan 2024": datetime(2024, 1, 1),
    "January 2024": datetime(2024, 1, 1),
    "15 Jan 2024 10:00": datetime(2024, 1, 15, 10),
    "Mon, 15 Jan 2024 10:00:00": datetime(2024, 1, 15, 10),
    "Monday 15 Jan 2024": datetime(2024, 1, 15),
    "20240115": datetime(2024, 1, 15),
    "10:30": None,
    "Mon": None,
    "2024-13-45": None,
    "31/31/2024": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_written_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.createDataFrame([(t,) for t in WRITTEN], "written string")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        found = {r["written"]: r["value"] for r in rows.select("written", parse_date(F.col("written")).alias("value")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == WRITTEN
