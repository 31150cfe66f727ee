"""Dates as providers write them."""

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from worldstate.functions import dates

NOW = datetime(2026, 9, 28, 12, tzinfo=UTC)
day = lambda *a: datetime(*a, tzinfo=UTC)
CASES = {
    "3 hours ago": NOW - timedelta(hours=3), "2 days ago": NOW - timedelta(days=2), "1 day ago": NOW - timedelta(days=1), "an hour ago": NOW - timedelta(hours=1), "45 mins ago": NOW - timedelta(minutes=45), "2 weeks ago": NOW - timedelta(weeks=2),
    "1 mo ago": NOW - timedelta(days=30), "one year ago": NOW - timedelta(days=365), "30s ago": NOW - timedelta(seconds=30), "3 parsecs ago": None, "yesterday": NOW - timedelta(days=1), " Just now ": NOW, "today": NOW,
    "Sep 21, 2026": day(2026, 9, 21), "21 September 2026": day(2026, 9, 21), "21st of Sept. 2026": day(2026, 9, 21), "September 1st, 2026": day(2026, 9, 1), "21-Sep-2026": day(2026, 9, 21), "2026-09-21": day(2026, 9, 21), "2026/9/1": day(2026, 9, 1),
    "2026-09-21T10:15:00+05:30": day(2026, 9, 21, 4, 45), "2026-09-21 10:15": day(2026, 9, 21, 10, 15), "2026-09-21T10:15:00.25Z": day(2026, 9, 21, 10, 15, 0, 250000), "2026-09-21t10:15:00-0330": day(2026, 9, 21, 13, 45),
    "Sun, 21 Sep 2026 10:15:00 GMT": day(2026, 9, 21, 10, 15), "Mon, 21 Sep 2026 10:15:00 +0530": day(2026, 9, 21, 4, 45), "Sep 21, 2026 3:05 PM": day(2026, 9, 21, 15, 5), "Sep 21, 2026 at 12:05 am": day(2026, 9, 21, 0, 5),
    "09/21/2026": day(2026, 9, 21), "21/09/2026": day(2026, 9, 21), "21.09.2026": day(2026, 9, 21), "Sep 20": day(2026, 9, 20), "30 Dec": day(2025, 12, 30), "Sep 29": day(2026, 9, 29), "Sep 30": day(2025, 9, 30),
    None: None, "": None, "  ": None, "whenever": None, "N/A": None, "Monday": None, "Dec 31, 2030": None, "2026-02-30": None, "2026-13-01": None, "2026-09-21T25:00": None, "32 Sep 2026": None, "12345": None, "Feb 29": None, "99999999999 days ago": None,
}


def test_cases(spark):
    now = int(NOW.timestamp()) * 1_000_000
    df = spark.createDataFrame([(k, s) for k, s in enumerate(CASES)], "k int, s string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            got = {r.s: r.at for r in df.select("s", dates.published(F.col("s"), F.lit(now)).alias("at")).collect()}
            assert got == {s: t and int(t.timestamp()) * 1_000_000 + t.microsecond for s, t in CASES.items()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_years_left_out_and_loose_dates(spark):
    row = spark.sql("SELECT 'Dec 30' AS s, '2031-01-01' AS t, 'Dec 30' AS u")
    early = int(day(2027, 1, 5).timestamp()) * 1_000_000
    got = row.select(dates.published(F.col("s"), F.lit(early)), dates.loose(F.col("t")), dates.loose(F.col("u"))).first()
    assert tuple(got) == (int(day(2026, 12, 30).timestamp()) * 1_000_000, int(day(2031, 1, 1).timestamp()) * 1_000_000, None)
