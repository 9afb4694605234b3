"""Recurrence rules against an expander that goes from day to day, and zones across clock changes."""

import datetime as dt
import zoneinfo

import pytest
from dateutil import rrule
from pyspark.sql import functions as F

from threadlake.operators import recurrence as R
from threadlake.sources import mail

START = dt.datetime(2026, 1, 31, 9, 30)
END = dt.datetime(2029, 6, 1)
RULES = [
    "FREQ=DAILY", "FREQ=DAILY;INTERVAL=10;COUNT=5", "FREQ=DAILY;BYMONTH=2,7;UNTIL=20270301T093000", "FREQ=DAILY;BYDAY=SA,SU;COUNT=9",
    "FREQ=WEEKLY", "RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,SA;COUNT=12", "FREQ=WEEKLY;BYDAY=TU;BYMONTH=3", "FREQ=WEEKLY;UNTIL=20260401",
    "FREQ=MONTHLY", "FREQ=MONTHLY;INTERVAL=5;BYMONTHDAY=-1,15", "FREQ=MONTHLY;BYDAY=2TU,-1FR;COUNT=20", "FREQ=MONTHLY;BYDAY=WE;BYMONTHDAY=1,2,3,4,5,6,7", "FREQ=MONTHLY;BYMONTH=2;BYMONTHDAY=29",
    "FREQ=YEARLY", "FREQ=YEARLY;INTERVAL=2;COUNT=2", "FREQ=YEARLY;BYMONTH=3,10;BYDAY=-1SU", "FREQ=YEARLY;BYDAY=1MO,-1FR", "FREQ=YEARLY;BYMONTH=6;BYMONTHDAY=24",
]


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame([(i, START, r, "clash") for i, r in enumerate(RULES)], "id int, start timestamp, rule string, day string")
    got = {}
    for r in R.occurrences(rows, "start", "rule", F.lit(END)).select("id", "occurs").collect():
        got.setdefault(r["id"], []).append(r["occurs"])
    return got


@pytest.mark.parametrize("i", range(len(RULES)))
def test_rules(made, i):
    text = RULES[i].removeprefix("RRULE:").replace("UNTIL=20260401", "UNTIL=20260401T235959")
    want = list(rrule.rrulestr(text, dtstart=START).between(START, END - dt.timedelta(seconds=1), inc=True))
    assert sorted(made.get(i, [])) == want


def test_exceptions_nulls_and_unknown_rules(spark):
    day = lambda n: START + dt.timedelta(days=n)
    rows = [
        (1, START, "FREQ=DAILY;COUNT=3", [day(1), day(9)]), (2, START, None, None), (3, START, "", [START]), (4, None, "FREQ=DAILY", None), (5, START, "FREQ=HOURLY", None),
        (6, START, "FREQ=DAILY;BYSETPOS=1", None), (7, START, "FREQ=DAILY;COUNT=x", None), (8, START, "FREQ=DAILY;INTERVAL=0", None), (9, dt.datetime(2040, 1, 1), "FREQ=DAILY", None), (10, START, "FREQ=DAILY;UNTIL=20200101", None), (1, START, "FREQ=DAILY;COUNT=1", None),
    ]
    df = spark.createDataFrame(rows, "id int, start timestamp, rule string, off array<timestamp>")
    got = sorted((r["id"], r["occurs"]) for r in R.occurrences(df, "start", "rule", F.lit(END), "off").collect())
    assert got == [(1, START), (1, START), (1, day(2)), (2, START)]
    assert R.occurrences(df.limit(0), "start", "rule", F.lit(END)).collect() == []


def test_hours_stay_across_clock_changes(spark):
    start = dt.datetime(2026, 3, 27, 9, 0)
    rows = spark.createDataFrame([(z, start, "FREQ=DAILY;COUNT=5") for z in ("Europe/Berlin", "America/New_York", None)], "zone string, start timestamp, rule string")
    got = R.occurrences(rows, "start", "rule", F.lit(END)).select("zone", "occurs", R.to_utc(F.col("occurs"), F.col("zone")).alias("utc")).collect()
    assert len(got) == 15
    for r in got:
        zone = zoneinfo.ZoneInfo(r["zone"]) if r["zone"] else dt.timezone.utc
        assert r["occurs"].hour == 9 and r["utc"] == r["occurs"].replace(tzinfo=zone).astimezone(dt.timezone.utc).replace(tzinfo=None)


def test_calendar_with_rules_zones_and_attendees(spark):
    ics = (
        "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u1\r\nSUMMARY:Stand-up\r\nDTSTART;TZID=\"Europe/Berlin\":20260327T090000\r\nDTEND;TZID=Europe/Berlin:20260327T091500\r\n"
        "RRULE:FREQ=DAILY;COUNT=4\r\nEXDATE;TZID=Europe/Berlin:20260328T090000,20260330T090\r\n 000\r\nATTENDEE;CN=\"A: B\";RSVP=TRUE:mailto:Ann@Example.org\r\nATTENDEE:MAILTO:bo@example.org\r\nEND:VEVENT\r\n"
        "BEGIN:VEVENT\r\nUID:u2\r\nDTSTART:20260101T100000Z\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:cut"
    )
    events = mail.calendar_events(spark.createDataFrame([(ics,), (None,), ("BEGIN:VEVENT" * 3000,)], "ics string"))
    rows = {r["uid"]: r for r in events.collect()}
    assert set(rows) == {"u1", "u2"} and rows["u1"]["attendees"] == ["ann@example.org", "bo@example.org"] and rows["u2"]["rule"] is None and rows["u2"]["zone"] is None
    got = R.occurrences(events, "start", "rule", F.lit(END), "exceptions").select("uid", R.to_utc(F.col("occurs"), F.col("zone")).alias("utc")).collect()
    assert sorted(map(tuple, got)) == [("u1", dt.datetime(2026, 3, 27, 8)), ("u1", dt.datetime(2026, 3, 29, 7)), ("u2", dt.datetime(2026, 1, 1, 10))]


def test_the_second_of_until_is_within_it(spark):
    rows = [(1, dt.datetime(2026, 1, 30, 23, 59, 59, 500000), "FREQ=DAILY;UNTIL=20260201T235959"), (2, dt.datetime(2026, 1, 30, 23, 59, 59, 999999), "FREQ=DAILY;UNTIL=20260201"), (3, dt.datetime(2026, 1, 30, 12, 0, 1), "FREQ=DAILY;UNTIL=20260201T120000")]
    df = spark.createDataFrame(rows, "id int, start timestamp, rule string")
    got = R.occurrences(df, "start", "rule", F.lit("2027-01-01").cast("timestamp")).groupBy("id").count()
    assert {r["id"]: r["count"] for r in got.collect()} == {1: 3, 2: 3, 3: 2}
