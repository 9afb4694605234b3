"""Dates in words, and answers to "when is"."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadlake.operators import dates as D

WRITTEN = dt.date(2026, 9, 16)  # a Wednesday


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("on 2026-09-24 and 2026/2/30", ["2026-09-24"]),
        ("9/24/2026, 24/09/26 or 1/5", ["2026-09-24", "2026-09-24", "2027-01-05"]),
        ("Sep 24th, 2027; sept. 3", ["2027-09-24", "2026-09-03"]),
        ("24 September or the 1st of Oct 2025", ["2026-09-24", "2025-10-01"]),
        ("el 15 de octubre de 2026, 3 de enero", ["2026-10-15", "2027-01-03"]),
        ("Thursday, September 24", ["2026-09-24"]),
        ("viernes 9 de octubre", ["2026-10-09"]),
        ("on Sunday, July 27, 1997", ["1997-07-27"]),
        ("today, tomorrow and hoy", ["2026-09-16", "2026-09-17", "2026-09-16"]),
        ("Wednesday; on Fri; next Monday; este lunes", ["2026-09-23", "2026-09-18", "2026-09-21", "2026-09-21"]),
        ("sat down in the sun, may I? version 1.2.3, 10/20/30/40", []),
        ("Feb 30 2026", []),
        ("", []),
        (None, []),
    ],
)
def test_mentions(text, want):
    assert [m[0].isoformat() for m in D.mentions_of(text, WRITTEN)] == want


def test_clock_and_place():
    text = "Dinner Friday at 7:30 pm, call 24 October a las 21:00, then May 3 at noon"
    got = D.mentions_of(text, WRITTEN)
    assert [(m[1], text[m[2] : m[3]], m[4]) for m in got] == [("7:30 pm", "Friday", False), ("21:00", "24 October", True), (None, "May 3", True)]
    assert D.mentions_of("today", None) == []


def test_every_day_of_some_years_is_found():
    day = dt.date(2024, 1, 1)
    while day < dt.date(2027, 1, 1):
        for text in (f"{day:%B} {day.day}, {day.year}", f"{day.day} de {D.MESES[day.month - 1]} de {day.year}", f"{day:%A} {day.day} {day:%b} {day.year}", f"{day.month}/{day.day}/{day:%y}"):
            assert [m[0] for m in D.mentions_of(f"see {text}.", WRITTEN)] == [day], text
        day += dt.timedelta(days=1)


def test_when_is(spark):
    rows = [(1, 2.0, "The recital is on 3 October at 18:00. Rent is due 1 October.", WRITTEN), (2, 1.0, "recital tomorrow?", dt.date(2026, 9, 1)), (3, 9.0, None, WRITTEN), (4, 9.0, "recital soon", WRITTEN), (5, 0.5, "recital 3 October", None)]
    df = spark.createDataFrame(rows, "id long, score double, text string, written date")
    got = [(r["day"].isoformat(), r["clock"], r["id"]) for r in D.when_is(df, "id", "text", "written", ["recital"], F.lit("2026-09-16").cast("date")).collect()]
    assert got[0] == ("2026-10-03", "18:00", 1) and {g[0] for g in got} == {"2026-10-03", "2026-10-01", "2026-09-02"}
