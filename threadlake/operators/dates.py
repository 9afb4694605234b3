"""Dates that a text mentions, in English and Spanish, resolved against the day on which it was written.

One pattern finds the forms: 2026-09-24, 9/24/2026 (the day first where the first number is no month), 9/24, September 24th 2026, 24 de septiembre de
2026, today and tomorrow, weekdays. A day without a year is in the year that brings it nearest, days that are past counting three times as far. A weekday is the first
one behind the day of writing, ``next`` moves it into the week behind; its short forms count behind a cue only. A weekday in front of a written day belongs to it. A time of
day right behind a date is kept as text. Days that do not exist are no mentions, and a null or empty text or an unknown day of writing has none.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, IntegerType, StringType, StructField, StructType

#: Months and weekdays in Spanish, from January and from Monday on.
MESES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
DIAS = "lunes martes miércoles jueves viernes sábado domingo".split()
MONTHS = {n: i for i in range(1, 13) for n in (calendar.month_name[i].lower(), calendar.month_abbr[i].lower(), MESES[i - 1])} | {"sept": 9, "setiembre": 9}
LONG_DAYS = {n: i for i in range(7) for n in (calendar.day_name[i].lower(), DIAS[i])} | {"miercoles": 2, "sabado": 5, "tues": 1, "thur": 3, "thurs": 3}
SHORT_DAYS = {calendar.day_abbr[i].lower(): i for i in range(7)}
#: Days counted from the day of writing.
RELATIVE = {"today": 0, "tonight": 0, "hoy": 0, "tomorrow": 1, "mañana": 1}
CUES = "on|this|next|by|until|el|este|próximo|proximo"
NEXT = ("next", "próximo", "proximo")


def _any(words) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_DAY = r"(?:0?[1-9]|[12][0-9]|3[01])"
_NTH = rf"(?P<{{}}>{_DAY})(?:st|nd|rd|th|º|\.)?"
_YEAR = r"(?P<{}>(?:19|20)[0-9]{{2}})"
_FORMS = re.compile(
    rf"""(?<![\w./-])(?:
      (?P<iso>(?:19|20)[0-9]{{2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}})(?![\w/-])
    | (?P<slash>[0-9]{{1,2}}/[0-9]{{1,2}}(?:/(?:(?:19|20)[0-9]{{2}}|[0-9]{{2}}))?)(?![\w/-])
    | (?:(?:(?:{CUES})\s+)?(?:{_any([*LONG_DAYS, *SHORT_DAYS])})\.?,?\s+)?(?:
          (?P<month>{_any(MONTHS)})\.?\s+{_NTH.format("d1")}(?![\w:/-])(?:,?\s+{_YEAR.format("y1")}(?!\w))?
        | {_NTH.format("d2")}\s+(?:(?:of|de)\s+)?(?P<month2>{_any(MONTHS)})(?!\w)\.?(?:,?\s+(?:de\s+)?{_YEAR.format("y2")}(?!\w))?)
    | (?P<relative>{_any(RELATIVE)})(?!\w)
    | (?:(?P<cue>{CUES})\s+)?(?P<weekday>{_any([*LONG_DAYS, *SHORT_DAYS])})(?!\w)
    )""",
    re.I | re.X,
)
_CLOCK = re.compile(r"\s*,?\s*(?:(?:at|around|by|from|@)\s+|(?:a|sobre|hacia)\s+las?\s+)?((?:[01]?[0-9]|2[0-3])(?::[0-5][0-9]\s?(?:[ap]m\b)?|\s?[ap]m\b))", re.I)
MENTIONS = ArrayType(StructType([StructField("day", DateType()), StructField("clock", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("explicit", BooleanType())]))


def _date(y: int, m: int, d: int) -> dt.date | None:
    try:
        return dt.date(y, m, d)
    except ValueError:
        return None


def nearest(month: int, day: int, written: dt.date) -> dt.date | None:
    """That day in the year before, of or behind the day of writing: the nearest, what is past counting three times."""
    found = [x for y in (written.year - 1, written.year, written.year + 1) if (x := _date(y, month, day))]
    return min(found, key=lambda x: (x - written).days if x >= written else 3 * (written - x).days, default=None)


def resolve(m: re.Match, written: dt.date) -> tuple[dt.date | None, bool]:
    """The day of a mention, and whether it was written out."""
    if m["iso"]:
        return _date(*map(int, re.split(r"[-/.]", m["iso"]))), True
    if m["slash"]:
        a, b, *year = map(int, m["slash"].split("/"))
        if not year:
            return nearest(a, b, written), True
        a, b = (b, a) if a > 12 >= b else (a, b)
        return _date(year[0] + 2000 * (year[0] < 100), a, b), True
    if m["month"] or m["month2"]:
        month, day, year = MONTHS[(m["month"] or m["month2"]).lower()], int(m["d1"] or m["d2"]), m["y1"] or m["y2"]
        return (_date(int(year), month, day) if year else nearest(month, day, written)), True
    if m["relative"]:
        return written + dt.timedelta(days=RELATIVE[m["relative"].lower()]), False
    name, cue = m["weekday"].lower(), (m["cue"] or "").lower()
    if name not in LONG_DAYS and not cue:
        return None, False
    day = LONG_DAYS.get(name, SHORT_DAYS.get(name))
    ahead = 7 - written.weekday() + day if cue in NEXT else (day - written.weekday() - 1) % 7 + 1
    return written + dt.timedelta(days=ahead), False


def mentions_of(text: str | None, written: dt.date | None) -> list[tuple[dt.date, str | None, int, int, bool]]:
    if not text or written is None:
        return []
    out = []
    for m in _FORMS.finditer(text):
        day, explicit = resolve(m, written)
        if day is not None:
            clock = _CLOCK.match(text, m.end())
            out.append((day, clock[1] if clock else None, m.start(), m.end(), explicit))
    return out


@F.pandas_udf(MENTIONS)
def _mentions(texts: pd.Series, written: pd.Series) -> pd.Series:
    names = ("day", "clock", "start", "end", "explicit")
    return pd.Series([[dict(zip(names, x, strict=True)) for x in mentions_of(t, None if pd.isna(w) else w)] for t, w in zip(texts, written, strict=True)], dtype=object)


def mentions(text: Column, written: Column) -> Column:
    """(day, clock, start, end, explicit) of every date in a text that was written on a day."""
    return _mentions(text, written.cast("date"))


def when_is(hits: DataFrame, ident: str, text: str, written: str, words: list[str], today: Column, k: int = 5) -> DataFrame:
    """(day, clock, ident, score): the k likeliest answers to "when is ...", of hits with a score.

    A mention counts the more the nearer it is to one of the words in its text (their distance in characters, 40 of them halve it), the better its message
    matched, and if the day is still to come. A day is answered once, from its best mention.
    """
    low = F.lower(F.col(text))
    rows = hits.withColumn("__m", F.explode(mentions(F.col(text), F.col(written))))
    off = F.least(*[F.when(F.instr(low, w) > 0, F.abs(F.instr(low, w) - 1 - F.col("__m.start"))) for w in words], F.lit(1_000_000))
    fit = F.col("score") * F.when(F.col("__m.day") >= today, 1.0).otherwise(0.5) * F.when(F.col("__m.explicit"), 1.0).otherwise(0.9) / (1 + off / 40)
    each = rows.select(F.col("__m.day").alias("day"), F.col("__m.clock").alias("clock"), ident, F.round(fit, 6).alias("score"))
    best = each.groupBy("day").agg(F.max_by(F.struct("clock", ident, "score"), F.struct("score", ident)).alias("b"))
    return best.select("day", "b.clock", F.col(f"b.{ident}").alias(ident), "b.score").orderBy(F.desc("score"), "day").limit(k)
