"""Calendar events that repeat: recurrence rules expanded to their dates, exceptions left out, local times in their zone as UTC.

A rule is the text behind ``RRULE:``. Its parts FREQ (DAILY, WEEKLY, MONTHLY, YEARLY), INTERVAL, COUNT, UNTIL, BYDAY (with places such as 2TU or -1FR where
the period is a month or year), BYMONTHDAY (from the end, too) and BYMONTH are SQL expressions over the days from the start on; there is no Python in it. The
start's own time of day is that of every date, in its own zone, so an event keeps its hour when clocks change.

What a rule does not fix is taken from the start: weekday, day of month, month. A rule without COUNT and UNTIL goes on to the end asked for. No rule: the event
happens once. A null start, an unknown frequency or a broken number gives no dates; an unknown zone is an error of Spark's. Parts that are not listed above (BYSETPOS,
BYHOUR and so on) are not supported: such a rule gives no dates rather than wrong ones. Exceptions do not make up for COUNT. UNTIL names a second, and
all of that second is within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weekdays as rules write them, Monday first.
DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
PARTS = ("FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "BYMONTHDAY", "BYMONTH", "WKST")


def rule_of(text: Column) -> Column:
    """A rule's parts: freq, every, count, until, days (place and weekday from 1; place 0: any), monthdays, months, known."""
    parts = F.str_to_map(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*RRULE:|\s", "")), F.lit(";"), F.lit("="))
    part = lambda name: F.try_element_at(parts, F.lit(name))
    numbers = lambda name: F.transform(F.split(part(name), ","), lambda x: x.try_cast("int"))
    until = F.coalesce(F.try_to_timestamp(F.substring(part("UNTIL"), 1, 15), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(part("UNTIL"), F.lit("yyyyMMdd")) + F.expr("INTERVAL '86399' SECOND"))
    names = F.array(*[F.lit(d) for d in DAYS])
    days = F.transform(
        F.split(part("BYDAY"), ","),
        lambda d: F.struct(F.coalesce(F.regexp_extract(d, r"^([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0)).alias("place"), F.array_position(names, F.right(d, F.lit(2))).cast("int").alias("day")),
    )
    known = F.forall(F.map_keys(parts), lambda k: k.isin(*PARTS)) & part("FREQ").isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY") & (part("UNTIL").isNull() | until.isNotNull()) & (part("COUNT").isNull() | part("COUNT").try_cast("int").isNotNull())
    return F.struct(
        part("FREQ").alias("freq"),
        F.coalesce(part("INTERVAL").try_cast("int"), F.lit(1)).alias("every"),
        part("COUNT").try_cast("int").alias("count"),
        until.alias("until"),
        days.alias("days"),
        numbers("BYMONTHDAY").alias("monthdays"),
        numbers("BYMONTH").alias("months"),
        F.coalesce(known, F.lit(False)).alias("known"),
    )


def happens(day: Column, start: Column, rule: Column) -> Column:
    """Whether a rule holds on a day, which is not before the start's."""
    freq, every = rule["freq"], rule["every"]
    weekday, monthday, last = F.weekday(day) + 1, F.dayofmonth(day), F.dayofmonth(F.last_day(day))
    months = (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)
    week = lambda d: F.date_sub(d, F.weekday(d))
    in_step = (
        F.when(freq == "DAILY", F.datediff(day, start) % every == 0)
        .when(freq == "WEEKLY", (F.datediff(week(day), week(start)) / 7).cast("int") % every == 0)
        .when(freq == "MONTHLY", months % every == 0)
        .otherwise((F.year(day) - F.year(start)) % every == 0)
    )
    # places of a weekday from either end, in the month or, without months given, in the year
    by_year = (freq == "YEARLY") & rule["months"].isNull()
    nth = F.when(by_year, F.floor((F.dayofyear(day) - 1) / 7) + 1).otherwise(F.floor((monthday - 1) / 7) + 1).cast("int")
    year_days = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    nth_last = F.when(by_year, -F.floor((year_days - F.dayofyear(day)) / 7) - 1).otherwise(-F.floor((last - monthday) / 7) - 1).cast("int")
    placed = freq.isin("MONTHLY", "YEARLY")
    on_day = F.exists(rule["days"], lambda d: (d["day"] == weekday) & ((d["place"] == 0) | ~placed | (d["place"] == nth) | (d["place"] == nth_last)))
    on_monthday = F.exists(rule["monthdays"], lambda m: (m == monthday) | (m == monthday - last - 1))
    in_month = F.coalesce(F.exists(rule["months"], lambda m: m == F.month(day)), F.lit(True))
    free = rule["days"].isNull() & rule["monthdays"].isNull()
    given = (
        F.when(~free, F.coalesce(on_day, F.lit(True)) & F.coalesce(on_monthday, F.lit(True)))
        .when(freq == "DAILY", F.lit(True))
        .when(freq == "WEEKLY", weekday == F.weekday(start) + 1)
        .otherwise(monthday == F.dayofmonth(start))
    )
    own_month = ~(free & (freq == "YEARLY") & rule["months"].isNull()) | (F.month(day) == F.month(start))
    return in_step & in_month & given & own_month


def occurrences(events: DataFrame, start: str, rule: str, end: Column, exceptions: str | None = None, out: str = "occurs") -> DataFrame:
    """A row for each date of each event before ``end`` (a local timestamp); ``start`` is local, too, ``exceptions`` an array of local timestamps."""
    rows = events.withColumn("__rule", rule_of(F.col(rule))).withColumn("__none", F.trim(F.coalesce(F.col(rule), F.lit(""))) == "")
    at, r = F.col(start), F.col("__rule")
    first, stop = F.to_date(at), F.to_date(F.least(end, F.coalesce(r["until"], end)))
    days = F.when(r["known"] & (r["every"] > 0) & (stop >= first), F.sequence(first, stop, F.expr("INTERVAL 1 DAY")))
    hour = F.col("__rest")
    rows = rows.withColumn("__rest", F.unix_micros(at) - F.unix_micros(first.cast("timestamp")))
    fit = F.filter(days, lambda d: happens(d, first, r))
    times = F.filter(F.transform(fit, lambda d: F.timestamp_micros(F.unix_micros(d.cast("timestamp")) + hour)), lambda t: F.coalesce(F.date_trunc("second", t) <= r["until"], F.lit(True)))
    counted = F.when(r["count"].isNull(), times).when(r["count"] < 1, F.slice(times, 1, 0)).otherwise(F.slice(times, F.lit(1), F.greatest(r["count"], F.lit(1))))
    every = F.when(F.col("__none") & at.isNotNull(), F.array(at)).otherwise(counted)
    if exceptions:
        every = F.array_except(every, F.coalesce(F.col(exceptions), F.array().cast("array<timestamp>")))
    made = rows.withColumn(out, F.explode(F.filter(every, lambda t: t < end)))
    return made.drop("__rule", "__none", "__rest")


def to_utc(local: Column, zone: Column) -> Column:
    """A local time in its zone as UTC; without a zone it is UTC already."""
    return F.when(zone.isNull(), local).otherwise(F.to_utc_timestamp(local, zone))
