"""People: who wrote, to whom, first, last and how often."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(messages: DataFrame, person: str, seq: str, at: str, name: str, sent: Column) -> DataFrame:
    """Messages from and to each person, the newest name, the last time."""
    return messages.groupBy(person).agg(
        F.count_if(~sent).alias("received"), F.count_if(sent).alias("sent"), F.max_by(name, F.struct(at, seq)).alias("newest"), F.max(at).alias("last_at")
    )


def first_contacts(messages: DataFrame, person: str, seq: str, direction: Column) -> DataFrame:
    return messages.groupBy(person, direction.alias("direction")).agg(F.min(seq).alias("first_seq"))


def first_of_person(messages: DataFrame, person: str, seq: str) -> DataFrame:
    """Each person's first message; found by one aggregate, so nothing is sorted."""
    return messages.groupBy(person).agg(F.min_by(F.struct(*messages.columns), seq).alias("m")).select("m.*")


def from_known(received: DataFrame, sent: DataFrame, person: str) -> DataFrame:
    """Messages of people who were written to."""
    return received.join(sent.select(person).distinct(), person, "left_semi")


def top(messages: DataFrame, person: str, k: int) -> DataFrame:
    return messages.groupBy(person).agg(F.count(F.lit(1)).alias("messages")).orderBy(F.desc("messages"), F.asc(person)).limit(k)


def last_and_next(events: DataFrame, person: str, at: str, ident: str, now: Column) -> DataFrame:
    """The event before a moment and the one from it on, for each person."""
    past, later = F.col(at) < now, F.col(at) >= now
    key = F.struct(at, ident)
    return events.groupBy(person).agg(F.max_by(ident, F.when(past, key)).alias("last_event"), F.min_by(ident, F.when(later, key)).alias("next_event"))


def suggest(people: DataFrame, toks: Column, prefixes: list[str], order: list[Column], k: int) -> DataFrame:
    """People for whom every prefix begins a word of their name."""
    some_word = lambda p: F.exists(toks, lambda t: t.startswith(p))
    return people.where(reduce(and_, map(some_word, prefixes), F.lit(True))).orderBy(*order).limit(k)


def islands(days: DataFrame, person: str, day: str, tolerance: int = 1) -> DataFrame:
    """Runs of days (or months, as integers) of which neighbours are at most ``tolerance`` apart: (person, first, last, entries, total of n)."""
    w = Window.partitionBy(person).orderBy(day)
    starts = (F.col(day) - F.lag(day).over(w) > tolerance) | F.lag(day).over(w).isNull()
    marked = days.withColumn("__s", starts.cast("int")).withColumn("__i", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(person, "__i").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("entries"), F.sum("n").alias("total")).drop("__i")
