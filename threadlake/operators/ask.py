"""Exact answers over facts: one record says what is asked, one job computes it.

``units`` are facts of one real thing each: merged, cancelled ones dropped, refunds negated. Money is
decimal and never mixes currencies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Question:
    op: str  # count, sum, average, average_per_period, max, min, first, last, next, exists
    measure: str | None = None
    group_by: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    now: str | None = None


def units(facts: DataFrame, key: list[str], newest: list[Column], cancelled: Column, refund: Column, amount: str) -> DataFrame:
    """The newest fact of each key without the cancelled, amounts of refunds negated."""
    latest = facts.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where("__n = 1").drop("__n")
    return latest.where(~F.coalesce(cancelled, F.lit(False))).withColumn(amount, F.when(refund, -F.col(amount)).otherwise(F.col(amount)))


def within(df: DataFrame, at: str, q: Question) -> DataFrame:
    """Half open, either end open."""
    if q.start:
        df = df.where(F.col(at) >= F.lit(q.start).cast("timestamp_ntz"))
    if q.end:
        df = df.where(F.col(at) < F.lit(q.end).cast("timestamp_ntz"))
    return df


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def answer(df: DataFrame, q: Question, at: str = "at", ident: str = "id", currency: str = "currency") -> DataFrame:
    df = within(df, at, q)
    by = list(q.group_by)
    if q.op == "count":
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if q.op == "exists":
        return df.groupBy(*by).agg((F.count(F.lit(1)) > 0).alias("found"))
    if q.op in ("sum", "average"):
        f = F.sum(money(q.measure)).cast("double") if q.op == "sum" else F.round(F.sum(money(q.measure)).cast("double") / F.count(F.lit(1)), 4)
        return df.groupBy(*by, currency).agg(f.alias("amount"), F.count(F.lit(1)).alias("n"))
    if q.op == "average_per_period":
        months = F.months_between(F.lit(q.end).cast("date"), F.lit(q.start).cast("date"))
        return df.groupBy(*by, currency).agg(F.round(F.sum(money(q.measure)).cast("double") / months, 4).alias("amount"))
    if q.op in ("max", "min"):
        pick = F.max_by if q.op == "max" else F.min_by
        order = F.struct(money(q.measure), -F.col(ident) if q.op == "max" else F.col(ident))
        return df.groupBy(*by, currency).agg(pick(ident, order).alias(ident), pick(q.measure, order).alias("amount"))
    key = F.struct(at, ident)
    if q.op == "next":
        return df.where(F.col(at) >= F.lit(q.now).cast("timestamp_ntz")).groupBy(*by).agg(F.min_by(ident, key).alias(ident))
    return df.groupBy(*by).agg((F.min_by if q.op == "first" else F.max_by)(ident, key).alias(ident))


def compare(df: DataFrame, sides: dict[str, Column], measure: str) -> DataFrame:
    """Count and total of each side in one pass."""
    return df.agg(*[f for k, c in sides.items() for f in (F.count_if(c).alias(f"n_{k}"), F.sum(F.when(c, money(measure))).cast("double").alias(f"amount_{k}"))])


def main_value(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1)


def winners(groups: DataFrame, value: str, tolerance: float = 0.005) -> DataFrame:
    """The leading groups: all within the tolerance of the largest value."""
    best = groups.agg(F.max(value)).first()[0]
    return groups.where(F.col(value) >= F.lit((best if best is not None else 0.0) - tolerance))
