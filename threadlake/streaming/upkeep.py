"""Aggregates that follow a feed of changes: counters by subtraction, firsts and lasts found again only where they were lost."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import Table, latest


class Figures:
    """Of each group: ``n`` rows, sums of columns, ``first`` and ``last`` of a time.

    Two keyed tables: the figures, and how many rows each group has at each time. A change adds to the counters and subtracts from them. Only
    where a row goes that was a group's first or last, the group's times are read again, from the buckets of such groups alone. A group without rows
    is gone. A null time counts for ``n`` and the sums, not for first and last.
    """

    def __init__(self, spark: SparkSession, path: str, group: list[str], sums: list[str], at: str, buckets: int = 16):
        self.group, self.sums, self.at = group, sums, at
        self.figures = Table(spark, f"{path}/figures", group, buckets)
        self.times = Table(spark, f"{path}/times", group, buckets)

    def read(self) -> DataFrame | None:
        return self.figures.read()

    def apply(self, deltas: DataFrame, batch: int) -> None:
        """``deltas`` are rows with ``sign``: 1 for one that comes, -1 for one that goes. A batch that comes again changes nothing."""
        rows = deltas.where(F.concat_ws("", *[F.col(g).isNull().cast("string") for g in self.group]).contains("true") == F.lit(False))
        at, sign, group = F.col(self.at), F.col("sign"), self.group

        def counted(old: DataFrame | None, new: DataFrame) -> DataFrame:
            both = new if old is None else old.unionByName(new)
            return both.groupBy(*group, self.at).agg(F.sum("n").alias("n")).where("n <> 0")

        self.times.change(rows.where(at.isNotNull()).groupBy(*group, self.at).agg(F.sum(sign.cast("long")).alias("n")), counted, batch)
        changed = rows.groupBy(*group).agg(
            F.sum(sign.cast("long")).alias("n"),
            *[F.sum(sign * F.col(c)).alias(c) for c in self.sums],
            F.min(F.when(sign > 0, at)).alias("first"),
            F.max(F.when(sign > 0, at)).alias("last"),
            F.min(F.when(sign < 0, at)).alias("gone_first"),
            F.max(F.when(sign < 0, at)).alias("gone_last"),
        )

        def summed(old: DataFrame | None, new: DataFrame) -> DataFrame:
            names = [*group, "n", *self.sums, "first", "last"]
            if old is None:
                return new.select(*names).where("n > 0")
            was = old.select(*group, *[F.col(c).alias(f"__{c}") for c in names[len(group) :]])
            both = was.join(new, group, "full")
            lost = both.where("gone_first <= __first or gone_last >= __last").select(*group)
            anew = self.times.at_keys(lost)
            ends = anew.groupBy(*group).agg(F.min(self.at).alias("__f"), F.max(self.at).alias("__l"), F.lit(True).alias("__lost"))
            both = both.join(ends, group, "left")
            add = lambda c: (F.coalesce(f"__{c}", F.lit(0)) + F.coalesce(c, F.lit(0))).alias(c)
            # a group may have lost its only rows with a time: then nothing was found, and what was is no longer
            found = F.coalesce("__lost", F.lit(False)) | F.coalesce(F.expr("gone_first <= __first or gone_last >= __last"), F.lit(False))
            first = F.when(found, F.col("__f")).otherwise(F.least("__first", "first")).alias("first")
            last = F.when(found, F.col("__l")).otherwise(F.greatest("__last", "last")).alias("last")
            return both.select(*group, add("n"), *[add(c) for c in self.sums], first, last).where("n > 0")

        self.figures.change(changed, summed, batch)


class Mailbox:
    """Messages by identifier, and figures over them, kept by one feed.

    The feed has the columns of the messages, ``seq`` (the later row of an identifier counts) and ``deleted``. Each micro-batch is turned into
    rows that go and rows that come, which are written down under its number before any table changes: a batch that is interrupted is
    finished from what was written, and one that was finished changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, ident: str, columns: list[str], buckets: int = 16):
        self.spark, self.path, self.ident, self.columns = spark, path, ident, columns
        self.messages = Table(spark, f"{path}/messages", [ident], buckets)
        self.figures: dict[str, tuple[Figures, dict[str, Column]]] = {}

    def keep(self, name: str, group: list[str], sums: dict[str, Column], at: str) -> Mailbox:
        """Figures by ``group``; ``sums`` are columns by name."""
        self.figures[name] = Figures(self.spark, f"{self.path}/{name}", group, list(sums), at), sums
        return self

    def apply(self, feed: DataFrame, batch: int) -> None:
        path = f"{self.path}/deltas/{batch:08d}"
        last = latest(feed, [self.ident], [F.desc("seq"), F.desc("deleted")])
        try:
            deltas = self.spark.read.parquet(path)
        except AnalysisException:
            old = self.messages.at_keys(last)
            new = last.where(~F.coalesce("deleted", F.lit(False))).select(*self.columns, F.lit(1).alias("sign"))
            both = new if old is None else new.unionByName(old.select(*self.columns, F.lit(-1).alias("sign")))
            both.write.mode("overwrite").parquet(path)
            deltas = self.spark.read.parquet(path)
        for kept, sums in self.figures.values():
            kept.apply(deltas.withColumns(sums), batch)

        def replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
            here = new.where(~F.coalesce("deleted", F.lit(False))).select(*self.columns)
            return here if old is None else old.join(new.select(self.ident), self.ident, "left_anti").unionByName(here)

        self.messages.change(last, replaced, batch)
