"""Intervals and graphs: overlaps by buckets of time, nearest in time, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def bucketed(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    """A row for each bucket that [start, end) touches; intervals are integers, and empty ones touch none."""
    return df.where(F.col(end) > F.col(start)).withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs whose [ls, le) and [rs, re) overlap and whose keys are equal. An equi-join on key and bucket; a pair counts in the bucket where the later one starts."""
    a, b = bucketed(left, "ls", "le", width, "bucket"), bucketed(right, "rs", "re", width, "bucket")
    met = a.join(b, [*keys, "bucket"]).where("ls < re and rs < le")
    return met.where(F.floor(F.greatest("ls", "rs") / width) == F.col("bucket")).drop("bucket")


def nearest(events: DataFrame, key: str, at: str, ident: str, moment: Column) -> DataFrame:
    """For each key the event closest to a moment; of equally close ones the one with the smaller identifier."""
    return events.groupBy(key).agg(F.min_by(ident, F.struct(F.abs(F.col(at) - moment), F.col(ident))).alias(ident))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(spark, name)}/t.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest identifier reachable over edges (a, b). Each round takes the least label of the neighbours, then the label of that label, and writes it to the shared folder."""
    spark = edges.sparkSession
    both = written(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        least = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(least, labels["id"] == least["a"]).select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        target = labels.select(F.col("id").alias("at"), F.col("component").alias("further"))
        new = new.join(target, new["component"] == target["at"]).select("id", F.least("component", "further").alias("component"), "was")
        new = written(spark, new, "labels")
        labels = new.select("id", "component")
        if not new.where("component <> was").limit(1).count():
            return labels


def calendar(spark: SparkSession, start: str, end: str, unit: str, name: str) -> DataFrame:
    """Every day or month from start to end, both included."""
    return spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval 1 {unit})) as {name}")


def gap_filled(counts: DataFrame, grid: DataFrame, on: str, value: str) -> DataFrame:
    return grid.join(counts, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def previous(key: str, order: list[Column], column: str) -> Column:
    return F.lag(column).over(Window.partitionBy(key).orderBy(*order))
