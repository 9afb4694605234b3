"""Retrieval measures over a run (query, doc, rank) and judgments (query, doc, grade)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def gain(rank: Column, grade: Column) -> Column:
    return grade / F.log2(rank + 1)


def graded(run: DataFrame, judgments: DataFrame, query: str, doc: str) -> DataFrame:
    """Judgments (doc, grade) without a query are those of every query."""
    return run.join(judgments, [query, doc] if query in judgments.columns else [doc], "left")


def ndcg(run: DataFrame, judgments: DataFrame, k: int, query: str = "query", doc: str = "doc") -> DataFrame:
    """Linear gain; a query without relevant judgments has 0."""
    got = graded(run.where(F.col("rank") <= k), judgments, query, doc).groupBy(query).agg(F.sum(gain(F.col("rank"), F.coalesce("grade", F.lit(0)))).alias("dcg"))
    ideal = F.sum(gain(F.col("r"), F.col("grade"))).alias("ideal")
    order = [F.desc("grade"), F.asc(doc)]
    relevant = judgments.where("grade > 0")
    if query in judgments.columns:
        best = relevant.withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("r") <= k).groupBy(query).agg(ideal)
        both = got.join(best, query, "left")
    else:  # the same k for every query
        both = got.crossJoin(relevant.orderBy(*order).limit(k).withColumn("r", F.row_number().over(Window.orderBy(*order))).agg(ideal))
    return both.select(query, F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"))


def reciprocal_rank(run: DataFrame, judgments: DataFrame, least: int, query: str = "query", doc: str = "doc") -> DataFrame:
    """One over the rank of the first document of that grade or more, else 0."""
    first = F.min(F.when(F.col("grade") >= least, F.col("rank")))
    return graded(run, judgments, query, doc).groupBy(query).agg(F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("rr"))


def recall(run: DataFrame, judgments: DataFrame, k: int, query: str = "query", doc: str = "doc") -> DataFrame:
    """Relevant ones found among k, of as many as k has room for."""
    found = graded(run.where(F.col("rank") <= k), judgments, query, doc).groupBy(query).agg(F.count_if(F.col("grade") > 0).alias("found"))
    total = judgments.where("grade > 0").groupBy(query).agg(F.count(F.lit(1)).alias("relevant"))
    return found.join(total, query).select(query, F.round(F.col("found") / F.least(F.col("relevant"), F.lit(k)), 6).alias("recall"))


def judged(run: DataFrame, judgments: DataFrame, k: int, query: str = "query", doc: str = "doc") -> DataFrame:
    return graded(run.where(F.col("rank") <= k), judgments, query, doc).groupBy(query).agg(F.round(F.avg(F.col("grade").isNotNull().cast("double")), 6).alias("judged"))


def elements(df: DataFrame, value: str, want: Callable[[int], dict[str, int]]) -> DataFrame | None:
    """One row with the k-th smallest values (from 1), by name; ``want`` gives the ks when it knows how many values there are. None if there are none.

    Counted values are dealt to ranges; the driver gets a count for each range (a job that runs while the plan is built),
    and a task ranks the values of one range alone.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(counts.repartitionByRange(tasks, value).withColumn("__r", F.spark_partition_id()), "ranges")
    before, n = {}, 0
    for r in sorted(ranges.groupBy("__r").agg(F.sum("c").alias("c")).collect()):  # a row a range
        before[r["__r"]], n = n, n + r["c"]
    if not n:
        return None
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__r"))
    upto = ranges.withColumn("upto", start + F.sum("c").over(Window.partitionBy("__r").orderBy(value)))
    return upto.agg(*[F.min(F.when(F.col("upto") >= k, F.col(value))).alias(name) for name, k in want(n).items()])


def nearest_rank(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Percentiles as elements: the ceil(n * p)-th smallest, the first at least; null without values."""
    name = lambda p: f"p{round(100 * p)}"
    found = elements(df, value, lambda n: {name(p): max(-(-int(n * p * 10**6) // 10**6), 1) for p in shares})
    return df.limit(0).agg(*[F.min(value).alias(name(p)) for p in shares]) if found is None else found


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """The element at n/2 in ascending order (from 0); no row without values."""
    found = elements(df, value, lambda n: {"median": n // 2 + 1})
    return df.select(F.col(value).alias("median")).limit(0) if found is None else found


def run_diff(a: DataFrame, b: DataFrame, query: str = "query", doc: str = "doc") -> DataFrame:
    """What two runs rank differently; a missing rank is null."""
    both = a.select(query, doc, F.col("rank").alias("rank_a")).join(b.select(query, doc, F.col("rank").alias("rank_b")), [query, doc], "full")
    return both.where(~F.col("rank_a").eqNullSafe(F.col("rank_b")))


def randomization_test(pairs: DataFrame, group: str, a: str, b: str, rounds: int = 10_000, seed: int = 1) -> DataFrame:
    """Two-sided paired randomization: how often random signs give the differences a mean at least as large. A group is the queries of one comparison."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        d = (pdf[a] - pdf[b]).to_numpy(np.float64)
        rng, hits = np.random.default_rng(seed), 0
        for at in range(0, rounds, 500):
            signs = rng.integers(0, 2, (min(500, rounds - at), len(d))) * 2 - 1
            hits += int((np.abs((signs * d).mean(1)) >= abs(d.mean()) - 1e-12).sum())
        return pd.DataFrame({group: [pdf[group].iloc[0]], "difference": [d.mean()], "p": [(hits + 1) / (rounds + 1)]})

    kind = pairs.schema[group].dataType.simpleString()
    return pairs.groupBy(group).applyInPandas(test, f"{group} {kind}, difference double, p double")
