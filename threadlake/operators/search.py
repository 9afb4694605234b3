"""Retrieval over a corpus of texts: BM25, grouping, facets, fusion.

The words of a query are known when the plan is built, so term frequencies are counted where the text is
read: a search shuffles no postings, only what it ranks. Many queries at once go through postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

K1, B, FLOOR = 1.2, 0.75, 1e-6


def corpus(docs: DataFrame, text_col: str, toks) -> DataFrame:
    return docs.withColumn("toks", toks(F.col(text_col)))


def tf(word: str) -> Column:
    """How often the word occurs: what is missing once it is taken out."""
    return F.size("toks") - F.size(F.array_remove("toks", word))


def bm25(docs: DataFrame, words: list[str], drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs`` (with toks) with a score; rows without any of the words are left out.

    Texts are tokenised once: what scores need is written down, narrow, and both the corpus statistics (a job that runs
    while the plan is built) and the scores read that.
    """
    counted = docs.withColumns({f"tf{i}": tf(w) for i, w in enumerate(words)} | {"dl": F.size("toks")})
    counted = written(counted.drop("toks", *drop), "counted")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.greatest(F.lit(FLOOR), F.log(F.lit((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))))
        f = F.col(f"tf{i}")
        score += idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"] or 1.0)))
    any_word = F.lit(False)
    for i in range(len(words)):
        any_word = any_word | (F.col(f"tf{i}") > 0)
    return counted.where(any_word).withColumn("score", score).drop("dl", *[f"tf{i}" for i in range(len(words))])


def recency(age_days: Column, weight: float = 0.35, half: int = 90) -> Column:
    return F.lit(weight) / (1 + age_days / half)


def group_best(hits: DataFrame, group: str, ident: str, score: str = "score", bonus: float = 0.03) -> DataFrame:
    """The best hit of each group, plus a bonus for how many there are."""
    best = F.max(F.struct(F.col(score), F.col(ident)))
    return hits.groupBy(group).agg(best.alias("b"), F.count(F.lit(1)).alias("matches")).select(group, F.col(f"b.{ident}").alias(ident), (F.col(f"b.{score}") + bonus * F.log(F.col("matches"))).alias(score), "matches")


def count_capped(hits: DataFrame, cap: int) -> DataFrame:
    """How many there are, but no more than cap + 1 are looked for."""
    return hits.limit(cap + 1).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("n"), (F.count(F.lit(1)) > cap).alias("more"))


def facets(hits: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One pass for the counts of all conditions."""
    return hits.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def postings(docs: DataFrame, ident: str) -> DataFrame:
    """(ident, term, tf, dl)"""
    return docs.select(ident, F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy(ident, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def ranked(hits: DataFrame, query: str, ident: str, k: int, score: str = "score") -> DataFrame:
    """The first k of each query, with ranks; equal scores by identifier."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(ident))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(lists: list[tuple[DataFrame, float]], ident: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (ident, rank) with weights."""
    scored = [df.select(ident, (F.lit(w) * (k + 1) / (k + F.col("rank"))).alias("s")) for df, w in lists]
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)
    return out.groupBy(ident).agg(F.sum("s").alias("score"))


def minmax(df: DataFrame, score: str, out: str) -> DataFrame:
    """Scaled to 0..1 over the rows; one row or equal scores give 1. The extremes are one row, so they are fetched, not windowed."""
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    scaled = F.lit(1.0) if lo is None or hi == lo else (F.col(score) - F.lit(lo)) / F.lit(hi - lo)
    return df.withColumn(out, scaled)


def soft_date_fit(age: Column, low: float, high: float, weight: float = 0.3) -> Column:
    """Full weight inside the range of ages, outside a bell whose width is half the range, a week at least."""
    sigma = max((high - low) / 2, 7.0)
    off = F.greatest(F.lit(low) - age, age - F.lit(high), F.lit(0.0))
    return F.lit(weight) * F.exp(-(off * off) / (2 * sigma * sigma))


def prior(recency_fit: Column, starred: Column, unread: Column, sent_to: Column, named: Column) -> Column:
    """What speaks for a message before any word is looked at."""
    count = F.least(F.lit(0.12), F.log1p(sent_to) * 0.03)
    return recency_fit + F.when(starred, 0.10).otherwise(0.0) + F.when(unread, 0.03).otherwise(0.0) + count + F.when(named, 0.30).otherwise(0.0)


def fused(keyword: DataFrame, semantic: DataFrame, ident: str, alpha: float) -> DataFrame:
    """(1 - alpha) of the keyword score and alpha of the semantic one; what only one list has gets 0 from the other."""
    both = keyword.select(ident, F.col("score").alias("kw")).join(semantic.select(ident, F.col("score").alias("sem")), ident, "full")
    return both.select(ident, ((1 - alpha) * F.coalesce("kw", F.lit(0.0)) + alpha * F.coalesce("sem", F.lit(0.0))).alias("score"))


def sweep(current: DataFrame, indexed: DataFrame, ident: str, signature: str) -> DataFrame:
    """What an index must do to follow its table: add, replace or delete."""
    both = current.select(ident, F.col(signature).alias("now")).join(indexed.select(ident, F.col(signature).alias("then")), ident, "full")
    action = F.when(F.col("then").isNull(), "add").when(F.col("now").isNull(), "delete").when(F.col("now") != F.col("then"), "replace")
    return both.select(ident, action.alias("action")).where("action is not null")
