"""What else a typed word may have been in the corpus: joined words taken apart, forms of a word, respellings by company.

All of it works on the vocabulary, the index's terms with the number of texts that have each (``vocabulary``), which the index gives without
reading a text. Candidates are generated by rule and kept if the vocabulary has them, by an equi-join.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import written
from .mailbox import respelled
from .postings import Index

#: Letters of the shortest piece of a joined word.
PIECE = 3
#: Endings that may stand for each other, and what a word must have left of it: our own rules, applied in both directions.
ENDINGS = (("", "s"), ("", "es"), ("y", "ies"), ("", "ed"), ("e", "ed"), ("", "ing"), ("e", "ing"), ("", "er"), ("our", "or"), ("ise", "ize"), ("yse", "yze"), ("ogue", "og"), ("tre", "ter"), ("ence", "ense"))
STEM = 3


def vocabulary(index: Index) -> DataFrame:
    """(word, df): read from the columns in front of the postings."""
    return index.blocks.groupBy(F.col("term").alias("word")).agg(F.sum("n").alias("df"))


def pieces(words: DataFrame, known: DataFrame, word: str = "word", shortest: int = PIECE) -> DataFrame:
    """(word, at, piece, df): the parts of each word that ``known`` (word, df) has, but not the word as a whole. The parts of one word are as many as the square of its letters at most."""
    n = F.length(word)
    cut = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - shortest),
            lambda at: F.transform(F.sequence(F.lit(shortest), n - at), lambda size: F.struct(at.alias("at"), F.substr(F.col(word), at + 1, size).alias("piece"))),
        )
    )
    parts = words.where(n >= 2 * shortest).select(word, F.explode(cut).alias("c")).select(word, "c.*").where(F.col("piece") != F.col(word))
    return parts.join(known.select(F.col("word").alias("piece"), "df"), "piece").select(word, "at", "piece", "df")


def coverable(words: DataFrame, known: DataFrame, word: str = "word", shortest: int = PIECE) -> DataFrame:
    """The words that some known word begins and some known word ends; no other can be made of pieces. Beginnings and ends are as many as letters, so the
    squares of ``pieces`` are spent on few words."""
    n, whole = F.length(word), words.where(F.length(word) >= 2 * shortest).select(word)
    sizes = F.sequence(F.lit(shortest), n - shortest)
    sides = F.concat(
        F.transform(sizes, lambda k: F.struct(F.lit(0).alias("side"), F.substr(F.col(word), F.lit(1), k).alias("piece"))),
        F.transform(sizes, lambda k: F.struct(F.lit(1).alias("side"), F.substr(F.col(word), n - k + 1, k).alias("piece"))),
    )
    ends = whole.select(word, F.explode(sides).alias("s")).select(word, "s.*").join(known.select(F.col("word").alias("piece")), "piece", "left_semi")
    return ends.groupBy(word).agg(F.count_distinct("side").alias("__sides")).where("__sides = 2").select(word)


def best_path(word: str, parts: list[tuple[int, str, int]], total: int) -> str | None:
    """The pieces that make up the whole word with the largest product of their shares of ``total``; of equals the first by letters. Null if none do."""
    best: dict[int, tuple[float, str]] = {0: (0.0, "")}
    for at, piece, df in sorted(parts):
        if at in best:
            score, path = best[at]
            end, new = at + len(piece), (round(score + math.log(df / total), 9), f"{path} {piece}".strip())
            if end not in best or (-new[0], new[1]) < (-best[end][0], best[end][1]):
                best[end] = new
    found = best.get(len(word))
    return found[1] if found else None


def segmented(words: DataFrame, known: DataFrame, total: int, word: str = "word", shortest: int = PIECE) -> DataFrame:
    """(word, split): joined words taken apart into words of ``known``, the likeliest way (dynamic programming from left to right); words that cannot be are left out."""

    @F.pandas_udf(StringType())
    def path(whole: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([best_path(w, [(p["at"], p["piece"], p["df"]) for p in ps], total) for w, ps in zip(whole, parts, strict=True)], dtype=object)

    parts = pieces(coverable(words, known, word, shortest), known, word, shortest).groupBy(word).agg(F.collect_list(F.struct("at", "piece", "df")).alias("parts"))
    # a word that no piece begins or ends cannot be made of pieces, so it need not be tried
    can = F.exists("parts", lambda p: p["at"] == 0) & F.exists("parts", lambda p: p["at"] + F.length(p["piece"]) == F.length(word))
    return parts.where(can).select(word, path(word, "parts").alias("split")).where("split is not null")


def forms(word: Column) -> Column:
    """The words that the endings make of a word; each once, not the word itself."""
    made = [F.when(word.endswith(a) & (F.length(word) >= STEM + len(a)), F.concat(F.substr(word, F.lit(1), F.length(word) - len(a)), F.lit(b))) for x, y in ENDINGS for a, b in ((x, y), (y, x))]
    return F.array_distinct(F.filter(F.array(*made), lambda f: f.isNotNull() & (f != word)))


def variants(words: DataFrame, known: DataFrame, word: str = "word") -> DataFrame:
    """(word, form, df): the forms of each word that the vocabulary has."""
    return words.select(word, F.explode(forms(F.col(word))).alias("form")).join(known.select(F.col("word").alias("form"), "df"), "form").select(word, "form", "df")


def together(index: Index, candidates: DataFrame, queries: DataFrame, query: str, word: str) -> DataFrame:
    """(query, word, together): how many texts have a candidate and any other word of its query (``queries``: query, word).

    Only the postings of these words are read; texts meet by identifier, and a text counts once for each candidate however many of the other words it has.
    """
    asked = companies(queries, query, word)
    pairs = candidates.select(query, word).distinct().join(asked.select(query, "company"), query)
    return pairs.join(company_counts(index, pairs.select("company", word), asked, word), ["company", word]).select(query, word, "together")


def companies(queries: DataFrame, query: str, word: str) -> DataFrame:
    """(query, company, words): queries with the same other words have one company, so its texts are looked for once, however many ask."""
    asked = queries.groupBy(query).agg(F.array_sort(F.collect_set(word)).alias("words"))
    numbered = written(asked.select("words").distinct().withColumn("company", F.monotonically_increasing_id()), "companies")
    return written(asked.join(numbered, "words").select(query, "company", "words"), "asked")


def company_counts(index: Index, pairs: DataFrame, asked: DataFrame, word: str) -> DataFrame:
    """(company, word, together) of ``pairs`` (company, word); every posting of a word is read once for each company that it is paired with."""
    pairs = pairs.distinct()
    mine = index.blocks.join(pairs.select("company", F.col(word).alias("term")), "term").select("company", "term", F.explode("postings.id").alias("id"))
    members = asked.select("company", "words").distinct().select("company", F.explode("words").alias("term"))
    others = index.blocks.join(members, "term").select("company", F.explode("postings.id").alias("id")).distinct()
    return mine.join(others, ["company", "id"], "left_semi").groupBy("company", F.col("term").alias(word)).agg(F.count_distinct("id").alias("together"))


def respelled_by_company(index: Index, candidates: DataFrame, queries: DataFrame, query: str, word: str) -> DataFrame:
    """The candidate of each query that most texts share with its other words (``mailbox.respelled``), counted over the index."""
    return respelled(candidates, together(index, candidates, queries, query, word), query, word)


def respelled_alike(index: Index, words: DataFrame, queries: DataFrame, others: DataFrame, query: str, word: str, alike: str) -> DataFrame:
    """``respelled_by_company`` where the candidates of a query are all ``words`` (word, df, alike) that are like it (``queries``: query, alike), but not itself.

    The pairs of queries and candidates are not listed: of those that are alike the first two in each company are enough, because a query is at most one of them.
    """
    asked = companies(others, query, word)
    q = queries.join(asked.select(query, "company"), query, "left").withColumn("company", F.coalesce("company", F.lit(-1)))
    members = words.join(q.select("company", alike).distinct(), alike)
    counts = company_counts(index, members.select("company", word), asked, word)
    both = members.join(counts, ["company", word], "left").withColumn("together", F.coalesce("together", F.lit(0)))
    w = Window.partitionBy("company", alike).orderBy(F.desc("together"), F.desc("df"), F.asc(word))
    first = both.withColumn("__n", F.row_number().over(w)).where("__n <= 2")
    found = q.join(first, ["company", alike]).where(F.col(word) != F.col(query))
    best = found.groupBy(query).agg(F.min_by(F.struct(word, "df", "together"), "__n").alias("b"))
    return best.select(query, "b.*")
