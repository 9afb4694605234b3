"""The passage of a text that says most about a query: the window of characters that covers the largest weight of its words."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

SIZE = 240
_TOKEN = re.compile(r"[^\W_]+")
PASSAGE = StructType([StructField("start", IntegerType()), StructField("score", DoubleType()), StructField("passage", StringType())])


def folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def best_window(text: str, weights: dict[str, float], size: int = SIZE) -> tuple[int, float, str] | None:
    """(start, weight, passage) of the window of ``size`` characters whose distinct words weigh most; it begins at one of them, the first of equals. A word that
    is longer than the window counts where it begins. Two pointers go over the places of the words, so time is linear in the text. None if no word occurs."""
    found = [(m.start(), m.end(), w) for m in _TOKEN.finditer(text) if (w := folded(m[0])) in weights]
    best, held, total, hi = None, {}, 0.0, 0
    for lo, (start, _, word) in enumerate(found):
        while hi < len(found) and (found[hi][1] <= start + size or hi == lo):
            w = found[hi][2]
            held[w] = held.get(w, 0) + 1
            total += weights[w] if held[w] == 1 else 0.0
            hi += 1
        weight = round(sum(weights[w] for w, n in held.items() if n), 9) if best is None or total > best[1] - 1e-6 else 0.0
        if best is None or weight > best[1]:
            best = (start, weight)
        held[word] -= 1
        if not held[word]:
            total -= weights[word]
    if best is None:
        return None
    start, weight = best
    cut = text[start : start + size]
    if start + size < len(text) and not text[start + size].isspace() and " " in cut[size // 2 :]:
        cut = cut[: cut.rindex(" ")]  # not in the middle of a word
    return start, weight, re.sub(r"\s+", " ", cut).strip()


def passages(texts: Column, weights: dict[str, float], size: int = SIZE) -> Column:
    """(start, score, passage) of each text, null where no word occurs; ``weights`` are those of the query's words.

    It is called non-deterministic, so that a condition on its result is not moved in front of a join and it sees the joined rows alone.
    """

    @F.pandas_udf(PASSAGE)
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_window(t, weights, size) or (None, None, None) if t else (None, None, None) for t in column], columns=["start", "score", "passage"], dtype=object)

    return run.asNondeterministic()(texts)


def best_passages(hits: DataFrame, texts: DataFrame, ident: str, text: str, weights: dict[str, float], size: int = SIZE) -> DataFrame:
    """``hits`` with the best passage of each; only their texts are read by Python."""
    joined = hits.join(texts.select(ident, text), ident).withColumn("__p", passages(F.col(text), weights, size))
    return joined.select(*hits.columns, F.col("__p.start").alias("start"), F.col("__p.passage").alias("passage")).where("start is not null")
