"""Vector search by higher-order functions: the filter comes before the score, the score before the cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def int8(a: Column) -> Column:
    """(codes, scale): scale is the largest magnitude over 127."""
    scale = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127
    return F.struct(F.transform(a, lambda x: F.when(scale > 0, F.round(x.cast("double") / scale)).otherwise(F.lit(0.0)).cast("int")).alias("codes"), scale.alias("scale"))


def bits(a: Column) -> Column:
    """Signs of the first 64 components as one number."""
    return F.aggregate(F.transform(a, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def nearest(vectors: DataFrame, query: list[float], k: int, ident: str, column: str = "embedding", where: Column | None = None) -> DataFrame:
    """Exact: every vector that the condition admits is scored."""
    rows = vectors if where is None else vectors.where(where)
    return rows.select("*", F.round(dot(F.col(column), vector(query)), 6).alias("score")).orderBy(F.desc("score"), F.asc(ident)).limit(k)


def best_chunk(scored: DataFrame, doc: str, ident: str, k: int) -> DataFrame:
    """The best chunk of each document, then the best documents."""
    return scored.groupBy(doc).agg(F.max("score").alias("score"), F.min_by(ident, F.struct(-F.col("score"), F.col(ident))).alias(ident)).orderBy(F.desc("score"), F.asc(doc)).limit(k)


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hash_embedded(rows: DataFrame, toks: str, out: str, dimension: int = 64) -> DataFrame:
    """Bag of words by hashing: each word adds 1 or -1 to one component; scaled to unit length. Needs no model."""

    @F.pandas_udf("array<float>")
    def embed(column: pd.Series) -> pd.Series:
        seen: dict[str, int] = {}
        made = []
        for words in column:
            v = np.zeros(dimension, np.float64)
            for w in words if words is not None else ():
                if w not in seen:
                    seen[w] = fnv1a(w.encode())
                v[seen[w] % dimension] += 1 if seen[w] >> 63 else -1
            made.append((v / n if (n := np.linalg.norm(v)) else v).astype(np.float32))
        return pd.Series(made)

    return rows.withColumn(out, embed(toks))
