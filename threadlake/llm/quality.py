"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text becomes a sparse vector of hashed n-grams: words (lower-cased, one and two in a row) and the
shapes of words (upper, title or lower case, digits, which punctuation, ``=`` for a word that
repeats the one before; one to three in a row). A value is the n-gram's share of all in the text,
times ``SCALE``.
A score is the sigmoid of the sparse dot product with the weights plus the bias.

Training takes at most ``SAMPLE`` labelled rows, those with the smallest hashes of their
identifiers; they are dealt to ``SHARDS`` tasks by hash, each runs ``EPOCHS`` passes of per-coordinate FTRL
updates, and the weights are averaged. The sample and the model are bounded whatever the input, so
both may be broadcast. Scoring covers every row of the input.

Null and empty texts have the bias alone as their score. A row labelled more than once counts as 1
if its labels average 0.5 or more; null labels are left out. Without any label the score is 0.5 for
all. Repeated rows get equal scores, an empty table an empty result; no column but the identifier
and the text is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spells, tidy

BITS = 18
SAMPLE = 16_000
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
SCALE = 20.0
TABLE_CHARS = 2_000_000
ROWS, SIZE = 256, 1 << 20

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.array([0x9E3779B97F4A7C15], np.uint64)
_SALT = np.array([[0x51], [0x52], [0x61], [0x62], [0x63]], np.uint64)


def shape(token: str) -> str:
    if token[0].isalpha():
        return "A" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "a"
    if token[0].isalnum() or token[0] == "_":
        return "0"
    return token[:1] + "+" * (len(token) > 1)


class Tokens:
    """A task's table of distinct tokens; emptied at ``TABLE_CHARS`` characters, so its memory is bounded whatever the words are."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.chars, self.hashes = 0, np.zeros((1024, 2), np.uint64)

    def look_up(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word and shape hash of each token."""
        seen = self.seen
        if self.chars > TABLE_CHARS:
            seen.clear()
            self.chars = 0
        new = set(tokens).difference(seen)
        if len(seen) + len(new) > len(self.hashes):
            self.hashes = np.resize(self.hashes, (2 * (len(seen) + len(new)), 2))
        for t in new:
            self.hashes[len(seen)] = (xxhash.xxh64_intdigest(t.lower().encode("utf-8", "replace")), xxhash.xxh64_intdigest(shape(t).encode()))
            seen[t] = len(seen)
            self.chars += len(t)
        at = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
        return self.hashes[at, 0], self.hashes[at, 1]


_REPEAT = np.uint64(xxhash.xxh64_intdigest(b"="))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ^ (b * _MIX + (a << np.uint64(7)))) * _MIX


def grams(texts: list[str | None], tokens: Tokens, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of the texts, one after another: (text, index). No n-gram crosses from one text to the next."""
    cut = [_TOKEN.findall(t or "") for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    w, s = tokens.look_up([t for c in cut for t in c])
    s[1:][(w[1:] == w[:-1]) & (doc[1:] == doc[:-1])] = _REPEAT
    s2 = mix(s[:-1], s[1:])
    families = [mix(w, _SALT[0]), mix(mix(w[:-1], w[1:]), _SALT[1]), mix(s, _SALT[2]), mix(s2, _SALT[3]), mix(mix(s2[:-1], s[2:]), _SALT[4])]
    inside = [slice(None)] + [doc[:-k] == doc[k:] for k in (1, 2)]
    which = (0, 1, 0, 1, 2)
    at = np.concatenate([(f[inside[k]] >> np.uint64(64 - bits)).astype(np.int64) for f, k in zip(families, which, strict=True)])
    of = np.concatenate([doc[: len(doc) - k][inside[k]] for k in which])
    return of, at


def features(text: str | None, tokens: Tokens | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending indices of one text and their values: the share of each n-gram."""
    _, at = grams([text], tokens or Tokens(), bits)
    at, n = np.unique(at, return_counts=True)
    return at, (n * (SCALE / max(1, n.sum()))).astype(np.float32)


def dots(texts: list[str | None], w: np.ndarray, tokens: Tokens) -> np.ndarray:
    """The sparse dot product of each text's features with the weights (the bias last), plus the bias."""
    of, at = grams(texts, tokens)
    n = np.bincount(of, minlength=len(texts))
    return np.bincount(of, w[at], minlength=len(texts)) * SCALE / np.maximum(n, 1) + float(w[-1])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights, the bias last, after ``epochs`` passes in a seeded order."""
    z, n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
    order = np.random.default_rng(seed)
    weights = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    rows = [(np.append(at, 2**bits), np.append(x, np.float32(1)), y) for at, x, y in rows]
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at], n[at] = zi + g - step * w, ni + g * g
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights from the labelled rows that ``learn`` (a condition on ``id_col``) allows."""
    each = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias(id_col), label_col)
    if learn is not None:
        each = each.where(learn)
    each = each.groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
    sample = each.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(sample), id_col)
    dealt = rows.select("__text", "__y", F.pmod(F.xxhash64(id_col), F.lit(SHARDS)).alias("shard"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens()
        made = [(*features(t, tokens), int(y)) for t, y in sorted(zip(pdf["__text"].fillna(""), pdf["__y"], strict=True))]
        return pd.DataFrame({"w": [ftrl(made).astype(np.float32).tobytes()], "n": [len(made)]})

    fitted = dealt.groupBy("shard").applyInPandas(fit, "w binary, n long").collect()  # SHARDS rows
    if not fitted:
        return np.zeros(2**BITS + 1, np.float32)
    return np.average([np.frombuffer(r["w"], np.float32) for r in fitted], axis=0, weights=[r["n"] for r in fitted]).astype(np.float32)


def scored(batches: Iterable[pa.RecordBatch], at: int, w: np.ndarray):
    """Slices of the batches with the dot products of the texts in column ``at``."""
    tokens = Tokens()
    for batch in batches:
        for start, n in spells(batch.column(at), ROWS, SIZE):
            b = batch.slice(start, n)
            yield b, dots(b.column(at).to_pylist(), w, tokens)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns to keep, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))

    rows_at = len(keep) + 1

    @tidy
    def run(batches):
        for b, dot in scored(batches, rows_at, shared.value):
            p = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, *keep, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")


def accepted(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they were, whose score is at least 0.5."""
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text_col)

    @tidy
    def run(batches):
        for b, dot in scored(batches, at, shared.value):
            yield b.filter(pa.array(dot >= 0))

    return docs.mapInArrow(run, docs.schema)
