"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 drawn from its code point. A trigram is bound: the
first letter's vector permuted twice, times the second's permuted once, times the third's. A
document is the bundle (sum) of its trigrams; a language's prototype is the bundle of its training
documents. The prediction is the language with the largest cosine; the score is that cosine, at
least 0.

Texts are lower-cased, everything but letters is a word boundary, and a boundary is a letter of its
own. Training counts trigrams by language in every task and adds the bundles up on the executors:
the driver gets one vector for each language. All rows that may be learned from are used.

A null text or one without a letter is ``und`` with score 0; so is every text if there is nothing to
learn from. Equal cosines go to the language that sorts first. Repeated rows are predicted alike, an
empty table gives an empty result, and only the named columns are read. Whole texts are read, in slices bounded
in bytes, a very long text on its own; trigrams are counted sparsely, so memory follows the slice, whatever the alphabet.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spells, tidy

DIMENSION = 1024
SEED = 20
ROWS, SIZE = 512, 1 << 20
STEP = 8192
#: A matrix product pays where at least one of so many cells is filled.
SPARSE = 32
POINTS = 0x110000


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(POINTS)), bool, POINTS)


@lru_cache(4096)
def vector(point: int) -> np.ndarray:
    return (np.random.default_rng([SEED, point]).integers(0, 2, DIMENSION, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each trigram in the texts the text and which of the distinct ones it is; and the code points of those."""
    lows = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lows).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[np.flatnonzero(np.diff(doc, prepend=-1))] = True
    codes, doc = np.where(is_letter, codes, 32)[keep], doc[keep]
    present = np.zeros(POINTS, bool)
    present[codes] = True
    alphabet = np.flatnonzero(present)
    place = np.zeros(POINTS, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    c, k = place[codes], len(alphabet)
    tri = ((c[:-2] * k + c[1:-1]) * k + c[2:])[doc[:-2] == doc[2:]]
    of = doc[2:][doc[:-2] == doc[2:]]
    if k**3 <= 1 << 23:
        there = np.zeros(k**3, bool)
        there[tri] = True
        distinct = np.flatnonzero(there)
        to = np.zeros(k**3, np.int64)
        to[distinct] = np.arange(len(distinct))
        at = to[tri]
    else:
        distinct, at = np.unique(tri, return_inverse=True)
    points = np.stack([alphabet[distinct // (k * k)], alphabet[distinct // k % k], alphabet[distinct % k]], 1)
    return of, at, points


def bound(points: np.ndarray) -> np.ndarray:
    """The vector of each trigram."""
    alphabet, at = np.unique(points, return_inverse=True)
    v = np.stack([vector(int(p)) for p in alphabet]) if len(alphabet) else np.zeros((0, DIMENSION), np.int8)
    at = at.reshape(points.shape)
    return np.roll(v, 2, 1)[at[:, 0]] * np.roll(v, 1, 1)[at[:, 1]] * v[at[:, 2]]


def bundle(of: np.ndarray, at: np.ndarray, points: np.ndarray, rows: int) -> np.ndarray:
    """The sum of the vectors of each text's trigrams, for so many trigrams at a time that memory stays bounded."""
    out = np.zeros((rows, DIMENSION), np.float32)
    if len(points) > STEP:
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
    for i in range(0, len(points), STEP):
        lo, hi = np.searchsorted(at, [i, i + STEP]) if len(points) > STEP else (0, len(at))
        v, d, t = bound(points[i : i + STEP]), of[lo:hi], at[lo:hi] - i
        if (hi - lo) * SPARSE >= rows * len(v):
            counts = np.bincount(d * len(v) + t, minlength=rows * len(v)).reshape(rows, -1)
            out += counts.astype(np.float32) @ v.astype(np.float32)
            continue
        for j in range(0, hi - lo, STEP):
            order = np.argsort(d[j : j + STEP], kind="stable")
            text = d[j : j + STEP][order]
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            out[text[starts]] += np.add.reduceat(v[t[j : j + STEP][order]], starts, axis=0, dtype=np.float32)
    return out


def train(docs: DataFrame, learn: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit vector for each language of the rows that ``learn`` allows."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = (rows if learn is None else rows.where(learn)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    @tidy
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, n in spells(batch.column(1), ROWS, SIZE):
                langs, texts = (c.to_pylist() for c in batch.slice(start, n).columns)
                of, at, points = trigrams(texts)
                names = sorted(set(langs))
                which = np.array([names.index(x) for x in langs])
                for name, v in zip(names, bundle(which[of], at, points, len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    total = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in total.collect()}
    unit = {k: v / n for k, v in found.items() if (n := np.linalg.norm(v)) > 0}
    return dict(sorted(unit.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred and score for every row."""
    names = list(prototypes)
    matrix = np.stack(list(prototypes.values())).astype(np.float32) if names else np.zeros((0, DIMENSION), np.float32)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))

    @tidy
    def run(batches):
        for batch in batches:
            for start, n in spells(batch.column(1), ROWS, SIZE):
                b = batch.slice(start, n)
                texts, pred, best = b.column(1).to_pylist(), ["und"] * n, np.zeros(n)
                full = [k for k, t in enumerate(texts) if t and names and any(map(str.isalpha, t))]
                if full:
                    v = bundle(*trigrams([texts[k] for k in full]), len(full))
                    cos = v @ matrix.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    for k, row in zip(full, cos, strict=True):
                        pred[k], best[k] = names[int(row.argmax())], min(1.0, max(0.0, float(row.max())))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(best)], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
