"""Helpers the operators share: the shared folder, files in it, and range buckets of an identifier."""

from __future__ import annotations

import ctypes
import functools
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    path = f"{shared_dir(spark, name)}/t.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Rows of one key that a task gets at most (about) where keys are dealt out.
HEAVY = 512


def dealt_join(left: DataFrame, right: DataFrame, key: str, ident: str, how: str = "inner") -> DataFrame:
    """``left.join(right, key)`` where a key may hold any share of the rows of ``left``.

    ``right`` has one row a key and in ``n`` how many rows of ``left`` it meets. Rows of keys with more than ``HEAVY`` are
    dealt out by the hash of ``ident``, and the key's one row goes to each of their tasks. The list of such keys is written
    down, so Spark knows its size before it decides how to join it.
    """
    spark, parts = left.sparkSession, F.greatest(F.ceil(F.col("n") / HEAVY), F.lit(1)).cast("int")
    heavy = written(spark, right.where(F.col("n") > HEAVY).select(key, parts.alias("__parts")), "heavy")
    many = left.join(heavy, key, "left").withColumn("__salt", F.pmod(F.xxhash64(ident), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    return many.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))), [key, "__salt"], how).drop("__salt")


def spells(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of a column of texts: at most ``rows`` rows and ``size`` bytes, a longer text on its own."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and (total + n > size or i - start == rows):
            yield start, i - start
            start, total = i, 0
        total += n
    if len(texts) > start:
        yield start, len(texts) - start


def tidy(run):
    """A task's function that gives its memory back when it ends: a Python worker lives on and serves the tasks of other stages."""

    @functools.wraps(run)
    def whole(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def fs_of(uri: str):
    """(pyarrow file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put_file(uri: str, write) -> None:
    """Write a file under another name, then move it into place: a retried or speculative task leaves whole files only."""
    fs, path = fs_of(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    fs.move(part, path)


def range_cuts(df: DataFrame, key: Column, buckets: int) -> list[int]:
    """At most ``buckets - 1`` ascending values that occur in ``key`` and cut it in about equal ranges.

    One pass over the key column alone; the driver gets the cuts, never the keys.
    """
    if buckets < 2:
        return []
    at = F.split(F.lit(",".join(str(i / buckets) for i in range(1, buckets))), ",").cast("array<double>")
    found = df.agg(F.percentile_approx(key, at, F.lit(max(1000, 8 * buckets)))).first()[0]
    return sorted(set(found or []))


def grouped(cuts: list[int]) -> tuple[Column, Column, int]:
    """The cuts in groups of about the square root of their number, the last of each group, and how many a group has. Both are single literals, however many cuts there are."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    lasts = F.split(F.lit(",".join(str(g[-1]) for g in groups)), ",").cast("array<bigint>")
    return F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>"), lasts, step


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts lie below ``key``: bucket b holds the keys in (cuts[b-1], cuts[b]].

    Two levels, so a row compares with about twice the square root of the cuts.
    """
    if not cuts:
        return F.lit(0)
    nested, lasts, step = grouped(cuts)
    below = lambda a: F.size(F.filter(a, lambda c: c < key))
    g = below(lasts)
    # past the last group, which may be short, all cuts lie below
    return F.least(g * F.lit(step) + F.coalesce(F.nullif(below(F.get(nested, g)), F.lit(-1)), F.lit(0)), F.lit(len(cuts))).cast("int")


def is_cut(key: Column, bucket: Column, cuts: list[int]) -> Column:
    """Whether ``key``, which lies in ``bucket``, is the cut that ends it."""
    if not cuts:
        return F.lit(False)
    nested, _, step = grouped(cuts)
    return F.coalesce(F.get(F.get(nested, F.floor(bucket / step).cast("int")), bucket % step) == key, F.lit(False))
