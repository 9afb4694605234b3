"""Near-duplicate detection by min-max hashing.

A document's set is its distinct word shingles (a text with fewer words is one shingle), as 64-bit
hashes. Each of ``PERMUTATIONS`` permutations of the hashes is evaluated once and gives two signature values, the least
and the greatest, so half as many evaluations serve one length of signature. Bands of ``ROWS``
values are the keys of buckets; two sets of similarity s share none of the ``BANDS`` with
probability (1 - s^ROWS)^BANDS: 2e-8 at 0.85, 3e-6 at 0.8.

Equal sets are folded into one representative first. Then, for buckets of two or more:
1. every member is compared with the bucket's smallest representative, on full sets, and the links
   give components;
2. what is left are pairs of a bucket whose components still differ. Members of such buckets are
   compared block by block (at most ``BLOCK_ROWS`` members and about ``BLOCK_SHINGLES`` shingles in
   each), a pair in the first bucket it shares, and only while its components differ; links are again
   confirmed on full sets.
So components are those of all links, while no pair within a component need be looked at twice, no
list of pairs of a group is made, and no task holds a bucket: a large one is cut into blocks, and wherever rows meet
the one row of their key, bucket or centre, keys with many rows are dealt out to several tasks (``dealt_join``).

Null and empty texts have empty sets and are linked with nothing; rows with a null identifier are
linked with nothing and have a null component. An identifier that occurs with several texts is linked by any of them. An
empty table gives an empty result; only the identifier and the text are read. Whole texts are read; a very long one is
an array of hashes in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, spells, tidy, written

PERMUTATIONS, ROWS = 48, 4
BANDS = 2 * PERMUTATIONS // ROWS
BLOCK_SHINGLES, BLOCK_ROWS = 2_000_000, 4096
TABLE_BYTES = 2_000_000
ROWS_AT_ONCE, SIZE = 512, 1 << 20

_RANDOM = np.random.default_rng(11)
_A = _RANDOM.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, PERMUTATIONS, np.uint64)
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M[2]
    return h ^ (h >> np.uint64(29))


class Words:
    """A task's table of hashed words; emptied at ``TABLE_BYTES``."""

    def __init__(self):
        self.table: dict[bytes, int] = {}
        self.size = 0

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if self.size > TABLE_BYTES:
            self.table.clear()
            self.size = 0
        for w in set(words).difference(self.table):
            self.table[w] = xxhash.xxh64_intdigest(w)
            self.size += len(w)
        return np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, n: int, table: Words) -> np.ndarray:
    """Ascending distinct hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = table.hashes(words)
    n = min(n, len(words))
    out = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = mixed(out * _M[0] + h[k : len(h) - n + 1 + k] * _M[1])
    return np.unique(mixed(out))


def signature(grams: np.ndarray) -> np.ndarray:
    """The bands' keys as signed 64-bit numbers."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(grams), 4096):
        x = grams[i : i + 4096] * _A[:, None] + _B[:, None]
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    rows = np.concatenate([low, high]).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _M[0]
    for k in range(ROWS):
        key = mixed(key * _M[1] + rows[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_hash (null: empty set), bands."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    @tidy
    def run(batches):
        table = Words()
        for batch in batches:
            for start, size in spells(batch.column(1), ROWS_AT_ONCE, SIZE):
                b = batch.slice(start, size)
                sets = [shingles(t, n, table) for t in b.column(1).to_pylist()]
                keys = np.concatenate([signature(s) for s in sets if len(s)] or [np.zeros(0, np.int64)])
                ends = np.cumsum([0] + [BANDS * (len(s) > 0) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))],
                    names=["id", "n_shingles", "set_hash", "bands"],
                )

    return rows.mapInArrow(run, "id long, n_shingles long, set_hash string, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """id, grams of the wanted identifiers, which are a table whose size Spark knows."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")

    @tidy
    def run(batches):
        table = Words()
        for batch in batches:
            for start, size in spells(batch.column(1), ROWS_AT_ONCE, SIZE):
                b = batch.slice(start, size)
                sets = [shingles(t, n, table).view(np.int64) for t in b.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["id", "grams"])

    return rows.mapInArrow(run, "id long, grams array<long>").where(F.size("grams") > 0)


def components(spark, edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest identifier that each end of an edge (a, b) reaches. Labels fall to the least neighbour's and jump to their label's label until none moves."""
    both = written(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        least = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        new = labels.join(least, labels["id"] == least["a"]).select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        target = labels.select(F.col("id").alias("at"), F.col("comp").alias("further"))
        new = new.join(target, new["comp"] == target["at"]).select("id", F.least("comp", "further").alias("comp"), "was")
        new = written(spark, new, "labels")
        labels = new.select("id", "comp")
        if not new.where("comp <> was").limit(1).count():
            return labels


def similar(inter, size_a, size_b, percent: int):
    return 100 * inter >= percent * (size_a + size_b - inter)


def compare_block(percent: int):
    """Links between members of one bucket (or two blocks of it) whose components differ."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band, i, j = int(pdf["band"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        ids, block = pdf["id"].to_numpy(), pdf["block"].to_numpy()
        keys, sizes = np.stack(pdf["bands"].to_numpy()), pdf["grams"].map(len).to_numpy()
        names, comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        cand: list[np.ndarray] = []
        for x in range(len(ids)):
            y = np.arange(x + 1, len(ids))
            y = y[(comp[y] != comp[x]) & ((block[y] != block[x]) if i != j else True)]
            y = y[100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])]
            same = keys[y] == keys[x]
            shared = same.sum(1)
            ok = (shared > 0) & (same.argmax(1) == band)
            if ok.any():
                cand.append(np.stack([np.full(ok.sum(), x), y[ok], shared[ok]]))
        out = []
        if cand:
            pairs = np.concatenate(cand, 1)
            grams = pdf["grams"].to_numpy()
            for k in np.argsort(-pairs[2], kind="stable"):
                x, y = int(pairs[0, k]), int(pairs[1, k])
                a, b = root(int(comp[x])), root(int(comp[y]))
                if a != b and similar(len(np.intersect1d(grams[x], grams[y], assume_unique=True)), sizes[x], sizes[y], percent):
                    parent[a] = b
                    out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id, kept for every row: sets of ``n``-word shingles, linked from ``percent`` hundredths of similarity."""
    spark = docs.sparkSession
    sigs = written(spark, signatures(docs, n, id_col, text_col), "signatures")
    reps = sigs.where("set_hash is not null and id is not null").groupBy("set_hash").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = written(spark, reps, "representatives")
    own = sigs.join(reps, (sigs["set_hash"] == reps["set_hash"]) & (sigs["id"] == reps["rep"])).select("id", "n_shingles", "bands").dropDuplicates(["id", "bands"])
    own = written(spark, own, "bands")
    rows = own.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = written(spark, rows.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    placed = written(spark, dealt_join(rows, buckets, "key", "id"), "placed")
    pairs = written(spark, placed.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    grams = written(spark, sets_of(docs, written(spark, placed.select("id").distinct(), "members"), n, id_col, text_col), "sets")
    # a pair is compared where its first set is, so only one set of a pair travels twice
    ga, gb = grams.select(F.col("id").alias("a"), F.col("grams").alias("x")), grams.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    centres = written(spark, pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "centres")
    met = dealt_join(pairs.join(gb, "b"), ga.join(centres, "a"), "a", "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("m"))
    links = written(spark, met.where(similar(F.col("m"), F.col("nx"), F.col("ny"), percent)).select("a", "b"), "links")
    comp = components(spark, links)

    labelled = placed.where("n > 2").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "blocks", "n")
    left = dealt_join(labelled.drop("n"), written(spark, open_keys, "open"), "key", "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", "band", "id", "comp", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    left = left.join(own.select("id", "bands"), "id").join(grams, "id")
    more = written(spark, left.groupBy("key", "i", "j").applyInPandas(compare_block(percent), "a long, b long"), "links")
    named = lambda side: comp.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    between = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    upper = components(spark, between).select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    # a component of one representative has no label of its own: it may still be an end of a later link
    ends = comp.select("id", "comp").union(between.select(F.col("a").alias("id"), F.col("a").alias("comp"))).union(between.select(F.col("b").alias("id"), F.col("b").alias("comp"))).groupBy("id").agg(F.min("comp").alias("comp"))
    final = written(spark, ends.join(upper, "comp", "left").select(F.col("id").alias("rep"), F.coalesce("top", "comp").alias("class")), "classes")

    classes = written(spark, reps.join(final, "rep", "left").select("set_hash", F.coalesce("class", "rep").alias("class"), "n"), "classes")
    every = dealt_join(sigs.select("id", "n_shingles", "set_hash"), classes, "set_hash", "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return every.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns as they were, of each component: the one of its smallest identifier. Of rows that repeat an identifier one stays; rows without an identifier all do."""
    spark = docs.sparkSession
    judged = written(spark, near_duplicates(docs, n, percent, id_col, text_col).select(F.col(id_col).alias("id"), "kept"), "judged")
    gone = written(spark, judged.where("not kept").select("id").distinct(), "gone")
    kept = docs.join(gone, docs[id_col] == gone["id"], "left_anti")
    twice = written(spark, judged.where("kept and id is not null").groupBy("id").count().where("count > 1").select("id"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, kept[id_col] == twice["id"], "left_anti")
    return once.unionByName(kept.join(twice, kept[id_col] == twice["id"], "left_semi").dropDuplicates([id_col]))
