"""The prefix trie of conversations: nodes are distinct first d turns, found by chained digests.

Every conversation is a path from the root. A turn's digest is the SHA-256 of its role and text; the digest of a prefix is the
SHA-256 of the shorter prefix's digest and the turn's, so equal prefixes have equal digests and a prefix's digest stands for all
of it. The prefixes of all conversations are exploded and grouped by (depth, digest): the groups are the nodes.

Sums over subtrees: each node goes to all its ancestors. Nodes with one and the same members that follow each other are taken together
as a *stretch* first, and stretches are exploded to ancestor stretches; within a stretch the sums are running sums. A stretch ends where
a conversation leaves or ends, so the rows exploded stay below twice the number of turns, however long an unshared (or an exactly
copied) conversation is.

Turns are ordered by ``turn`` (null first), then role, then text, so ties and repeated rows have a defined order. A null role or text is the
empty text. Rows without a conversation's identifier belong to none and are left out; a conversation without turns is the root's member. An empty table has no
conversations and no nodes. Other columns are not read. Prefix digests and the digests of ends are made from sorted streams, so no
conversation or group is ever held whole; common nodes meet their members dealt out (``dealt_join``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, tidy, written

#: Shared turns at the start are at most one less than this, and groups of conversations that may share them.
HEADS, GROUP = 6, 100
CHUNK = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b"root"


def ordered(conversations: DataFrame) -> DataFrame:
    """conv, at (from 0), turn (digest), chars: each conversation's turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("__turn"), role.alias("role"), text.alias("text"))
    at = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("__turn").asc_nulls_first(), "role", "text")) - 1
    # the role's length first: two turns are equal only if both parts are
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string").cast("binary"), F.lit(" ").cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary")), 256))
    return rows.select("conv", at.alias("at"), digest.alias("turn"), F.char_length("text").cast("long").alias("chars"))


def heads(conv: Column) -> Column:
    """How many first turns a conversation takes from its group's first."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, part, at, turn, chars): the group's first conversation's first turns, then the own ones behind as many; part -1 is the root's row, one for each of ``convs``."""
    base = F.col("conv") - F.col("conv") % GROUP
    givers = turns.where((F.col("conv") % GROUP == 0) & (F.col("at") < HEADS - 1)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "chars"))).alias("first"))
    takers = convs.select("conv", base.alias("base"), heads(F.col("conv")).alias("h")).where("h > 0")
    given = takers.join(givers.withColumnRenamed("conv", "base"), "base").select("conv", F.explode(F.slice("first", F.lit(1), F.col("h"))).alias("x")).select("conv", F.lit(0).alias("part"), "x.at", "x.turn", "x.chars")
    own = turns.where(F.col("at") >= heads(F.col("conv"))).select("conv", F.lit(1).alias("part"), "at", "turn", "chars")
    root = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("at"), F.lit(ROOT).alias("turn"), F.lit(0).cast("long").alias("chars"))
    return root.unionByName(given).unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, digest, chars): every prefix of every conversation, by a chain of digests over its sorted turns."""
    rows = turns.repartition(F.col("conv")).sortWithinPartitions("conv", "part", "at").select("conv", "turn", "chars")

    @tidy
    def run(batches):
        last = digest = None
        depth = 0
        for batch in batches:
            out, depths = [], []
            convs = batch.column(0)
            for conv, turn in zip(convs.to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != last:
                    last, digest, depth = conv, hashlib.sha256(turn).digest(), 0
                else:
                    digest, depth = hashlib.sha256(digest + turn).digest(), depth + 1
                out.append(digest)
                depths.append(depth)
            yield pa.RecordBatch.from_arrays([convs, pa.array(depths, pa.int64()), pa.array(out, pa.binary()), batch.column(2)], names=["conv", "depth", "digest", "chars"])

    return rows.mapInArrow(run, "conv long, depth long, digest binary, chars long")


def end_digests(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes at which conversations end: the hash of their sorted numbers, comma-joined.

    Numbers are sorted and joined to chunks in ranges, wherever a node's many ends lie; a node's chunks then go through one hash in order.
    """
    ranges = ends.repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv")

    def joined(batches) -> Iterator[pa.RecordBatch]:
        last, first, held, size = None, 0, [], 0

        def chunk():
            return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["digest", "first", "chunk"])

        for batch in batches:
            for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (digest != last or size > CHUNK):
                    yield chunk()
                    held, size = [], 0
                if not held:
                    last, first = digest, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield chunk()

    def hashed(batches) -> Iterator[pa.RecordBatch]:
        last, sha = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], names=["digest", "ends_sha256"])

        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest == last:
                    sha.update(b"," + text.encode())
                    continue
                if sha:
                    yield row()
                last, sha = digest, hashlib.sha256(text.encode())
        if sha:
            yield row()

    chunks = ranges.select("digest", "conv").mapInArrow(joined, "digest binary, first long, chunk string")
    ordered_chunks = chunks.repartition(F.col("digest")).sortWithinPartitions("digest", "first").select("digest", "chunk")
    return ordered_chunks.mapInArrow(hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node; ``rebuild`` lets conversations share first turns (``rebuilt``) before."""
    spark = conversations.sparkSession
    turns = written(spark, ordered(conversations), "turns")
    convs = turns.select("conv").distinct()
    plain = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("at"), F.lit(ROOT).alias("turn"), F.lit(0).cast("long").alias("chars")).unionByName(turns.withColumn("part", F.lit(0)))
    paths = written(spark, prefixes(rebuilt(turns, convs) if rebuild else plain), "prefixes")
    groups = written(spark, paths.groupBy("depth", "digest").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")

    # every prefix with its node; along a conversation the node before is the parent
    met = dealt_join(paths, groups.drop("depth"), "digest", "conv")
    along = Window.partitionBy("conv").orderBy("depth")
    before = lambda c: F.lag(c).over(along)
    met = met.withColumns({"parent": before("digest"), "parent_rep": before("rep"), "parent_n": before("n"), "after": F.lead("depth").over(along)})
    top = F.when(F.col("parent_n").isNull() | (F.col("parent_n") != F.col("n")), F.col("digest"))  # members left: a new stretch
    met = met.withColumn("stretch", F.last(top, ignorenulls=True).over(along))
    met = written(spark, met.select("conv", "depth", "digest", "chars", "rep", "n", "parent", "parent_rep", "after", "stretch"), "paths")
    ends = met.where("after is null").select("digest", "conv")

    nodes = met.where("conv = rep")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n") - 1) * F.col("chars")
    nodes = nodes.join(children, "digest", "left").select("digest", "depth", "rep", "parent_rep", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), "stretch", saved.alias("saved"))
    nodes = written(spark, nodes, "trie-nodes")

    leaf = (F.col("n_children") == 0).cast("long")
    sums = nodes.groupBy("stretch").agg(F.min("rep").alias("rep"), F.sum(leaf).alias("leaves"), F.sum("saved").alias("saved"))
    # a stretch's smallest member is a member of every ancestor, so its path names them all
    lines = met.where("digest = stretch").groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "stretch"))), lambda x: x["stretch"]).alias("line"))
    up = sums.join(lines, sums["rep"] == lines["conv"]).select("leaves", "saved", F.explode(F.slice("line", F.lit(1), F.array_position("line", F.col("stretch")).cast("int"))).alias("stretch"))
    below = up.groupBy("stretch").agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))

    down = Window.partitionBy("stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("saved").over(down), F.lit(0))
    out = nodes.withColumn("passed", passed).join(below, "stretch").join(end_digests(ends), "digest", "left")
    return out.select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.col("parent_rep").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("n_children").cast("long").alias("n_children"),
        F.col("all_leaves").alias("n_leaves"),
        (F.col("all_saved") - F.col("passed")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
