"""A persisted inverted index: a search reads the blocks of its own words and no text.

Layout below the index's folder:

* ``postings/bucket=<b>/``: rows (field, term, slab, n, tokens, max_tf, min_dl, best_tf, best_dl, postings). A bucket is a hash of the
  term, so a query's buckets are known when it is planned (partition pruning), and inside a bucket rows are sorted by term, so the
  statistics of row groups leave out the rest (pushed filter). A slab is a hash of the document's identifier; a row holds one
  term's postings of one slab, some thousands at most, however frequent the term is.
* ``stats/``: one row, how many rows and tokens there are.

The small columns in front bound what a block can score: ``max_tf`` and ``min_dl`` from above, ``best_tf`` and ``best_dl`` are a posting
that is there. ``top`` reads these first and then only the postings of blocks that can still reach the first k.

Rows with a null identifier are not indexed. Null or empty texts have no terms and count as texts of no length. Of rows that repeat an
identifier the tokens are taken together, and the longest length counts. An empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_base, written
from .search import B, FLOOR, K1

BUCKETS = 32
#: Documents of a slab, on average.
SLAB = 4096
#: Slabs of a bucket that one task writes.
SLABS_A_TASK = 64
#: A length of texts by which the posting of a block is chosen that ``best_tf`` and ``best_dl`` tell of; any posting would be right.
NOMINAL = 256


def built(rows: DataFrame, ident: str, fields: dict[str, Column], path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of ``rows``; ``fields`` are columns of tokens. The length of a row is that of all its fields."""
    spark = rows.sparkSession
    plain = {f: F.coalesce(c, F.array().cast("array<string>")) for f, c in fields.items()}
    known = rows.where(F.col(ident).isNotNull())
    n, copies = known.agg(F.count_distinct(ident), F.count(F.lit(1))).first()
    slabs = max(1, -(-copies // SLAB))
    # texts are dealt by slab once; words are counted and postings gathered where they are, and only whole blocks move again
    slab = F.pmod(F.xxhash64(F.col(ident)), F.lit(slabs)).cast("int")
    dealt = known.withColumn("__slab", slab).repartition(slabs, "__slab")
    narrow = dealt.select(F.col("__slab").alias("slab"), F.col(ident).alias("id"), F.array(*[F.struct(F.lit(f).alias("field"), c.alias("toks")) for f, c in plain.items()]).alias("fields"))
    narrow = narrow.withColumn("dl", F.aggregate("fields", F.lit(0), lambda a, x: a + F.size(x["toks"])))
    counted = narrow.select("slab", "id", "dl", F.explode("fields").alias("f")).select("slab", "id", "dl", "f.field", F.explode("f.toks").alias("term"))
    counted = counted.groupBy("slab", "id", "field", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("dl").alias("dl"))
    posting = F.struct("id", "tf", "dl")
    fit = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(NOMINAL))))
    blocks = counted.groupBy("slab", "field", "term").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.sum("tf").alias("tokens"),
        F.max("tf").alias("max_tf"),
        F.min("dl").alias("min_dl"),
        F.max_by(F.struct("tf", "dl"), fit).alias("best"),
        F.array_sort(F.collect_list(posting)).alias("postings"),
    )
    blocks = blocks.select("field", "term", "slab", "n", "tokens", "max_tf", "min_dl", F.col("best.tf").alias("best_tf"), F.col("best.dl").alias("best_dl"), "postings", bucket_of(F.col("term"), buckets).alias("bucket"))
    # numbers travel as three plain arrays, which are less than half of an array of structs
    flat = blocks.select("*", F.col("postings.id").alias("ids"), F.col("postings.tf").alias("tfs"), F.col("postings.dl").alias("dls")).drop("postings")
    moved = flat.repartition("bucket", F.floor(F.col("slab") / SLABS_A_TASK)).sortWithinPartitions("bucket", "term", "field", "slab")
    zipped = F.transform(F.arrays_zip("ids", "tfs", "dls"), lambda z: F.struct(z["ids"].alias("id"), z["tfs"].alias("tf"), z["dls"].alias("dl")))
    moved = moved.withColumn("postings", zipped).drop("ids", "tfs", "dls")
    moved.write.partitionBy("bucket").parquet(f"{path}/postings")
    tokens = spark.read.schema("tokens long").parquet(f"{path}/postings").agg(F.sum("tokens")).first()[0]
    spark.createDataFrame([(n, int(tokens or 0), buckets)], "n long, tokens long, buckets int").coalesce(1).write.parquet(f"{path}/stats")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def signature(rows: DataFrame) -> str:
    """Of the files behind a table: names, sizes and times of change, of which one number comes to the driver."""
    files = rows.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
    return str(files.agg(F.bit_xor("h"), F.count(F.lit(1))).first())


def opened(rows: DataFrame, ident: str, fields: dict[str, Column], name: str) -> Index:
    """The index of a table of files, found in the shared folder, or made there if these very files have none yet."""
    spark = rows.sparkSession
    base = shared_base(spark)
    key = hashlib.sha256(f"{name} {ident} {sorted(fields)} {signature(rows)}".encode()).hexdigest()[:24]
    pointer = f"{base}/index-{key}/current"
    if (path := pointed(spark, pointer)) is None:
        path = f"{base}/index-{key}/{uuid.uuid4().hex}"
        built(rows, ident, fields, path)
        try:
            spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("errorifexists").parquet(pointer)
        except AnalysisException:  # somebody else was first: theirs counts
            path = pointed(spark, pointer)
    return Index(spark, path, ident)


def pointed(spark: SparkSession, pointer: str) -> str | None:
    try:
        found = spark.read.schema("path string").parquet(pointer).first()
    except AnalysisException:
        return None
    return found[0] if found else None


class Index:
    """An index that is there; every method reads the pruned blocks alone."""

    def __init__(self, spark: SparkSession, path: str, ident: str):
        self.spark, self.path, self.ident = spark, path, ident
        self.n, tokens, self.buckets = spark.read.parquet(f"{path}/stats").first()
        self.mean = tokens / self.n if self.n and tokens else 1.0
        self.blocks = spark.read.parquet(f"{path}/postings") if tokens else None

    def of(self, words: list[str], fields: list[str] | None = None) -> DataFrame:
        """The blocks of these words."""
        if self.blocks is None:
            kind = "field string, term string, slab int, n int, tokens long, max_tf int, min_dl int, best_tf int, best_dl int, postings array<struct<id:bigint,tf:int,dl:int>>, bucket int"
            return self.spark.createDataFrame([], kind)
        of_word = reduce(lambda a, b: a | b, [(F.col("bucket") == bucket_of(F.lit(w), self.buckets)) & (F.col("term") == w) for w in words])
        # said apart, so that each can be pushed down by itself
        found = self.blocks.where(F.col("bucket").isin([bucket_of(F.lit(w), self.buckets) for w in words]) & F.col("term").isin(words) & of_word)
        return found if fields is None else found.where(F.col("field").isin(fields))

    def postings(self, words: list[str], fields: list[str] | None = None) -> DataFrame:
        """(field, term, id, tf, dl)"""
        return self.of(words, fields).select("field", "term", F.explode("postings").alias("p")).select("field", "term", "p.*")

    def matching(self, words: list[str], fields: list[str] | None = None) -> DataFrame:
        """The identifiers of rows that have any of the words."""
        return self.postings(words, fields).select(F.col("id").alias(self.ident)).distinct()

    def frequencies(self, words: list[str], weights: dict[str, float] | None = None, blocks: DataFrame | None = None) -> DataFrame:
        """(id, dl, tf0, tf1, ...) of rows with any of the words; with ``weights`` a word's frequency is the weighted sum over these fields."""
        rows = self.postings(words, list(weights) if weights else None) if blocks is None else blocks.select("field", "term", F.explode("postings").alias("p")).select("field", "term", "p.*")
        tf = F.col("tf") if weights is None else reduce(lambda w, f: w.when(F.col("field") == f[0], F.col("tf") * F.lit(float(f[1]))), list(weights.items())[1:], F.when(F.col("field") == next(iter(weights)), F.col("tf") * F.lit(float(next(iter(weights.values()))))))
        return rows.groupBy("id").agg(F.max("dl").alias("dl"), *[F.coalesce(F.sum(F.when(F.col("term") == w, tf)), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(words)])

    def idf(self, df: int) -> Column:
        return F.greatest(F.lit(FLOOR), F.log(F.lit((self.n - df + 0.5) / (df + 0.5))))

    def score(self, counts: list[int]) -> Column:
        """BM25 of rows of ``frequencies``."""
        total = F.lit(0.0)
        for i, df in enumerate(counts):
            f = F.col(f"tf{i}")
            total += self.idf(df) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(self.mean)))
        return total

    def bm25(self, words: list[str], weights: dict[str, float] | None = None) -> DataFrame:
        """(ident, score) of every row with any of the words."""
        found = self.frequencies(words, weights)
        if weights is None:
            sums = {r["term"]: r["n"] for r in self.of(words).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a word
            counts = [sums.get(w, 0) for w in words]
        else:
            counts = list(found.agg(*[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(words))]).first())
        return found.select(F.col("id").alias(self.ident), self.score(counts).alias("score"))

    def reach(self, tf: str, dl: str) -> Column:
        """The part of BM25 that a posting of this frequency and length has; more with a larger tf, less with a larger dl."""
        f = F.col(tf)
        return f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(dl) / F.lit(self.mean)))

    def top(self, words: list[str], k: int, digits: int = 6) -> DataFrame:
        """The first k by (score, rounded; ident) of an index of one field; blocks that cannot reach them are not read.

        The k-th largest score that blocks of one word are known to hold is one that k rows have. A block is left out if its word's
        bound and the other words' bounds together stay below that: none of its rows can be among the first k.
        """
        heads = self.of(words).select("term", "n", self.reach("max_tf", "min_dl").alias("most"), self.reach("best_tf", "best_dl").alias("least"))
        at = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("least")))
        kth = {r["term"]: r["least"] for r in heads.select("term", "least", at.alias("at")).where(F.col("at") <= k).where(F.col("at") == k).collect()}
        known = {r["term"]: (r["n"], r["most"]) for r in heads.groupBy("term").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect()}
        counts = [known.get(w, (0, 0.0))[0] for w in words]
        weight = {w: max(FLOOR, math.log((self.n - c + 0.5) / (c + 0.5))) for w, c in zip(words, counts, strict=True)}
        floor = max((weight[t] * x for t, x in kth.items()), default=0.0)
        bound = {w: weight[w] * known.get(w, (0, 0.0))[1] for w in words}
        rest = {w: sum(b for v, b in bound.items() if v != w) for w in words}
        blocks = self.of(words)
        if floor > 0:
            can = reduce(lambda a, b: a | b, [(F.col("term") == w) & (self.reach("max_tf", "min_dl") * weight[w] + rest[w] >= floor * (1 - 1e-9) - 10.0**-digits) for w in words])
            blocks = blocks.where(can)
        found = self.frequencies(words, None, blocks)
        return found.select(F.col("id").alias(self.ident), F.round(self.score(counts), digits).alias("score")).orderBy(F.desc("score"), self.ident).limit(k)


def index_report(index: Index) -> DataFrame:
    """What an index holds: rows, tokens, distinct terms and postings by field."""
    if index.blocks is None:
        return index.spark.createDataFrame([], "field string, terms long, postings long, tokens long")
    each = index.blocks.select("field", "term", "n", F.col("tokens").alias("t"))
    return written(each.groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "terms").groupBy("field").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("postings"), F.sum("t").alias("tokens"))
