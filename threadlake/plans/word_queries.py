"""Word variants and passages, over the documents' index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passages as G
from ..operators import variants as W
from .registry import load, query
from .search_queries import DOCS, WORDS, index

VOCABULARY = DOCS + ", v AS (SELECT w AS word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(toks)) AS w FROM d) GROUP BY 1) "


@query(
    VOCABULARY.replace("WITH d", "WITH RECURSIVE d")
    + """, k AS (SELECT word, df FROM v WHERE df >= 10 AND length(word) >= 3), t AS (SELECT count(*) AS n FROM documents),
    q AS (SELECT word FROM v WHERE df = 1 AND length(word) >= 6),
    p AS (SELECT q.word, a AS at_, k.word AS piece, k.df FROM (SELECT word, unnest(range(0, length(word) - 2)) AS a FROM q) q JOIN k ON substr(q.word, a + 1, length(k.word)) = k.word AND k.word <> q.word),
    r AS (SELECT word, 0 AS e, 0.0::DOUBLE AS s, '' AS path FROM q UNION ALL SELECT r.word, e + length(piece), round(s + ln(df / n), 9), trim(path || ' ' || piece) FROM r JOIN p ON p.word = r.word AND p.at_ = r.e, t),
    b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, path) AS k FROM r WHERE e = length(word))
    SELECT word, path AS split FROM b WHERE k = 1"""
)
def words_segmented(spark, sf):
    """Words that one text alone has, taken apart into words that ten or more have."""
    ix = index(spark, sf)
    v = W.vocabulary(ix)
    return W.segmented(v.where((F.col("df") == 1) & (F.length("word") >= 6)).select("word"), v.where((F.col("df") >= 10) & (F.length("word") >= W.PIECE)), ix.n)


RULES = ", ".join(f"('{a}', '{b}')" for x, y in W.ENDINGS for a, b in ((x, y), (y, x)))


@query(
    VOCABULARY
    + f", e AS (SELECT * FROM (VALUES {RULES}) AS e(a, b)), f AS (SELECT DISTINCT word, left(word, (length(word) - length(a))::BIGINT) || b AS form FROM v, e WHERE ends_with(word, a) AND length(word) >= 3 + length(a)) SELECT f.word, form, v.df FROM f JOIN v ON v.word = form WHERE form <> f.word"
)
def word_forms(spark, sf):
    """Every word of the vocabulary with its forms that the vocabulary has, too."""
    v = W.vocabulary(index(spark, sf))
    return W.variants(v.select("word"), v)


@query(
    VOCABULARY
    + """, q AS (SELECT word AS query, left(word, 4) AS stem FROM v WHERE df >= 40 AND length(word) >= 4), c AS (SELECT q.query, v.word, v.df FROM q JOIN v ON left(v.word, 4) = q.stem AND v.word <> q.query AND v.df >= 3),
    o AS (SELECT q.query, x.word FROM q, (VALUES ('the'), ('der'), ('les')) AS x(word)), t AS (SELECT doc_id, unnest(list_distinct(toks)) AS w FROM d),
    g AS (SELECT DISTINCT o.query, t.doc_id FROM o JOIN t ON t.w = o.word), m AS (SELECT c.query, c.word, count(DISTINCT t.doc_id) AS together FROM c JOIN t ON t.w = c.word JOIN g ON g.query = c.query AND g.doc_id = t.doc_id GROUP BY 1, 2)
    SELECT query, word, df, together FROM (SELECT c.query, c.word, c.df, coalesce(together, 0) AS together, row_number() OVER (PARTITION BY c.query ORDER BY coalesce(together, 0) DESC, c.df DESC, c.word) AS k FROM c LEFT JOIN m USING (query, word)) WHERE k = 1"""
)
def respelled_by_company(spark, sf):
    """Each frequent word as a query beside three more words; of the words that begin like it the one that shares most texts with those."""
    ix = index(spark, sf)
    v = W.vocabulary(ix)
    q = v.where((F.col("df") >= 40) & (F.length("word") >= 4)).select(F.col("word").alias("query"), F.left("word", F.lit(4)).alias("stem"))
    c = v.where("df >= 3").withColumn("stem", F.left("word", F.lit(4)))
    others = q.select("query", F.explode(F.array(*[F.lit(w) for w in ("the", "der", "les")])).alias("word"))
    return W.respelled_alike(ix, c, q, others, "query", "word", "stem").select("query", "word", "df", "together")


@query()
def best_passages(spark, sf):
    """The first twenty hits of a search, each with the passage that covers most of the query's weight."""
    ix = index(spark, sf)
    counts = {r["term"]: r["n"] for r in ix.of(WORDS).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a word
    weights = {w: spark.range(1).select(ix.idf(counts.get(w, 0))).first()[0] for w in WORDS}
    return G.best_passages(ix.top(WORDS, 20), load(spark, sf, "documents"), "doc_id", "text", weights)
