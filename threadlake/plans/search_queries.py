"""Search over documents, and conversations as threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import postings as P
from ..operators import search as S
from ..operators import threads as T
from .registry import load, query

TOKS = "regexp_extract_all(translate(lower(coalesce(text, '')), '{0}', '{1}'), '[\\p{{L}}\\p{{N}}]+')".format(X.FOLD_FROM, X.FOLD_TO)
DOCS = f"WITH d AS (SELECT doc_id, lang, source, n_chars, {TOKS} AS toks FROM documents) "
JOINED = "' ' || array_to_string(toks, ' ') || ' '"


def docs(spark, sf):
    return S.corpus(load(spark, sf, "documents"), "text", X.tokens)


def index(spark, sf):
    """The documents' inverted index."""
    return P.opened(load(spark, sf, "documents"), "doc_id", {"text": X.tokens(F.col("text"))}, "documents")


def described(spark, sf, hits, *cols):
    """Hits with columns of their documents; the texts are not read."""
    return hits.join(load(spark, sf, "documents").select("doc_id", *cols), "doc_id")


def ids(df):
    return df.select("doc_id", "lang")


@query(DOCS + ", t AS (SELECT unnest(toks) AS t, doc_id FROM d) SELECT 'text' AS field, count(DISTINCT t) AS terms, count(DISTINCT (t, doc_id)) AS postings, count(*) AS tokens FROM t")
def search_index(spark, sf):
    """What the inverted index holds; it is built if these files have none yet."""
    return P.index_report(index(spark, sf))


@query(DOCS + "SELECT doc_id, lang FROM d WHERE list_contains(toks, 'the') AND list_contains(toks, 'was')")
def search_and(spark, sf):
    both = index(spark, sf).frequencies(["the", "was"]).where("tf0 > 0 and tf1 > 0").select(F.col("id").alias("doc_id"))
    return ids(described(spark, sf, both, "lang"))


@query(DOCS + "SELECT doc_id, lang FROM d WHERE list_contains(toks, 'thing') OR list_contains(toks, 'oui')")
def search_or(spark, sf):
    return ids(described(spark, sf, index(spark, sf).matching(["thing", "oui"]), "lang"))


@query(DOCS + "SELECT doc_id, lang FROM d WHERE list_contains(toks, 'the') AND NOT list_contains(toks, 'was')")
def search_not(spark, sf):
    return ids(docs(spark, sf).where(X.has_word(F.col("toks"), "the") & X.negated(X.has_word(F.col("toks"), "was"))))


@query(DOCS + f"SELECT doc_id, lang FROM d WHERE contains({JOINED}, ' of the ')")
def search_phrase(spark, sf):
    return ids(docs(spark, sf).where(X.has_phrase(F.col("toks"), ["of", "the"])))


@query(DOCS + "SELECT doc_id, lang FROM d WHERE len(list_filter(toks, lambda t: starts_with(t, 'than'))) > 0")
def search_prefix(spark, sf):
    return ids(docs(spark, sf).where(X.has_prefix(F.col("toks"), "than")))


@query(
    DOCS
    + """, p AS (SELECT doc_id, lang, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM d)
    SELECT DISTINCT a.doc_id, a.lang FROM p a JOIN p b USING (doc_id) WHERE a.t = 'the' AND b.t = 'are' AND abs(a.i - b.i) - 1 <= 3"""
)
def search_near(spark, sf):
    return ids(docs(spark, sf).where(X.near(F.col("toks"), "the", "are", 3)))


@query(DOCS + "SELECT doc_id, lang FROM d WHERE lang = 'fr' AND source IN ('src1', 'src2') AND list_contains(toks, 'une')")
def search_field(spark, sf):
    return ids(docs(spark, sf).where((F.col("lang") == "fr") & F.col("source").isin("src1", "src2") & X.has_word(F.col("toks"), "une")))


@query("SELECT doc_id, lang FROM documents WHERE n_chars >= 2 * 1024 AND n_chars < 4 * 1024")
def search_size(spark, sf):
    return load(spark, sf, "documents").where((F.col("n_chars") >= 2 * 1024) & (F.col("n_chars") < 4 * 1024)).select("doc_id", "lang")


def bm25_sql(words, extra=""):
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{w}')) AS f{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(words)))
    score = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    return DOCS + f", c AS (SELECT doc_id, lang, source, len(toks) AS dl, {tf} FROM d), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c), h AS (SELECT doc_id, lang, source, {score} AS score FROM c, s WHERE {some}) " + extra


WORDS = ["thing", "reand", "than"]


@query(bm25_sql(WORDS, "SELECT doc_id, round(score, 6) AS score FROM h ORDER BY round(score, 6) DESC, doc_id LIMIT 20"))
def search_bm25_topk(spark, sf):
    return index(spark, sf).top(WORDS, 20)


AGE = "(doc_id % 365)"


@query(bm25_sql(WORDS, f", r AS (SELECT doc_id, round(score / (SELECT max(score) FROM h) + 0.35 / (1 + {AGE} / 90.0), 6) AS score FROM h) SELECT * FROM r ORDER BY score DESC, doc_id LIMIT 20"))
def search_bm25_recency(spark, sf):
    """No table has dates for documents: a document's age stands in as doc_id mod 365 days."""
    hits = index(spark, sf).bm25(WORDS)
    best = hits.agg(F.max("score")).first()[0] or 1.0
    return hits.select("doc_id", F.round(F.col("score") / best + S.recency(F.col("doc_id") % 365), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(bm25_sql(WORDS, "SELECT source, arg_max(doc_id, (round(score, 6), doc_id)) AS doc_id, round(max(round(score, 6)) + 0.03 * ln(count(*)), 5) AS score, count(*) AS matches FROM h GROUP BY source"))
def search_group_best(spark, sf):
    hits = described(spark, sf, index(spark, sf).bm25(WORDS).withColumn("score", F.round("score", 6)), "source")
    return S.group_best(hits, "source", "doc_id").withColumn("score", F.round("score", 5))


@query(DOCS + "SELECT least(count(*), 50) AS n, count(*) > 50 AS more FROM (SELECT 1 FROM d WHERE list_contains(toks, 'the') LIMIT 51)")
def search_count_capped(spark, sf):
    return S.count_capped(docs(spark, sf).where(X.has_word(F.col("toks"), "the")), 50)


@query(DOCS + "SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (n_chars > 5000) AS long, count(*) FILTER (source = 'src0') AS src0 FROM d WHERE list_contains(toks, 'de') OR list_contains(toks, 'the')")
def search_facets(spark, sf):
    hits = described(spark, sf, index(spark, sf).matching(["de", "the"]), "lang", "source", "n_chars")
    return S.facets(hits, {"en": F.col("lang") == "en", "fr": F.col("lang") == "fr", "long": F.col("n_chars") > 5000, "src0": F.col("source") == "src0"})


@query(
    bm25_sql(["than"], "SELECT 0")[: -len("SELECT 0")].replace(" h AS", " h1 AS")
    + ", e1 AS (SELECT doc_id, score AS s FROM h1), c2 AS (SELECT doc_id, len(toks) AS dl, len(list_filter(toks, lambda t: t = 'thans')) AS f0 FROM d), s2 AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS d0 FROM c2), "
    "h2 AS (SELECT doc_id, 0.8 * greatest(1e-6, ln((n - d0 + 0.5) / (d0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM c2, s2 WHERE f0 > 0) "
    "SELECT doc_id, round(max(s), 6) AS score FROM (SELECT * FROM e1 UNION ALL SELECT * FROM h2) GROUP BY doc_id"
)
def search_variants_weighted(spark, sf):
    """The word itself at full weight, a variant of it at 0.8; the better counts."""
    d = index(spark, sf)
    exact, variant = d.bm25(["than"]), d.bm25(["thans"]).select("doc_id", (F.col("score") * 0.8).alias("score"))
    return exact.unionByName(variant).groupBy("doc_id").agg(F.round(F.max("score"), 6).alias("score"))


CHAT = "WITH m AS (SELECT *, role = 'assistant' AS sent, role = 'user' AS received FROM conversations) "


def sent():
    return F.col("role") == "assistant"


def received():
    return F.col("role") == "user"


@query("SELECT conv_id, arg_min(text, turn) FILTER (length(trim(coalesce(text, ''))) > 0) AS subject, arg_max(text, turn) AS snippet, count(*) AS messages, count(DISTINCT role) AS senders, max(turn) AS last_seq FROM conversations GROUP BY conv_id")
def thread_rollup(spark, sf):
    return T.rollup(load(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id HAVING count(*) BETWEEN 4 AND 6")
def thread_len_between(spark, sf):
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages")).where("messages between 4 and 6")


def states(spark, sf):
    return T.reply_states(load(spark, sf, "conversations"), "conv_id", "turn", sent(), received())


@query(CHAT + "SELECT conv_id, turn FROM m a WHERE received AND NOT EXISTS (SELECT 1 FROM m b WHERE b.conv_id = a.conv_id AND b.sent AND b.turn > a.turn)")
def reply_unanswered(spark, sf):
    return states(spark, sf).where("unanswered").select("conv_id", "turn")


@query(CHAT + "SELECT conv_id, turn FROM m a WHERE received AND EXISTS (SELECT 1 FROM m b WHERE b.conv_id = a.conv_id AND b.sent AND b.turn > a.turn)")
def reply_replied(spark, sf):
    return states(spark, sf).where("replied").select("conv_id", "turn")


@query(CHAT + "SELECT conv_id, turn FROM m a WHERE sent AND NOT EXISTS (SELECT 1 FROM m b WHERE b.conv_id = a.conv_id AND b.received AND b.turn > a.turn)")
def reply_awaiting(spark, sf):
    return states(spark, sf).where("awaiting").select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations a WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn)")
def reply_not_first(spark, sf):
    return states(spark, sf).where("reply").select("conv_id", "turn")


WAITS = (
    CHAT
    + ", b AS (SELECT *, coalesce(sum(sent::int) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM m), w AS (SELECT conv_id, min(turn) FILTER (received) AS received_at, max(turn) FILTER (sent) AS sent_at FROM b GROUP BY conv_id, blk) "
)


@query(WAITS + "SELECT conv_id, received_at, sent_at, sent_at - received_at AS wait FROM w WHERE sent_at > received_at")
def reply_waits(spark, sf):
    return T.waits(load(spark, sf, "conversations"), "conv_id", "turn", sent(), received())


@query(WAITS + ", r AS (SELECT sent_at - received_at AS wait, row_number() OVER (ORDER BY sent_at - received_at) AS k, count(*) OVER () AS n FROM w WHERE sent_at > received_at) SELECT wait AS median FROM r WHERE k = n // 2 + 1")
def reply_wait_median(spark, sf):
    return E.upper_median(reply_waits(spark, sf), "wait")


@query("WITH t AS (SELECT conv_id, count(*) AS messages, max(turn) AS last_seq FROM conversations GROUP BY conv_id) SELECT * FROM t WHERE last_seq < 6 ORDER BY last_seq DESC, conv_id DESC LIMIT 25")
def thread_page_keyset(spark, sf):
    t = load(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_seq"))
    return T.page(t, 6, 25, "last_seq", "conv_id")


@query(
    "WITH v AS (SELECT conv_id, turn, length(text) > 500 AS unread, 'inbox' AS view FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, length(text) > 500, 'sent' FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, length(text) > 500, 'all' FROM conversations) "
    "SELECT view, conv_id, max(turn) AS last_seq, coalesce(bool_or(unread), false) AS unread FROM v GROUP BY view, conv_id"
)
def view_membership(spark, sf):
    m = load(spark, sf, "conversations")
    return T.membership(m, "conv_id", "turn", {"inbox": received(), "sent": sent(), "all": F.lit(True)}, F.coalesce(F.length("text") > 500, F.lit(False)))
