"""Vectors, texts, evaluation and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import search as S
from ..operators import vectors as V
from ..session import shared_dir
from ..streaming import streams as Z
from ..streaming import threading as R
from ..streaming import upkeep as U
from .registry import load, query
from .search_queries import DOCS

ME = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, embedding, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE vec_id <> 0) "


def vectors(spark, sf):
    """All but vector 0, and vector 0 as the query."""
    v = load(spark, sf, "embeddings")
    return v.where("vec_id <> 0"), v.where("vec_id = 0").first()["embedding"]


@query(ME + "SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def knn_exact(spark, sf):
    v, q = vectors(spark, sf)
    return V.nearest(v, q, 10, "vec_id").select("vec_id", "score")


@query(ME + "SELECT vec_id, score FROM s WHERE label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered(spark, sf):
    v, q = vectors(spark, sf)
    return V.nearest(v, q, 10, "vec_id", where=F.col("label").isin(1, 2, 3)).select("vec_id", "score")


@query(ME + "SELECT vec_id // 5 AS doc, max(score) AS score, arg_min(vec_id, (-score, vec_id)) AS vec_id FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def knn_best_chunk(spark, sf):
    v, q = vectors(spark, sf)
    scored = v.select("vec_id", F.floor(F.col("vec_id") / 5).alias("doc"), F.round(V.dot(F.col("embedding"), V.vector(q)), 6).alias("score"))
    return V.best_chunk(scored, "doc", "vec_id", 10)


INT8 = "list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127"


@query(
    f"WITH c AS (SELECT vec_id, {INT8} AS scale, list_transform(embedding, lambda x: round(x::DOUBLE / ({INT8}))::INTEGER) AS codes FROM embeddings), q AS (SELECT codes AS qc, scale AS qs FROM c WHERE vec_id = 0), "
    "s AS (SELECT vec_id, round(list_dot_product(codes::DOUBLE[], qc::DOUBLE[]) * scale * qs, 6) AS score FROM c, q WHERE vec_id <> 0) SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10"
)
def knn_int8(spark, sf):
    """Both sides quantized to 8 bits with a scale each."""
    v = load(spark, sf, "embeddings").select("vec_id", V.int8(F.col("embedding")).alias("c"))
    q = v.where("vec_id = 0").first()["c"]
    score = V.dot(F.col("c.codes"), V.vector(q["codes"])) * F.col("c.scale") * F.lit(q["scale"])
    return v.where("vec_id <> 0").select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, len(list_filter(range(1, 65), lambda i: (embedding[i] > 0) <> (q[i] > 0))) AS distance FROM embeddings, q WHERE vec_id <> 0) SELECT vec_id, distance FROM s ORDER BY distance, vec_id LIMIT 10")
def knn_hamming(spark, sf):
    """Signs as one 64-bit number."""
    v, q = vectors(spark, sf)
    distance = F.bit_count(V.bits(F.col("embedding")).bitwiseXOR(V.bits(V.vector(q)))).cast("long")
    return v.select("vec_id", distance.alias("distance")).orderBy("distance", "vec_id").limit(10)


LISTS = ME + ", a AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM s QUALIFY rank <= 20) "


def two_lists(spark, sf):
    v, q = vectors(spark, sf)
    scored = v.select("vec_id", "label", F.round(V.dot(F.col("embedding"), V.vector(q)), 6).alias("score"), F.lit(0).alias("q"))
    a = S.ranked(scored.orderBy(F.desc("score"), "vec_id").limit(20), "q", "vec_id", 20)
    b = S.ranked(scored.orderBy(F.desc("label"), "vec_id").limit(20), "q", "vec_id", 20, score="label")
    return scored, a, b


@query(LISTS + "SELECT vec_id, round(sum(x), 8) AS score FROM (SELECT vec_id, 0.7 * 61 / (60 + rank) AS x FROM a UNION ALL SELECT vec_id, 0.3 * 61 / (60 + rank) FROM b) GROUP BY vec_id")
def rrf_fuse(spark, sf):
    _, a, b = two_lists(spark, sf)
    return S.rrf([(a, 0.7), (b, 0.3)], "vec_id").withColumn("score", F.round("score", 8))


@query(ME + ", m AS (SELECT vec_id, 0.7 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) + 0.3 * (label - min(label) OVER ())::DOUBLE / (max(label) OVER () - min(label) OVER ()) AS x FROM s) SELECT vec_id, round(x, 6) AS score FROM m ORDER BY round(x, 6) DESC, vec_id LIMIT 15")
def convex_fuse(spark, sf):
    scored, _, _ = two_lists(spark, sf)
    n = S.minmax(S.minmax(scored, "score", "s"), "label", "l")
    return n.select("vec_id", F.round(0.7 * F.col("s") + 0.3 * F.col("l"), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(15)


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS norm FROM events")
def minmax_norm(spark, sf):
    return S.minmax(load(spark, sf, "events"), "value", "n").select("event_id", F.round("n", 6).alias("norm"))


@query(DOCS + "SELECT doc_id, len(toks)::BIGINT AS n, len(list_distinct(toks))::BIGINT AS n_distinct, md5(array_to_string(toks, ' ')) AS digest FROM d")
def tokens_fold(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


_R = "regexp_replace"
HTML = f"{_R}({_R}({_R}(coalesce(html, ''), '(?is)<(script|style|head)\\b.*?</(script|style|head)>', ' ', 'g'), '(?i)<(/p|/div|/li|/tr|/h[1-6]|br)[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_e}', '{_c}')"
HTML = f"trim({_R}({_R}({HTML}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'))"


@query(f"SELECT page_id, md5({HTML}) AS digest, length({HTML}) AS n FROM pages")
def html_to_text_basic(spark, sf):
    t = load(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


@query("SELECT page_id, len(h)::BIGINT AS n, array_to_string(h, ' ') AS hrefs FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1) AS h FROM pages)")
def anchors(spark, sf):
    h = load(spark, sf, "pages").select("page_id", X.hrefs(F.col("html")).alias("h"))
    return h.select("page_id", F.size("h").cast("long").alias("n"), F.array_join("h", " ").alias("hrefs"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(regexp_replace(regexp_replace(url, '^[^/]*//[^/?#]*', ''), '#.*$', '')), '" + "|".join(X.SUBSCRIPTION_WORDS) + "') THEN url ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '(?i)([?&])(" + "|".join(X.TRACKERS) + ")=[^&#]*', '\\1', 'g'), '&&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+(#|$)', '\\1', 'g') END AS url FROM pages")
def url_strip_tracking(spark, sf):
    return load(spark, sf, "pages").select("page_id", X.without_tracking(F.col("url")).alias("url"))


@query("SELECT o_orderkey, printf('%.2f', round(o_totalprice, 2)) || ' ' || (o_orderkey % 1000)::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN ' 12.5' ELSE '' END AS amounts FROM orders")
def amounts_parse(spark, sf):
    """Sums in a line about each order: thousands, a decimal comma, a mark with a space; what has a letter behind is none."""
    o = load(spark, sf, "orders")
    key = F.col("o_orderkey")
    line = F.concat(F.lit("Paid $"), F.format_number(F.round("o_totalprice", 2), 2), F.lit(", fee € "), (key % 1000).cast("string"), F.lit(" not $5x"), F.when(key % 3 == 0, F.lit("; tip £12,5")).otherwise(F.lit("")))
    return o.select("o_orderkey", F.array_join(X.amounts(line), " ").alias("amounts"))


@query("WITH n AS (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 12, '0') AS s FROM orders) SELECT o_orderkey, s AS number FROM n WHERE list_sum(list_transform(range(12), lambda i: substr(s, 12 - i, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10 = 0")
def check_digit_mod10(spark, sf):
    n = load(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919).cast("string"), 12, "0").alias("number"))
    return n.where(X.mod10_ok(F.col("number")))


@query("SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x) <> ''))::BIGINT AS n FROM documents")
def sentence_split(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query(DOCS + ", w AS (SELECT doc_id, len(toks) AS n FROM d), c AS (SELECT doc_id, n, unnest(range(0, greatest(ceil((n - 90) / 100.0), 0)::INT + 1)) AS chunk FROM w WHERE n > 0), p AS (SELECT doc_id, n, chunk, greatest(ceil((n - 90) / 100.0), 0)::INT AS more FROM c), "
    "q AS (SELECT *, more > 0 AND n - 90 - (more - 1) * 100 < 8 AS merged FROM p), k AS (SELECT *, CASE WHEN merged THEN more - 1 ELSE more END + 1 AS cnt FROM q), "
    "s AS (SELECT *, CASE WHEN chunk = 0 THEN 0 ELSE 70 + (chunk - 1) * 100 END AS start FROM k WHERE chunk < cnt) "
    "SELECT doc_id, chunk::INT AS chunk, start::INT AS start, (CASE WHEN merged AND chunk = cnt - 1 THEN n ELSE least(CASE WHEN chunk = 0 THEN 90 ELSE start + 120 END, n) END - start)::INT AS length FROM s")  # fmt: skip
def chunk_windows(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.inline(X.chunk_words(F.col("t")))).select("doc_id", F.col("chunk").cast("int"), F.col("start").cast("int"), F.col("length").cast("int"))


@query(DOCS + ", v AS (SELECT unnest(list_distinct(toks)) AS term FROM d) SELECT term, count(*) AS df FROM v WHERE damerau_levenshtein(term, 'thign') = 1 AND regexp_full_match(term, '[a-z]+') GROUP BY term")
def edit1_candidates(spark, sf):
    """Words of the corpus one edit from a misspelt one: generated, then looked up."""
    d = load(spark, sf, "documents").select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return d.where(F.col("term").isin(X.edits1("thign"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


RUN = (
    "WITH q AS (SELECT item_id AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS term FROM benchmark), t AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS term FROM documents), "
    "s AS (SELECT query, doc, count(*) AS score FROM q JOIN t USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10), "
    "j AS (SELECT query, doc, quality AS grade FROM s JOIN labels ON doc_id = doc) "
)


#: Every labelled document judges every item, whether the item matches it or not.
WHOLE = RUN.replace("SELECT query, doc, quality AS grade FROM s JOIN labels ON doc_id = doc", "SELECT item_id AS query, doc_id AS doc, quality AS grade FROM benchmark, labels")


def matches(spark, sf):
    """Benchmark items as queries; a document scores by how many of an item's long words it has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{6,}"), F.lit(0)))
    q = load(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(words("text")).alias("term"))
    t = load(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.explode(words("text")).alias("term"))
    return q.join(t, "term").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("score"))


def run(spark, sf):
    return S.ranked(matches(spark, sf), "query", "doc", 10)


def judgments(spark, sf):
    """A pool: whatever an item matches and labels cover is judged by its quality."""
    return matches(spark, sf).join(load(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.col("quality").alias("grade")), "doc").select("query", "doc", "grade")


def labelled(spark, sf):
    """The judgments of every item: a label does not depend on the item, so pairs need not be listed."""
    return load(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.col("quality").alias("grade"))


@query(WHOLE + ", g AS (SELECT query, sum(coalesce(grade, 0) / log2(rank + 1)) AS dcg FROM r LEFT JOIN j USING (query, doc) GROUP BY query), i AS (SELECT query, sum(grade / log2(k + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS k FROM j WHERE grade > 0) WHERE k <= 10 GROUP BY query) SELECT query, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM g LEFT JOIN i USING (query)")
def ndcg_at_10(spark, sf):
    return E.ndcg(run(spark, sf), labelled(spark, sf), 10)


@query(RUN + "SELECT query, round(coalesce(1.0 / min(rank) FILTER (grade >= 1), 0)::DOUBLE, 6) AS rr FROM r LEFT JOIN j USING (query, doc) GROUP BY query")
def mrr(spark, sf):
    return E.reciprocal_rank(run(spark, sf), judgments(spark, sf), 1)


@query(RUN + ", f AS (SELECT query, count(*) FILTER (grade > 0) AS found FROM r LEFT JOIN j USING (query, doc) GROUP BY query), n AS (SELECT query, count(*) AS relevant FROM j WHERE grade > 0 GROUP BY query) SELECT query, round(found / least(relevant, 10), 6) AS recall FROM f JOIN n USING (query)")
def recall_capped(spark, sf):
    return E.recall(run(spark, sf), judgments(spark, sf), 10)


@query(WHOLE + "SELECT query, round(avg(CASE WHEN grade IS NULL THEN 0.0 ELSE 1.0 END), 6) AS judged FROM r LEFT JOIN j USING (query, doc) GROUP BY query")
def judged_at_10(spark, sf):
    return E.judged(run(spark, sf), labelled(spark, sf), 10)


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT max(value) FILTER (k = greatest(ceil(n * 0.5), 1)) AS p50, max(value) FILTER (k = greatest(ceil(n * 0.95), 1)) AS p95, max(value) FILTER (k = greatest(ceil(n * 0.99), 1)) AS p99 FROM r")
def percentile_nearest(spark, sf):
    return E.nearest_rank(load(spark, sf, "events"), "value", [0.5, 0.95, 0.99])


@query(RUN + ", b AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) AS rank FROM s QUALIFY rank <= 10) SELECT query, doc, r.rank AS rank_a, b.rank AS rank_b FROM r FULL JOIN b USING (query, doc) WHERE r.rank IS DISTINCT FROM b.rank")
def run_diff(spark, sf):
    """The run against one that breaks ties the other way."""
    r = load(spark, sf, "benchmark").sparkSession
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{6,}"), F.lit(0)))
    q = load(r, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(words("text")).alias("term"))
    t = load(r, sf, "documents").select((-F.col("doc_id")).alias("doc"), F.explode(words("text")).alias("term"))
    other = S.ranked(q.join(t, "term").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("score")), "query", "doc", 10)
    return E.run_diff(run(spark, sf), other.withColumn("doc", -F.col("doc")))


def stream(spark, sf):
    return Z.stream(load(spark, sf, "events").sparkSession, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


STAMP = "yyyy-MM-dd HH:mm:ss"


def shown(df, window="window"):
    return df.select(F.date_format(f"{window}.start", STAMP).alias("starts"), *[c for c in df.columns if c != window])


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS starts, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    return shown(Z.drained(Z.tumbling(stream(spark, sf), "ts", "1 day", ["event_type"], "2 days"), "update", "tumbling", ["window", "event_type"])).withColumn("total", F.round("total", 3))


@query("SELECT strftime(h - INTERVAL (k) HOUR, '%Y-%m-%d %H:%M:%S') AS starts, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS h, unnest([0, 6]) AS k FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf):
    """Windows of 12 hours every 6."""
    return shown(Z.drained(Z.tumbling(stream(spark, sf), "ts", "12 hours", ["event_type"], "2 days", "6 hours"), "update", "sliding", ["window", "event_type"])).withColumn("total", F.round("total", 3))


@query("WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS starts, user_id, count(*) AS n FROM g GROUP BY user_id, k")
def stream_session(spark, sf):
    """Sessions are appended once the watermark has closed them; a last row of nobody closes those that are open at the end."""
    rows = stream(spark, sf).select("ts", "user_id")
    end = [(datetime.datetime(9000, 1, 1), None)]
    return shown(Z.closed(lambda e: Z.sessions(e, "ts", "6 hours", ["user_id"], "2 days"), rows, end, "session"), "session_window")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    return Z.drained(Z.first_only(stream(spark, sf), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "append", "dedup")


RULES = "WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' AND value > 90 THEN 'large' END AS a, CASE WHEN event_type = 'error' THEN 'failed' END AS b, CASE WHEN value > 80 AND NOT coalesce(event_type = 'purchase' AND value > 90, false) THEN 'high' END AS c FROM events), f AS (SELECT event_id, user_id, ts, unnest([a, b, c]) AS rule FROM m) "


def fired(spark, sf):
    rules = [("large", (F.col("event_type") == "purchase") & (F.col("value") > 90), True), ("failed", F.col("event_type") == "error", False), ("high", F.col("value") > 80, False)]
    return Z.standing_queries(stream(spark, sf), rules)


@query(RULES + "SELECT rule, event_id FROM f WHERE rule IS NOT NULL")
def stream_rules_claim(spark, sf):
    """Rules in order, the first of which stops the others; each fires once for a message."""
    return Z.drained(Z.claims(fired(spark, sf), ["rule", "event_id"], "ts", "60 days").select("rule", "event_id"), "append", "claims")


@query(RULES + "SELECT rule, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS starts, count(*) AS n, count(*) > 60 AS paused FROM f WHERE rule IS NOT NULL GROUP BY 1, 2")
def stream_rate_breaker(spark, sf):
    return shown(Z.drained(Z.breaker(fired(spark, sf).withWatermark("ts", "2 days"), "rule", "ts", "1 day", 60), "update", "breaker", ["window", "rule"]))


@query("SELECT user_id, arg_max(body, (event_type = 'purchase', event_id % 7, value, ts, body)) AS body FROM (SELECT *, event_id::VARCHAR AS body FROM events) GROUP BY user_id")
def stream_lww(spark, sf):
    """Records merge to the largest of (terminal, generation, phase, clock, body)."""
    r = stream(spark, sf).select("user_id", (F.col("event_type") == "purchase").alias("terminal"), (F.col("event_id") % 7).alias("gen"), F.col("value").alias("phase"), F.col("ts").alias("at"), F.col("event_id").cast("string").alias("body"))
    return Z.drained(Z.merge_records(r, "user_id", F.col("terminal")), "update", "lww", ["user_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_upsert(spark, sf):
    """The last copy of each key, kept in a table of which every micro-batch rewrites the buckets it touches."""
    table = Z.Table(spark, shared_dir(spark, "upsert"), ["user_id", "event_type"])
    rows = stream(spark, sf).select("user_id", "event_type", "event_id")
    Z.batches(rows, "upsert", lambda batch, epoch: Z.upsert(table, batch, [F.desc("event_id")], epoch))
    return table.read()


FEED = "SELECT event_id // 3 AS id, arg_max(user_id, event_id) AS thread, arg_max(value > 50, event_id) AS unread, arg_max(ts, event_id) AS moment, arg_max(event_type = 'error', event_id) AS gone FROM events GROUP BY 1"


@query(f"SELECT thread, count(*) AS n, count(*) FILTER (unread) AS unread_n, strftime(min(moment), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(moment), '%Y-%m-%d %H:%M:%S') AS last FROM ({FEED}) WHERE NOT gone GROUP BY thread")
def thread_figures_kept(spark, sf):
    """Threads' figures kept by a feed of changes: events in threes tell of one message, the later one counts, an error deletes it."""
    e = load(spark, sf, "events")
    feed = e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 3).alias("id"), F.col("user_id").alias("thread"), (F.col("value") > 50).alias("unread"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("deleted"))
    box = U.Mailbox(spark, shared_dir(spark, "mailbox"), "id", ["id", "thread", "unread", "at"]).keep("threads", ["thread"], {"unread_n": F.col("unread").cast("long")}, "at")
    lo, hi = feed.agg(F.min("seq"), F.max("seq")).first()
    for batch in range(3):
        box.apply(feed.where(F.floor((F.col("seq") - lo) * 3 / (hi - lo + 1)) == batch), batch)
    kept = box.figures["threads"][0].read()
    return kept.select("thread", "n", "unread_n", *[F.date_format(c, STAMP).alias(c) for c in ("first", "last")])


@query(
    "WITH m AS (SELECT user_id, event_type, event_id, epoch_ms(ts) AS ms, event_id::VARCHAR AS id, value > 60 AND value <= 180 AS late FROM events), "
    "p AS (SELECT *, lag(id) OVER w AS parent, ms - lag(ms) OVER w AS gap FROM m WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ms, id)) SELECT id, parent FROM p WHERE late AND gap <= 7 * 86400000"
)
def stream_late_replies(spark, sf):
    """Headerless replies find their parents by subject, in state with a timer; edges are kept in a keyed table."""
    m = stream(spark, sf).withColumn("subject", F.concat(F.when(F.col("value") > 60, "Odp: FW:  ").otherwise(""), F.upper("event_type")))
    table = Z.Table(spark, shared_dir(spark, "edges"), ["account", "id"])

    def put(batch, epoch):
        Z.upsert(table, batch.withColumn("epoch", F.lit(epoch)), [F.desc("epoch")], epoch)

    Z.batches(R.reply_edges(R.keyed(m, "user_id", "subject", "ts", "event_id", F.col("value") > 180), "60 days"), "late-replies", put)
    return table.read().where("parent is not null").select("id", "parent")
