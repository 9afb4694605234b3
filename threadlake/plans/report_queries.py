"""Scopes, labels, panels, reports and the rest of the retrieval chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intervals as I
from ..operators import people as P
from ..operators import search as S
from ..operators import threads as T
from ..operators import vectors as V
from .content_queries import ME, vectors
from .registry import load, query
from .search_queries import bm25_sql, DOCS, docs, index, WORDS

NOW = "timestamp_ntz'2024-01-31'"


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def search_date_range(spark, sf):
    """Half open; the predicate reaches the Parquet scan."""
    return load(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-12'").select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 3 DAY")
def search_newer_than(spark, sf):
    return load(spark, sf, "events").where(f"ts >= {NOW} - interval 3 days").select("event_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src4') AND lang = 'de'")
def search_account_scope(spark, sf):
    return load(spark, sf, "documents").where(F.col("source").isin("src1", "src4") & (F.col("lang") == "de")).select("doc_id")


@query("SELECT d.doc_id, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 1")
def search_label(spark, sf):
    return load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels").where("quality = 1 and toxic = 1"), "doc_id").select("doc_id", "toxic")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), '1') AND contains(lower(p_name), '7')")
def search_filename(spark, sf):
    """Every word is somewhere in one name."""
    name = F.lower("p_name")
    return load(spark, sf, "part").where(name.contains("1") & name.contains("7")).select("p_partkey")


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE length(text) > 3000)")
def hidden_scope(spark, sf):
    """System messages are hidden, and threads with a discarded message are left out."""
    m = load(spark, sf, "conversations")
    return m.where("role <> 'system'").join(m.where("length(text) > 3000").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def thread_read(spark, sf):
    m = load(spark, sf, "conversations")
    return m.where(F.col("conv_id") == F.lit(m.agg(F.min("conv_id")).first()[0])).select("conv_id", "turn", "role")


@query("SELECT n_name, coalesce(n, 0) AS n, coalesce(unread, 0) AS unread FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS unread FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def label_unread_counts(spark, sf):
    """Every label with its counts, also those without messages."""
    counts = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("unread"))
    n = load(spark, sf, "nation")
    return n.join(counts, n["n_nationkey"] == counts["c_nationkey"], "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("unread", F.lit(0)).alias("unread"))


@query("SELECT source, count(*) AS messages, count(text) AS bodies, count(*) FILTER (n_chars > 2000) AS long FROM documents GROUP BY source")
def body_coverage(spark, sf):
    return load(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("messages"), F.count("text").alias("bodies"), F.count_if(F.col("n_chars") > 2000).alias("long"))


@query("SELECT user_id % 5 AS account, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 50) AS large, count(*) FILTER (ts >= TIMESTAMP '2024-01-29') AS fresh FROM events GROUP BY 1")
def triage_counts(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy((F.col("user_id") % 5).alias("account")).agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 50).alias("large"), F.count_if(F.expr("ts >= timestamp_ntz'2024-01-29'")).alias("fresh"))


@query(DOCS + "SELECT source, count(DISTINCT lang) AS threads, max(doc_id) AS latest FROM d WHERE list_contains(toks, 'thing') GROUP BY source ORDER BY threads DESC, latest DESC LIMIT 8")
def who_writes_about(spark, sf):
    hits = docs(spark, sf).where(X.has_word(F.col("toks"), "thing"))
    return hits.groupBy("source").agg(F.count_distinct("lang").alias("threads"), F.max("doc_id").alias("latest")).orderBy(F.desc("threads"), F.desc("latest")).limit(8)


@query(
    DOCS
    + ", p AS (SELECT doc_id, toks, list_position(toks, 'than') AS p, len(toks) AS n FROM d), s AS (SELECT doc_id, list_slice(toks, greatest(least(p - 16, n - 31), 1), greatest(least(p - 16, n - 31), 1) + 31) AS w FROM p WHERE p > 0) SELECT doc_id, array_to_string(list_transform(w, lambda t: CASE WHEN t = 'than' THEN '<mark>than</mark>' ELSE t END), ' ') AS snippet FROM s"
)
def snippets(spark, sf):
    return docs(spark, sf).select("doc_id", X.snippet(F.col("toks"), "than").alias("snippet")).where("snippet is not null")


@query(bm25_sql(WORDS, ", a AS (SELECT doc_id, score / (SELECT max(score) FROM h) AS s, doc_id % 365 AS age FROM h), b AS (SELECT doc_id, round(s + 0.3 * exp(-power(greatest(30 - age, age - 60, 0), 2) / (2 * 15.0 * 15.0)), 6) AS score FROM a) SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 20"))
def search_soft_date(spark, sf):
    """A date in the query that need not hold: ages of 30 to 60 days fit fully."""
    hits = index(spark, sf).bm25(WORDS)
    best = hits.agg(F.max("score")).first()[0] or 1.0
    fit = S.soft_date_fit((F.col("doc_id") % 365).cast("double"), 30, 60)
    return hits.select("doc_id", F.round(F.col("score") / best + fit, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(
    "WITH s AS (SELECT user_id, count(*) AS sent FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT event_id, round(0.35 / (1 + date_diff('day', ts::DATE, DATE '2024-01-31') / 90.0) + CASE WHEN value > 90 THEN 0.10 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 0.03 ELSE 0 END + least(0.12, ln(1 + coalesce(sent, 0)) * 0.03) + CASE WHEN user_id = 7 THEN 0.30 ELSE 0 END, 6) AS prior "
    "FROM events LEFT JOIN s USING (user_id) WHERE event_type = 'view'"
)
def ranking_prior(spark, sf):
    e = load(spark, sf, "events")
    sent = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("sent"))
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date"))
    p = S.prior(S.recency(age), F.col("value") > 90, F.col("event_id") % 2 == 0, F.coalesce("sent", F.lit(0)), F.col("user_id") == 7)
    return e.where("event_type = 'view'").join(sent, "user_id", "left").select("event_id", F.round(p, 6).alias("prior"))


@query(ME + ", a AS (SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 30), b AS (SELECT vec_id, label / 9.0 AS score FROM s WHERE label >= 7) SELECT vec_id, round(0.5 * coalesce(b.score, 0) + 0.5 * coalesce(a.score, 0), 6) AS score FROM a FULL JOIN b USING (vec_id)")
def hybrid_fused(spark, sf):
    """Two candidate lists, of which either may miss what the other has."""
    v, q = vectors(spark, sf)
    sem = V.nearest(v, q, 30, "vec_id").select("vec_id", "score")
    kw = v.where("label >= 7").select("vec_id", (F.col("label") / 9.0).alias("score"))
    return S.fused(kw, sem, "vec_id", 0.5).withColumn("score", F.round("score", 6))


@query(
    "WITH a AS (SELECT doc_id, md5(text) AS sig FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN 'old' ELSE md5(text) END AS sig FROM documents WHERE doc_id % 10 <> 4) "
    "SELECT * FROM (SELECT doc_id, CASE WHEN b.sig IS NULL THEN 'add' WHEN a.sig IS NULL THEN 'delete' WHEN a.sig <> b.sig THEN 'replace' END AS action FROM a FULL JOIN b USING (doc_id)) WHERE action IS NOT NULL"
)
def index_sweep(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("sig"))
    old = d.where("doc_id % 10 <> 4").withColumn("sig", F.when(F.col("doc_id") % 10 == 5, F.lit("old")).otherwise(F.col("sig")))
    return S.sweep(d.where("doc_id % 10 <> 3"), old, "doc_id", "sig")


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def notification_batches(spark, sf):
    """Three or more of one person in an hour become one."""
    return load(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")).where("n >= 3")


@query("SELECT user_id, event_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-28' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2")
def codes_recent(spark, sf):
    """The newest two of each person within the last days."""
    e = load(spark, sf, "events").where("event_type = 'signup' and ts >= timestamp_ntz'2024-01-28'")
    return T.newest_per_key(e, "user_id", [F.desc("ts"), F.desc("event_id")], 2).select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2001-06-02' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey LIMIT 50")
def invites_open(spark, sf):
    """Open requests of the last 60 days that were not turned down, soonest first."""
    o = load(spark, sf, "orders").where("o_orderstatus = 'O' and o_orderdate >= timestamp_ntz'2001-06-02'")
    refused = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(refused, "o_orderkey", "left_anti").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_custkey", "o_orderkey")


@query("SELECT conv_id, min(turn) AS wake FROM conversations WHERE (turn * 7 + conv_id) % 5 = 0 AND turn > 1 GROUP BY conv_id")
def snoozed_due(spark, sf):
    """Threads whose time to come back has passed, with the earliest such time."""
    return load(spark, sf, "conversations").where("(turn * 7 + conv_id) % 5 = 0 and turn > 1").groupBy("conv_id").agg(F.min("turn").alias("wake"))


@query("(SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-03') INTERSECT (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-03')")
def people_intersection(spark, sf):
    e = load(spark, sf, "events").where("ts < timestamp_ntz'2024-01-03'")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'signup'").select("user_id"))


@query("SELECT c_custkey, word FROM (SELECT c_custkey, unnest(string_split(lower(c_name), '#')) AS word FROM customer) WHERE word <> ''")
def person_words(spark, sf):
    """The inverted index of names."""
    words = F.explode(F.split(F.lower("c_name"), "#"))
    return load(spark, sf, "customer").select("c_custkey", words.alias("word")).where("word <> ''")


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' AND o.o_orderpriority = '1-URGENT' AND o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def parcels_of_orders(spark, sf):
    """Facts of one kind joined to those of another by the order number they share."""
    l, o = load(spark, sf, "lineitem"), load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    large = l.where("l_quantity >= 49").select("l_orderkey")
    met = l.where("l_returnflag = 'R'").join(o, l["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey")
    return met.join(large, "l_orderkey", "left_semi")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 20")
def rule_log_pruned(spark, sf):
    """The newest 20 of each rule."""
    return T.newest_per_key(load(spark, sf, "events"), "event_type", [F.desc("event_id")], 20).select("event_type", "event_id")


@query("SELECT user_id FROM (SELECT user_id, bool_or(event_type = 'purchase' AND value > 95) AS named, max(ts) AS last FROM events GROUP BY user_id) ORDER BY named DESC, last DESC, user_id LIMIT 12")
def people_first(spark, sf):
    """Those who are asked for come first, then by activity."""
    p = load(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.expr("event_type = 'purchase' and value > 95")).alias("named"), F.max("ts").alias("last"))
    return p.orderBy(F.desc("named"), F.desc("last"), "user_id").limit(12).select("user_id")


@query("WITH n AS (SELECT o_orderkey, lpad((o_orderkey * 104729)::VARCHAR, 10, '0') AS s FROM orders) SELECT o_orderkey, s AS number FROM n WHERE length(s) = 10 AND substr(s, 1, 9)::BIGINT % 7 = substr(s, 10, 1)::INT")
def check_digit_mod7(spark, sf):
    n = load(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 104729).cast("string"), 10, "0").alias("number"))
    return n.where(X.dhl10_ok(F.col("number")))


@query("WITH n AS (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 12, '0') AS s FROM orders) SELECT o_orderkey, s AS number FROM n WHERE list_sum(list_transform(range(11), lambda i: substr(s, 11 - i, 1)::INT * [1, 3, 7][i % 3 + 1])) % 11 % 10 = substr(s, 12, 1)::INT")
def check_digit_mod11(spark, sf):
    n = load(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919).cast("string"), 12, "0").alias("number"))
    return n.where(X.fedex12_ok(F.col("number")))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN (o_custkey % 90)::VARCHAR ELSE printf('%.2f', round(o_totalprice, 2)) END AS total FROM orders")
def receipt_totals(spark, sf):
    """A receipt for each order, in four layouts: one line, the sum on the next line, a charged sum that a total outranks, no sum at all."""
    o = load(spark, sf, "orders")
    price, small = F.concat(F.lit("$"), F.format_number(F.round("o_totalprice", 2), 2)), F.concat(F.lit("€ "), (F.col("o_custkey") % 90).cast("string"))
    layout = F.col("o_orderkey") % 4
    text = (
        F.when(layout == 0, F.concat(F.lit("Subtotal $9.00\nGrand total: "), price, F.lit("\nTotal $7\nAmount due $3")))
        .when(layout == 1, F.concat(F.lit("Items 3\nOrder Total\n\n  "), price, F.lit("\nYou saved $4")))
        .when(layout == 2, F.concat(F.lit("Charged "), price, F.lit("\nTotal savings $8\nTotal "), small))
        .otherwise(F.lit("Total time 3 h\nthank you"))
    )
    return o.select("o_orderkey", X.receipt_total(text).alias("total"))


SENT = "WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '\\n+')) AS line FROM documents), w AS (SELECT doc_id, trim(line) AS line, regexp_extract_all(lower(line), '[a-z]+') AS ws FROM s WHERE trim(line) <> '') "


@query(SENT + ", q AS (SELECT *, len(list_filter(list_distinct(ws), lambda x: x IN ('thing', 'than', 'the'))) AS hits FROM w), r AS (SELECT doc_id, md5(line) AS line, round(hits / 3.0 + hits::DOUBLE / greatest(len(ws), 5), 6) AS score FROM q WHERE hits > 0) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) = 1")
def line_score(spark, sf):
    """The best line of each document: how many of the words it has, and how densely."""
    lines = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\n+")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    ws = F.regexp_extract_all(F.lower("line"), F.lit("[a-z]+"), F.lit(0))
    scored = lines.withColumn("ws", ws).withColumn("hits", F.size(F.array_intersect("ws", F.array(F.lit("thing"), F.lit("than"), F.lit("the")))))
    scored = scored.where("hits > 0").select("doc_id", F.md5(F.col("line").cast("binary")).alias("line"), F.round(F.col("hits") / 3.0 + F.col("hits") / F.greatest(F.size("ws"), F.lit(5)), 6).alias("score"))
    return T.newest_per_key(scored, "doc_id", [F.desc("score"), F.asc("line")])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AND c_acctbal > 9000")
def people_you_know(spark, sf):
    c, s = load(spark, sf, "customer").where("c_acctbal > 9000"), load(spark, sf, "supplier").where("s_acctbal > 5000")
    return P.from_known(c.withColumnRenamed("c_nationkey", "k"), s.withColumnRenamed("s_nationkey", "k"), "k").select("c_custkey", F.col("k").alias("c_nationkey"))


@query("SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(b, 0) AS busy FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS d) LEFT JOIN (SELECT d, count(*) AS b FROM (SELECT unnest(generate_series(ts::DATE, (ts + INTERVAL (1 + event_id % 48) HOUR - INTERVAL 1 MICROSECOND)::DATE, INTERVAL 1 DAY))::DATE AS d FROM events WHERE event_type = 'view') GROUP BY d) USING (d)")
def busy_days(spark, sf):
    """How many intervals touch each day; days without any have 0."""
    e = load(spark, sf, "events").where("event_type = 'view'")
    last = F.expr("cast(ts + make_dt_interval(0, cast(1 + event_id % 48 as int)) - interval 0.000001 seconds as date)")
    days = e.select(F.explode(F.sequence(F.col("ts").cast("date"), last)).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("busy"))
    return I.gap_filled(days, I.calendar(spark, "2024-01-01", "2024-01-31", "day", "d"), "d", "busy").select(F.date_format("d", "yyyy-MM-dd").alias("day"), "busy")
