"""Panels and maintained tables: people, receipts, meetings, pending scans, first contacts, threads by subject, echoes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import panels as P
from .registry import load, query
from .search_queries import TOKS, docs


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def accounts_merged(spark, sf):
    """The unified list of all accounts; an event's type is its account."""
    return P.newest_merged(load(spark, sf, "events"), "event_type", "ts", "event_id", 50).select("event_id")


PEOPLE = "WITH p AS (SELECT c_custkey, lower(c_mktsegment) AS seg, count(*) FILTER (o_orderstatus = 'F') AS sent_to, count(*) FILTER (o_orderstatus <> 'F') AS received FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL) "


def people(spark, sf):
    """Customers: finished orders are mail to them, others from them, the segment is a word of the name."""
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    status = F.col("o_orderstatus")
    both = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_custkey", "c_mktsegment", "c_name").agg(F.count_if(status == "F").alias("sent_to"), F.count_if(status != "F").alias("received"))
    return both, X.tokens(F.concat_ws(" ", "c_name", "c_mktsegment"))


@query(PEOPLE + "SELECT c_custkey, sent_to + received AS messages FROM p WHERE seg LIKE 'buil%' ORDER BY sent_to * 3 + received DESC, c_custkey LIMIT 5")
def people_panel(spark, sf):
    """The word that nobody answers to is left out."""
    rows, toks = people(spark, sf)
    return P.people_panel(rows, "c_custkey", toks, [("buil", True), ("unheardof", False)]).select("c_custkey", (F.col("sent_to") + F.col("received")).alias("messages"))


@query(PEOPLE + "SELECT DISTINCT c_custkey FROM ((SELECT * FROM p WHERE seg = 'building' ORDER BY sent_to * 3 + received DESC, c_custkey LIMIT 10) UNION ALL (SELECT * FROM p WHERE seg LIKE 'mach%' ORDER BY sent_to * 3 + received DESC, c_custkey LIMIT 10))")
def sender_boosts(spark, sf):
    rows, toks = people(spark, sf)
    return P.sender_boosts(rows, "c_custkey", toks, [("building", False), ("mach", True)])


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, o_orderpriority AS currency, count(*) AS receipts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1, 2")
def receipts_by_month(spark, sf):
    o = load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("currency"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return P.month_sums(o, "day", "currency", "amount").select(F.date_format("month", "yyyy-MM").alias("month"), "currency", "receipts", F.col("total").cast("double").alias("total"))


@query("SELECT user_id, count(DISTINCT CASE WHEN event_type = 'error' THEN 'i' || event_id ELSE event_type || strftime(ts, '%Y-%m-%d') END) AS meetings FROM events WHERE value <= 150 GROUP BY user_id")
def meetings_with(spark, sf):
    """Events of a type and day are one meeting; errors have no uid; dear ones were declined."""
    e = load(spark, sf, "events").withColumns({"uid": F.when(F.col("event_type") != "error", F.col("event_type")), "start": F.date_format("ts", "yyyy-MM-dd")})
    return P.meetings_with(e, "user_id", "uid", "start", "event_id", F.col("value") > 150)


@query("SELECT event_id FROM events WHERE event_id % 2 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 100")
def scan_pending(spark, sf):
    """The next hundred to scan; rows of an older version are pending again."""
    e = load(spark, sf, "events")
    scanned = e.where("event_id % 2 = 0 OR event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 2 == 0, 2).otherwise(1).alias("version"))
    return P.scan_pending(e, scanned, "event_id", "ts", 2, 100).select("event_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def first_contact_maintained(spark, sf):
    """A table of first contacts after one change: every fourth message goes, every fifth comes."""
    e = load(spark, sf, "events").select("user_id", "event_id")
    old, new = e.where("event_id % 5 <> 0"), e.where("event_id % 5 = 0")
    firsts = old.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return P.firsts_after(firsts, old, new, e.where("event_id % 4 = 0"), "user_id", "event_id")


@query(
    "WITH m AS (SELECT event_id, user_id, event_type, ts, value > 60 AS reply, CASE WHEN value > 180 THEN 't' || user_id END AS known FROM events), "
    "n AS (SELECT *, coalesce(ts - lag(ts) OVER w <= INTERVAL 7 DAY, false) AS near FROM m WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), "
    "o AS (SELECT *, CASE WHEN known IS NULL AND reply AND near THEN NULL ELSE coalesce(known, event_id::VARCHAR) END AS own FROM n) "
    "SELECT event_id, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS thread FROM o"
)
def subject_threads(spark, sf):
    """Events as messages whose subject is their type; many are replies, some have references."""
    m = load(spark, sf, "events").withColumn("subject", F.concat(F.when(F.col("value") > 60, "Re: FW:  ").otherwise(""), F.upper("event_type")))
    known = F.when(F.col("value") > 180, F.concat(F.lit("t"), F.col("user_id").cast("string")))
    return P.subject_threads(m, "user_id", "subject", "ts", "event_id", known).select("event_id", "thread")


@query("SELECT event_id FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'purchase' AND d.user_id = e.user_id AND d.ts <= e.ts AND e.ts - d.ts <= INTERVAL 15 MINUTE)")
def echoes_dropped(spark, sf):
    """Purchases are own changes; what the same user reports just after them is an echo."""
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return P.without_echoes(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), ["user_id"], "ts").select("event_id")


@query("SELECT user_id, event_type AS address, count(*) FILTER (value <= 50) AS from_them, count(*) FILTER (value > 50) AS to_them FROM events GROUP BY 1, 2")
def address_uses(spark, sf):
    return P.address_uses(load(spark, sf, "events").withColumnRenamed("event_type", "address"), "user_id", "address", F.col("value") > 50)


@query(f"WITH d AS (SELECT source, {TOKS} AS toks FROM documents) SELECT count(*) AS messages, count(DISTINCT source) AS threads FROM d WHERE list_contains(toks, 'was') OR list_contains(toks, 'thing')")
def topic_counts(spark, sf):
    """A document's source is its thread."""
    return P.topic_counts(docs(spark, sf), F.col("toks"), ["was", "thing"], "source")


@query("SELECT o_custkey, count(*) FILTER (o_orderdate < DATE '1998-01-01') AS past, count(*) FILTER (o_orderdate >= DATE '1998-01-01') AS future FROM orders GROUP BY o_custkey")
def ask_tense(spark, sf):
    day, today = F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(*[F.count_if(P.in_tense(day, today, t)).alias(t) for t in ("past", "future")])


@query("SELECT user_id, event_type AS kind, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest_of_kind(spark, sf):
    return P.latest_of_kind(load(spark, sf, "events").withColumnRenamed("event_type", "kind"), "user_id", "kind", "ts", "event_id").drop("ts")
