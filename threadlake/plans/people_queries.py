"""People, time and intervals over ``events`` and ``orders``.

Events stand in for messages: a user is a person, purchases and signups are sent, the others received.
The data ends on 2024-01-30 and 2001-08-01, so "now" is a literal.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intervals as I
from ..operators import people as P
from ..operators import threads as T
from ..operators import recurrence as RR
from .registry import load, query

E = "WITH e AS (SELECT *, event_type IN ('purchase', 'signup') AS sent FROM events) "


def sent():
    return F.col("event_type").isin("purchase", "signup")


def day():
    return F.col("ts").cast("date")


def events(spark, sf):
    return load(spark, sf, "events")


@query(E + "SELECT user_id, count(*) FILTER (NOT sent) AS received, count(*) FILTER (sent) AS sent, arg_max(event_type, (ts, event_id)) AS newest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM e GROUP BY user_id")
def people_counts(spark, sf):
    got = P.counters(events(spark, sf), "user_id", "event_id", "ts", "event_type", sent())
    return got.withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query(E + "SELECT user_id, CASE WHEN sent THEN 'sent' ELSE 'received' END AS direction, min(event_id) AS first_seq FROM e GROUP BY 1, 2")
def first_contact(spark, sf):
    return P.first_contacts(events(spark, sf), "user_id", "event_id", F.when(sent(), F.lit("sent")).otherwise(F.lit("received")))


@query(E + "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE NOT sent) WHERE k = 1 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'")
def new_sender_in_range(spark, sf):
    first = P.first_of_person(events(spark, sf).where(~sent()), "user_id", "event_id")
    return first.where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-15'").select("user_id", "event_id")


@query(E + "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE sent) WHERE k = 1")
def first_outbound(spark, sf):
    return P.first_of_person(events(spark, sf).where(sent()), "user_id", "event_id").select("user_id", "event_id")


@query(E + "SELECT user_id, event_id FROM e WHERE NOT sent AND event_type <> 'error' AND user_id IN (SELECT user_id FROM e WHERE sent AND ts < TIMESTAMP '2024-01-03')")
def known_sender(spark, sf):
    e = events(spark, sf)
    return P.from_known(e.where(~sent() & (F.col("event_type") != "error")), e.where(sent() & (F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"))), "user_id").select("user_id", "event_id")


@query("SELECT user_id, count(*) AS messages FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-11' GROUP BY user_id ORDER BY messages DESC, user_id LIMIT 8")
def top_senders(spark, sf):
    return P.top(events(spark, sf).where("event_type <> 'error' and ts >= timestamp_ntz'2024-01-11'"), "user_id", 8)


@query("SELECT user_id, event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY user_id, event_type")
def person_summary(spark, sf):
    return events(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (ts < TIMESTAMP '2024-01-15') AS last_event, arg_min(event_id, (ts, event_id)) FILTER (ts >= TIMESTAMP '2024-01-15') AS next_event FROM events GROUP BY user_id")
def person_last_next(spark, sf):
    return P.last_and_next(events(spark, sf), "user_id", "ts", "event_id", F.lit("2024-01-15").cast("timestamp_ntz"))


@query("SELECT c_custkey, c_name FROM customer WHERE len(list_filter(regexp_extract_all(lower(c_name), '[\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'cust'))) > 0 AND len(list_filter(regexp_extract_all(lower(c_name), '[\\p{L}\\p{N}]+'), lambda t: starts_with(t, '0000001'))) > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def suggest_prefix(spark, sf):
    c = load(spark, sf, "customer")
    return P.suggest(c, X.tokens(F.col("c_name")), ["cust", "0000001"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5).select("c_custkey", "c_name")


@query("SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS d) LEFT JOIN (SELECT ts::DATE AS d, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) USING (d)")
def stats_days(spark, sf):
    counts = events(spark, sf).where("event_type = 'signup'").groupBy(day().alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return I.gap_filled(counts, I.calendar(spark, "2023-12-25", "2024-01-31", "day", "d"), "d", "n").select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT w::BIGINT AS weekday, h::BIGINT AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(7)) AS w) CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT dayofweek(ts) AS w, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) USING (w, h)")
def stats_weekday_hour(spark, sf):
    """A grid of 168 cells; Sunday is 0."""
    grid = spark.range(168).select((F.col("id") / 24).cast("long").alias("weekday"), (F.col("id") % 24).alias("hour"))
    counts = events(spark, sf).groupBy((F.dayofweek("ts") - 1).cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["weekday", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT event_id FROM events WHERE (65 >> dayofweek(ts)::INT) & 1 = 1")
def weekday_mask(spark, sf):
    """Weekend days: bits 0 (Sunday) and 6 (Saturday)."""
    return events(spark, sf).where(F.lit(65).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.dayofweek("ts") - 1)) > 0).select("event_id")


DAYS = "WITH a AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS d FROM events), i AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM a), r AS (SELECT user_id, min(d) AS f, max(d) AS l, count(*) AS n FROM i GROUP BY user_id, g) "


@query(DAYS + "SELECT user_id, max(n) AS longest, coalesce(max(n) FILTER (l >= date_diff('day', DATE '1970-01-01', DATE '2024-01-30')), 0) AS current FROM r GROUP BY user_id")
def streaks(spark, sf):
    """The current streak may leave out today, 2024-01-31."""
    days = events(spark, sf).select("user_id", F.unix_date(day()).alias("d")).distinct().withColumn("n", F.lit(1))
    runs = P.islands(days, "user_id", "d")
    today = 19753
    return runs.groupBy("user_id").agg(F.max("entries").alias("longest"), F.coalesce(F.max(F.when(F.col("last") >= today - 1, F.col("entries"))), F.lit(0)).alias("current"))


@query("SELECT strftime(m, '%Y-%m') AS month, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH))::DATE AS m) LEFT JOIN (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1) USING (m)")
def timeline_month_filled(spark, sf):
    counts = load(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return I.gap_filled(counts, I.calendar(spark, "1995-01-01", "2001-08-01", "month", "m"), "m", "n").select(F.date_format("m", "yyyy-MM").alias("month"), "n")


@query(
    "WITH m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS mo, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT *, CASE WHEN mo - lag(mo) OVER w > 2 OR lag(mo) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY mo)), "
    "i AS (SELECT *, sum(f) OVER (PARTITION BY o_custkey ORDER BY mo) AS g FROM s), r AS (SELECT o_custkey, min(mo) AS first, max(mo) AS last, sum(n)::BIGINT AS total FROM i GROUP BY o_custkey, g), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY total DESC, first) AS q FROM r WHERE last - first >= 2) SELECT o_custkey, first, last, total FROM k WHERE q = 1"
)
def regular_run(spark, sf):
    """The run of months with the most orders of each customer: one quiet month is allowed, three months at least."""
    months = load(spark, sf, "orders").groupBy("o_custkey", (F.year("o_orderdate").cast("long") * 12 + F.month("o_orderdate")).alias("mo")).agg(F.count(F.lit(1)).alias("n"))
    runs = P.islands(months, "o_custkey", "mo", tolerance=2).where(F.col("last") - F.col("first") >= 2)
    return T.newest_per_key(runs, "o_custkey", [F.desc("total"), F.asc("first")]).select("o_custkey", "first", "last", "total")


HOURS = "epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 3600 * (1 + event_id % 5) AS e"
SPANS = f"WITH v AS (SELECT event_id, user_id, event_type, {HOURS} FROM events) "


def spans(spark, sf, s="ls", e="le"):
    """Events as busy times of one to five hours."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return events(spark, sf).select("event_id", "user_id", "event_type", at.alias(s), (at + 3600 * (1 + F.col("event_id") % 5)).alias(e))


@query(SPANS + ", w AS (SELECT user_id, event_id AS want, s AS ws, e AS we FROM v WHERE event_type = 'purchase') SELECT event_id, want FROM v JOIN w USING (user_id) WHERE s < we AND ws < e AND event_type = 'click'")
def overlap_join(spark, sf):
    left = spans(spark, sf).where("event_type = 'click'").select("event_id", "user_id", "ls", "le")
    right = spans(spark, sf, "rs", "re").where("event_type = 'purchase'").select(F.col("event_id").alias("want"), "user_id", "rs", "re")
    return I.overlaps(left, right, ["user_id"], 6 * 3600).select("event_id", "want")


@query(SPANS + "SELECT a.event_id AS a, b.event_id AS b FROM v a JOIN v b USING (user_id) WHERE a.event_id < b.event_id AND a.s < b.e AND b.s < a.e AND a.event_type <> b.event_type")
def conflicts(spark, sf):
    left = spans(spark, sf).select(F.col("event_id").alias("a"), "user_id", F.col("event_type").alias("ta"), "ls", "le")
    right = spans(spark, sf, "rs", "re").select(F.col("event_id").alias("b"), "user_id", F.col("event_type").alias("tb"), "rs", "re")
    return I.overlaps(left, right, ["user_id"], 6 * 3600).where("a < b and ta <> tb").select("a", "b")


@query("SELECT user_id, arg_min(event_id, (abs(epoch_us(ts) // 1000000 - epoch(TIMESTAMP '2024-01-15 12:00:00')::BIGINT), event_id)) AS event_id FROM events GROUP BY user_id")
def nearest_in_time(spark, sf):
    e = events(spark, sf).withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    return I.nearest(e, "user_id", "at", "event_id", F.unix_seconds(F.lit("2024-01-15 12:00:00").cast("timestamp"))).select("user_id", "event_id")


CHAIN = "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderkey) OVER w AS p, lag(o_orderdate) OVER w AS pd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) "


@query(
    CHAIN
    + ", g AS (SELECT *, sum(CASE WHEN pd IS NULL OR date_diff('day', pd::DATE, o_orderdate::DATE) > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM o) SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, k) AS component FROM g QUALIFY count(*) OVER (PARTITION BY o_custkey, k) > 1"
)
def components(spark, sf):
    """Orders that follow each other within 60 days, as a graph."""
    o = load(spark, sf, "orders")
    order = [F.asc("o_orderdate"), F.asc("o_orderkey")]
    linked = o.withColumns({"p": I.previous("o_custkey", order, "o_orderkey"), "pd": I.previous("o_custkey", order, "o_orderdate")})
    edges = linked.where(F.datediff("o_orderdate", "pd") <= 60).select(F.col("p").alias("a"), F.col("o_orderkey").alias("b"))
    return I.components(edges)


MEETING_RULES = {"click": "FREQ=DAILY;INTERVAL=3;COUNT=5", "view": "FREQ=WEEKLY;BYDAY=MO,TH;COUNT=6", "purchase": "FREQ=MONTHLY;BYDAY=-1FR", "signup": "FREQ=MONTHLY;BYMONTHDAY=-1,15;UNTIL=20240415T235959"}


@query(
    "WITH d AS (SELECT event_id, event_type, ts, unnest(generate_series(ts::DATE, DATE '2024-06-30', INTERVAL 1 DAY))::DATE AS day FROM events), "
    "o AS (SELECT *, day + (ts - ts::DATE::TIMESTAMP) AS occurs FROM d WHERE CASE event_type WHEN 'click' THEN (day - ts::DATE) % 3 = 0 WHEN 'view' THEN isodow(day) IN (1, 4) WHEN 'purchase' THEN isodow(day) = 5 AND month(day + 7) <> month(day) "
    "WHEN 'signup' THEN (day(day) = 15 OR day = last_day(day)) AND day <= DATE '2024-04-15' ELSE day = ts::DATE END), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY occurs) AS k FROM o) "
    "SELECT event_id, count(*) AS n, strftime(max(occurs), '%Y-%m-%d %H:%M:%S') AS last FROM k WHERE k <= CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 6 ELSE 1000 END GROUP BY event_id"
)
def meetings_repeated(spark, sf):
    """Events as meetings that repeat by a rule of their type up to the middle of the year: how often, and when last."""
    e = load(spark, sf, "events").select("event_id", "ts", "event_type").repartition(2 * spark.sparkContext.defaultParallelism, "event_id")
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("start"), F.try_element_at(F.create_map(*[F.lit(x) for pair in MEETING_RULES.items() for x in pair]), F.col("event_type")).alias("rule"))
    every = RR.occurrences(e, "start", "rule", F.lit("2024-07-01").cast("timestamp"))
    return every.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("occurs"), "yyyy-MM-dd HH:mm:ss").alias("last"))
