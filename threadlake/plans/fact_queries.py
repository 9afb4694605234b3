"""Questions and views over facts: ``orders`` with their customers, nations and regions.

A customer is a merchant or person, a nation a place; no table has a currency, so the region's name stands in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ask as A
from ..operators import dates as DT
from ..operators import threads as T
from ..operators import views as V
from .registry import load, query

Q = A.Question
FACTS = "WITH f AS (SELECT o_orderkey AS id, o_orderdate AS tm, o_totalprice AS amount, o_totalprice::DECIMAL(18,2) AS money, o_orderstatus AS status, o_orderpriority AS priority, c_custkey, c_name AS merchant, n_name AS place, r_name AS currency FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "
YEAR = "tm >= TIMESTAMP '1998-01-01' AND tm < TIMESTAMP '1999-01-01'"
IN_1998 = {"start": "1998-01-01", "end": "1999-01-01"}


def facts(spark, sf):
    """The dimensions are fixed small tables; whether they are broadcast is Spark's choice by their size."""
    o, c, n, r = (load(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), "c_custkey", F.col("c_name").alias("merchant"), F.col("n_name").alias("place"), F.col("r_name").alias("currency"),
    )


@query(FACTS + f"SELECT count(*) AS n FROM f WHERE {YEAR}")
def ask_count(spark, sf):
    return A.answer(facts(spark, sf), Q("count", **IN_1998))


@query(FACTS + f"SELECT currency, sum(money)::DOUBLE AS amount, count(*) AS n FROM f WHERE {YEAR} GROUP BY currency")
def ask_sum_by_currency(spark, sf):
    return A.answer(facts(spark, sf), Q("sum", "amount", **IN_1998))


@query(FACTS + f"SELECT currency, round(sum(money)::DOUBLE / count(*), 4) AS amount, count(*) AS n FROM f WHERE {YEAR} GROUP BY currency")
def ask_avg(spark, sf):
    return A.answer(facts(spark, sf), Q("average", "amount", **IN_1998))


@query(FACTS + f"SELECT currency, round(sum(money)::DOUBLE / 12, 4) AS amount FROM f WHERE {YEAR} GROUP BY currency")
def ask_avg_per_month_with_empty(spark, sf):
    """Months without an order count as zero."""
    return A.answer(facts(spark, sf), Q("average_per_period", "amount", **IN_1998))


@query(FACTS + f"SELECT currency, id, amount FROM f WHERE {YEAR} QUALIFY row_number() OVER (PARTITION BY currency ORDER BY money DESC, id) = 1")
def ask_max_item(spark, sf):
    return A.answer(facts(spark, sf), Q("max", "amount", **IN_1998))


@query(FACTS + f"SELECT currency, id, amount FROM f WHERE {YEAR} QUALIFY row_number() OVER (PARTITION BY currency ORDER BY money, id) = 1")
def ask_min_item(spark, sf):
    return A.answer(facts(spark, sf), Q("min", "amount", **IN_1998))


@query(FACTS + "SELECT place, arg_min(id, (tm, id)) AS first_id, arg_max(id, (tm, id)) AS last_id, arg_min(id, (tm, id)) FILTER (tm >= TIMESTAMP '2000-01-01') AS next_id FROM f GROUP BY place")
def ask_first_last_next(spark, sf):
    f = facts(spark, sf)
    a = A.answer(f, Q("first", group_by=("place",))).withColumnRenamed("id", "first_id")
    b = A.answer(f, Q("last", group_by=("place",))).withColumnRenamed("id", "last_id")
    c = A.answer(f, Q("next", group_by=("place",), now="2000-01-01")).withColumnRenamed("id", "next_id")
    return a.join(b, "place").join(c, "place", "left")


@query(FACTS + "SELECT count(*) > 0 AS found FROM f WHERE tm >= TIMESTAMP '2001-08-01' AND place = 'FRANCE'")
def ask_exists(spark, sf):
    return A.answer(facts(spark, sf).where("place = 'FRANCE'"), Q("exists", start="2001-08-01"))


@query(FACTS + f"SELECT strftime(tm, '%Y-%m') AS month, currency, sum(money)::DOUBLE AS amount, count(*) AS n FROM f WHERE {YEAR} GROUP BY 1, 2")
def ask_group_month(spark, sf):
    f = facts(spark, sf).withColumn("month", F.date_format("at", "yyyy-MM"))
    return A.answer(f, Q("sum", "amount", ("month",), **IN_1998))


@query(FACTS + "SELECT year(tm)::BIGINT AS year, currency, sum(money)::DOUBLE AS amount, count(*) AS n FROM f GROUP BY 1, 2")
def ask_group_year(spark, sf):
    f = facts(spark, sf).withColumn("year", F.year("at").cast("long"))
    return A.answer(f, Q("sum", "amount", ("year",)))


@query(FACTS + "SELECT merchant, currency, sum(money)::DOUBLE AS amount, count(*) AS n FROM f GROUP BY 1, 2")
def ask_group_merchant(spark, sf):
    return A.answer(facts(spark, sf), Q("sum", "amount", ("merchant",)))


@query(FACTS + "SELECT place, count(*) AS n FROM f GROUP BY 1")
def ask_group_place(spark, sf):
    return A.answer(facts(spark, sf), Q("count", group_by=("place",)))


@query(FACTS + f"SELECT merchant, count(*) AS n FROM f WHERE {YEAR} GROUP BY 1 QUALIFY count(*) = max(count(*)) OVER ()")
def ask_group_person(spark, sf):
    """The person with the most, and all who tie."""
    return A.winners(A.answer(facts(spark, sf), Q("count", group_by=("merchant",), **IN_1998)), "n")


@query(FACTS + "SELECT count(*) FILTER (year(tm) = 1997) AS n_before, sum(money) FILTER (year(tm) = 1997)::DOUBLE AS amount_before, count(*) FILTER (year(tm) = 1998) AS n_after, sum(money) FILTER (year(tm) = 1998)::DOUBLE AS amount_after FROM f WHERE currency = 'EUROPE'")
def ask_compare_time(spark, sf):
    f = facts(spark, sf).where("currency = 'EUROPE'")
    return A.compare(f, {"before": F.year("at") == 1997, "after": F.year("at") == 1998}, "amount")


@query(FACTS + "SELECT count(*) FILTER (place = 'FRANCE') AS n_a, sum(money) FILTER (place = 'FRANCE')::DOUBLE AS amount_a, count(*) FILTER (place = 'GERMANY') AS n_b, sum(money) FILTER (place = 'GERMANY')::DOUBLE AS amount_b FROM f")
def ask_compare_names(spark, sf):
    return A.compare(facts(spark, sf), {"a": F.col("place") == "FRANCE", "b": F.col("place") == "GERMANY"}, "amount")


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS trips, sum(l_quantity)::DECIMAL(18,2)::DOUBLE AS nights FROM lineitem GROUP BY l_suppkey")
def ask_trips_distinct(spark, sf):
    """Distinct bookings, and the sum of another measure beside them."""
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("trips"), F.sum("l_quantity").cast("decimal(18,2)").cast("double").alias("nights"))


@query(FACTS + "SELECT currency, count(*) AS n FROM f GROUP BY currency ORDER BY n DESC, currency LIMIT 1")
def ask_main_currency(spark, sf):
    return A.main_value(facts(spark, sf), "currency")


@query(FACTS + "SELECT place, count(*) AS n FROM f WHERE place <> (SELECT place FROM f GROUP BY place ORDER BY count(*) DESC, place LIMIT 1) GROUP BY place")
def ask_without_home(spark, sf):
    """The most common place is home and left out."""
    f = facts(spark, sf)
    home = A.main_value(f, "place").first()
    return A.answer(f.where(F.col("place") != home["place"]), Q("count", group_by=("place",)))


@query(
    "WITH u AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount, l_linestatus, row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_returnflag ORDER BY l_shipdate DESC, l_linenumber) AS k FROM lineitem) "
    "SELECT l_suppkey, count(*) AS items, round(sum(amount::DECIMAL(18,2))::DOUBLE, 2) AS total FROM u WHERE k = 1 AND l_linestatus <> 'F' GROUP BY l_suppkey"
)
def spend_with_refunds(spark, sf):
    """The newest line of each merchant, order and kind; what is cancelled (F) goes, returns are negative."""
    u = A.units(load(spark, sf, "lineitem"), ["l_suppkey", "l_orderkey", "l_returnflag"], [F.desc("l_shipdate"), F.asc("l_linenumber")], F.col("l_linestatus") == "F", F.col("l_returnflag") == "R", "l_extendedprice")
    return u.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum(A.money("l_extendedprice")).cast("double"), 2).alias("total"))


@query("SELECT l_orderkey, l_suppkey, arg_max(l_extendedprice, (l_shipdate, l_linenumber)) AS price, count(*) AS facts, strftime(max(l_shipdate), '%Y-%m-%d') AS day FROM lineitem GROUP BY l_orderkey, l_suppkey")
def purchases_dedup(spark, sf):
    """Facts of one purchase merged, the newest first."""
    return load(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.max_by("l_extendedprice", F.struct("l_shipdate", "l_linenumber")).alias("price"), F.count(F.lit(1)).alias("facts"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("day")
    )


def charges(spark, sf):
    e = load(spark, sf, "events").where("event_type = 'purchase'")
    return e.select("user_id", "event_id", F.unix_date(F.col("ts").cast("date")).alias("day"), "value")


CHARGES = "c AS (SELECT user_id, event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS day, value, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id) AS k FROM events WHERE event_type = 'purchase')"
KEPT = f"WITH RECURSIVE {CHARGES}, r AS (SELECT user_id, event_id, day, value, k, day AS last, true AS kept FROM c WHERE k = 1 UNION ALL SELECT c.user_id, c.event_id, c.day, c.value, c.k, CASE WHEN c.day - r.last >= 3 THEN c.day ELSE r.last END, c.day - r.last >= 3 FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1), kept AS (SELECT user_id, event_id, day, value FROM r WHERE kept) "


@query(KEPT + "SELECT user_id, event_id, day FROM kept")
def charges_collapsed(spark, sf):
    return V.collapsed_charges(charges(spark, sf), "user_id", "day", "event_id").select("user_id", "event_id", "day")


@query(
    KEPT
    + ", g AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM kept), p AS (SELECT user_id, count(*) AS charges, max(day) AS last_day, round(sum(value), 2) AS total_amount, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM g GROUP BY user_id HAVING count(*) >= 3), "
    "m AS (SELECT *, gaps[len(gaps) // 2 + 1] AS median_gap FROM p) SELECT user_id, charges, last_day, total_amount, median_gap, last_day + median_gap AS next_due FROM m WHERE len(list_filter(gaps, lambda x: abs(x - median_gap) <= 0.25 * median_gap)) >= 0.75 * len(gaps)"
)
def subscriptions(spark, sf):
    """Recurring charges with the day the next one is due."""
    return V.cadence(V.collapsed_charges(charges(spark, sf), "user_id", "day", "event_id"), "user_id", "day", "value")


@query(
    "WITH b AS (SELECT user_id, event_id AS bill, epoch_us(ts) // 1000000 AS tm FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, event_id AS payment, epoch_us(ts) // 1000000 AS pat FROM events WHERE event_type = 'purchase') "
    "SELECT user_id, bill, arg_min(payment, (pat, payment)) FILTER (pat >= tm AND pat - tm <= 432000) AS payment FROM b LEFT JOIN p USING (user_id) GROUP BY user_id, bill"
)
def bills_paid_match(spark, sf):
    """Each bill with its first payment within five days."""
    e = load(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), "event_type")
    return V.first_payment(e.where("event_type = 'signup'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), "user_id", "at", 432_000)


@query(
    "WITH v AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 3600 * (1 + event_id % 48) AS e FROM events), w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v), "
    "t AS (SELECT *, sum(CASE WHEN b IS NULL OR s - b > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS trip FROM w) SELECT user_id, trip::BIGINT AS trip, count(*) AS legs, min(s) AS starts, max(e) AS ends FROM t GROUP BY user_id, trip"
)
def trips_sessionized(spark, sf):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    legs = load(spark, sf, "events").select("event_id", "user_id", at.alias("s"), (at + 3600 * (1 + F.col("event_id") % 48)).alias("e"))
    return V.sessions(legs, "user_id", "s", "e", 43_200, ["event_id"]).groupBy("user_id", "trip").agg(F.count(F.lit(1)).alias("legs"), F.min("s").alias("starts"), F.max("e").alias("ends"))


@query(
    "SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'delivered' WHEN max(l_shipdate) < TIMESTAMP '2001-08-02' - INTERVAL 21 DAY THEN 'stale' WHEN max(l_shipdate) <= TIMESTAMP '2001-08-02' THEN 'shipped' ELSE 'ordered' END AS status, count(*) AS parcels FROM lineitem GROUP BY l_orderkey"
)
def packages_status(spark, sf):
    last, now = F.max("l_shipdate"), F.lit("2001-08-02").cast("timestamp_ntz")
    status = F.when(F.bool_and(F.col("l_linestatus") == "F"), "delivered").when(last < now - F.expr("interval 21 days"), "stale").when(last <= now, "shipped").otherwise("ordered")
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(status.alias("status"), F.count(F.lit(1)).alias("parcels"))


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AND role = 'user'")
def follow_ups(spark, sf):
    """Threads whose latest visible message waits for an answer."""
    latest = T.newest_per_key(load(spark, sf, "conversations").where("role <> 'system'"), "conv_id", [F.desc("turn")])
    return latest.where("role = 'user'").select("conv_id", "turn")


@query("SELECT CASE WHEN n_chars > 8000 THEN 'long' WHEN lang = 'fr' THEN 'french' WHEN source = 'src0' THEN 'first' ELSE 'other' END AS split, count(*) AS n FROM documents GROUP BY 1")
def split_first_match(spark, sf):
    d = load(spark, sf, "documents")
    split = V.first_match(d, {"long": F.col("n_chars") > 8000, "french": F.col("lang") == "fr", "first": F.col("source") == "src0"})
    return d.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, length(text) AS size FROM conversations WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1")
def files_per_thread(spark, sf):
    """The largest item of each thread."""
    m = load(spark, sf, "conversations").where("text is not null").withColumn("size", F.length("text").cast("long"))
    return T.newest_per_key(m, "conv_id", [F.desc("size"), F.asc("turn")]).select("conv_id", "turn", "size")


@query(FACTS + "SELECT id, status FROM f ORDER BY CASE WHEN status = 'P' THEN NULL ELSE tm END DESC NULLS LAST, id LIMIT 40")
def due_order_nulls_last(spark, sf):
    due = F.when(F.col("status") != "P", F.col("at"))
    return facts(spark, sf).orderBy(due.desc_nulls_last(), "id").limit(40).select("id", "status")


@query("SELECT l_suppkey, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber) AS orders FROM lineitem GROUP BY l_suppkey")
def group_concat(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("x"))
    return rows.select("l_suppkey", F.array_join(F.transform("x", lambda r: r["l_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT o_orderkey, strftime(o_orderdate + CASE WHEN o_orderkey % 4 = 3 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 4 = 3 THEN '7:30 pm' END AS clock FROM orders")
def date_mentions(spark, sf):
    """A line about each order, written on its day: the day as a number, in English, in Spanish without a year, or as tomorrow with a time."""
    o = load(spark, sf, "orders")
    day, layout = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    month = F.element_at(F.array(*[F.lit(m) for m in DT.MESES]), F.month(day))
    line = (
        F.when(layout == 0, F.concat(F.lit("Shipped "), F.date_format(day, "yyyy-MM-dd"), F.lit(".")))
        .when(layout == 1, F.concat(F.lit("You ordered on "), F.date_format(day, "EEEE, MMMM d, yyyy")))
        .when(layout == 2, F.concat(F.lit("Pedido del "), F.dayofmonth(day).cast("string"), F.lit(" de "), month))
        .otherwise(F.lit("Pick-up tomorrow at 7:30 pm"))
    )
    return o.select("o_orderkey", F.inline(DT.mentions(line, day))).select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "clock")
