"""Mailbox questions: folders, fielded ranking, rules, recipients, recurring charges, bills, facts in markup and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import mailbox as M
from ..operators import markup as K
from ..operators import postings as P
from ..operators import views as V
from .registry import load, query
from .search_queries import TOKS

FIELDED = (
    f"WITH d AS (SELECT doc_id, {TOKS} AS toks, {TOKS.replace('coalesce(text', 'coalesce(source')} AS sender FROM documents), "
    "f AS (SELECT doc_id, toks[1:8] AS subject, len(toks) + len(sender) AS dl, "
    + ", ".join(f"4.0 * len(list_filter(toks[1:8], lambda t: t = '{w}')) + 2.5 * len(list_filter(sender, lambda t: t = '{w}')) + 1.0 * len(list_filter(toks[9:], lambda t: t = '{w}')) AS tf{i}" for i, w in enumerate(("was", "thing")))
    + " FROM d), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf0 > 0) AS d0, count(*) FILTER (tf1 > 0) AS d1 FROM f), "
    "h AS (SELECT doc_id, subject, round("
    + " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(2))
    + ", 6) AS score FROM f, s WHERE tf0 > 0 OR tf1 > 0) "
)


FIELDS = {"subject": 4.0, "sender": 2.5, "body": 1.0}


def fielded(spark, sf):
    """The index of documents as mail: the opening words are the subject, the source the sender."""
    toks = X.tokens(F.col("text"))
    fields = {"subject": F.slice(toks, 1, 8), "sender": X.tokens(F.col("source")), "body": F.slice(toks, F.lit(9), F.greatest(F.size(toks), F.lit(1)))}
    return P.opened(load(spark, sf, "documents"), "doc_id", fields, "mail")


@query(FIELDED + "SELECT doc_id, score FROM h")
def search_fielded(spark, sf):
    return fielded(spark, sf).bm25(["was", "thing"], FIELDS).withColumn("score", F.round("score", 6))


@query(FIELDED + "SELECT doc_id, round(score + CASE WHEN list_contains(subject, 'was') THEN 0.1 ELSE 0 END + CASE WHEN list_contains(subject, 'thing') THEN 0.05 ELSE 0 END, 6) AS score FROM (SELECT * FROM h ORDER BY score DESC, doc_id LIMIT 200)")
def search_reranked(spark, sf):
    mail = fielded(spark, sf)
    hits = mail.bm25(["was", "thing"], FIELDS).withColumn("score", F.round("score", 6))
    subjects = mail.frequencies(["was", "thing"], {"subject": 1.0}).select(F.col("id").alias("doc_id"), "tf0", "tf1")
    top = M.reranked(hits.join(subjects, "doc_id", "left"), "doc_id", [(F.col("tf0") > 0, 0.1), (F.col("tf1") > 0, 0.05)])
    return top.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "SELECT role, count(*) FILTER (role = 'user') AS inbox, count(*) FILTER (role = 'assistant') AS sent, count(*) FILTER (role = 'system') AS trash, count(*) FILTER (contains(text, '?') AND role <> 'system') AS starred, "
    "count(*) FILTER (length(text) > 200 AND role <> 'system') AS important, count(*) FILTER (role = 'assistant') AS done, count(*) AS anywhere FROM conversations GROUP BY role"
)
def folder_counts(spark, sf):
    """Turns as messages: the user's are in the inbox, the assistant's sent, the system's in the trash."""
    named = F.when(F.col("role") == "user", "INBOX").when(F.col("role") == "assistant", "SENT").otherwise("TRASH")
    labels = F.array(named, F.when(F.col("text").contains("?"), "STARRED"), F.when(F.length("text") > 200, "IMPORTANT"))
    bits = load(spark, sf, "conversations").select("role", M.flags(F.array_compact(labels)).alias("bits"))
    return bits.groupBy("role").agg(*[F.count_if(M.in_folder(F.col("bits"), f)).alias(f) for f in ("inbox", "sent", "trash", "starred", "important", "done", "anywhere")])


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 50 ORDER BY ts DESC, event_id DESC LIMIT 50")
def match_newest(spark, sf):
    """The list of a saved search: the newest 50."""
    return M.newest_matches(load(spark, sf, "events"), (F.col("event_type") == "purchase") & (F.col("value") > 50), "ts", "event_id", 50).select("event_id")


@query("SELECT lower('S' || l_suppkey || '@Parts.example') AS email, count(*) AS n FROM lineitem GROUP BY 1")
def recipient_counts(spark, sf):
    """Each order is a message to the suppliers of its lines, whose list is JSON."""
    person = F.struct(F.concat(F.lit("Supplier "), "l_suppkey").alias("name"), F.concat(F.lit("S"), "l_suppkey", F.lit("@Parts.example")).alias("email"))
    messages = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(person)).alias("to"))
    return M.recipients(messages, "to").groupBy("email").agg(F.count(F.lit(1)).alias("n"))


LOG = "SELECT event_type AS rule, ts, 1 + event_id % 3 AS matched, event_id % 2 = 0 AS dry, value < 90 AS ok FROM events"


@query(
    f"SELECT rule, sum(CASE WHEN NOT dry AND ok THEN matched ELSE 0 END)::BIGINT AS applied, sum(CASE WHEN dry THEN matched ELSE 0 END)::BIGINT AS dry_run_matches, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run, "
    f"strftime(max(CASE WHEN NOT ok THEN ts END), '%Y-%m-%d %H:%M:%S') AS last_error FROM ({LOG}) GROUP BY rule"
)
def rule_stats(spark, sf):
    log = load(spark, sf, "events").select(F.col("event_type").alias("rule"), F.col("ts").alias("at"), (1 + F.col("event_id") % 3).alias("matched"), (F.col("event_id") % 2 == 0).alias("dry_run"), (F.col("value") < 90).alias("ok"))
    return M.rule_figures(log).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("last_run", "last_error")})


@query("SELECT event_type AS view, count(DISTINCT user_id) FILTER (value > 90) AS n FROM events GROUP BY 1")
def view_badges(spark, sf):
    return M.badges(load(spark, sf, "events").withColumnRenamed("event_type", "view"), "view", "user_id", F.col("value") > 90)


@query("WITH a AS (SELECT conv_id, min(turn) AS since FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT a.conv_id, since, coalesce((SELECT max(turn) FROM conversations c WHERE c.conv_id = a.conv_id AND role = 'user') > since, false) AS replied FROM a")
def replied_after(spark, sf):
    c = load(spark, sf, "conversations")
    asked = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("since"))
    return M.replied_after(c, asked, "conv_id", "turn", F.col("role") != "user")


@query("SELECT doc_id, CASE WHEN quality = 1 AND lang = 'en' THEN 2 WHEN quality = 1 OR n_chars > 2000 THEN 1 ELSE 0 END AS grade FROM documents LEFT JOIN labels USING (doc_id)")
def qrels_by_rule(spark, sf):
    both = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    good = F.col("quality") == 1
    return M.graded(both, [(good & (F.col("lang") == "en"), 2), (good | (F.col("n_chars") > 2000), 1)]).select("doc_id", "grade")


BANDS = ", ".join(f"('{n}', {x}, {lo}, {hi})" for n, x, lo, hi in V.CADENCES)


@query(
    "WITH m AS (SELECT c_nationkey AS k, min(o_orderdate)::DATE AS d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, date_trunc('month', o_orderdate)), "
    "g AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY k ORDER BY d), d) AS gap, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS r FROM m), "
    "p AS (SELECT k, count(*) AS charges, max(d) AS last_day, arg_max(a, d) AS amount, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps, list_sort(list(a) FILTER (r <= 3)) AS recent FROM g GROUP BY k HAVING count(*) > 1), "
    f"b AS (SELECT * FROM (VALUES {BANDS}) AS t(cadence, nominal, lo, hi)), "
    "c AS (SELECT p.*, b.*, recent[len(recent) // 2 + 1] AS mid, date_diff('day', last_day, DATE '2001-08-10') - nominal AS over, greatest(nominal * 0.5, 7.0) AS grace FROM p JOIN b ON gaps[len(gaps) // 2 + 1] BETWEEN lo AND hi WHERE charges > 2 OR cadence = 'Yearly') "
    "SELECT k AS c_nationkey, cadence, charges, amount, round(amount * 30.44 / nominal, 2)::DOUBLE AS per_month, strftime(last_day + floor(nominal)::INT, '%Y-%m-%d') AS next_due, CASE WHEN over <= grace THEN 'active' WHEN over <= grace + nominal THEN 'late' ELSE 'stopped' END AS status "
    "FROM c WHERE len(list_filter(gaps, lambda x: x BETWEEN lo * 0.85 AND hi * 1.15)) >= ceil(len(gaps) * 0.75) AND len(list_filter(recent, lambda x: abs(x - mid) > mid * 0.25)) = 0"
)
def recurring_charges(spark, sf):
    """A nation's orders of a month are one statement, dated by the first of them."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    months = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.min(F.to_date("o_orderdate")).alias("day"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    return V.recurring(months, ["c_nationkey"], "day", "amount", F.lit("2001-08-10").cast("date")).withColumn("next_due", F.date_format("next_due", "yyyy-MM-dd"))


@query(
    "WITH o AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderpriority AS inv, o_totalprice AS amt, o_orderdate::DATE AS d, o_orderstatus AS s FROM orders), "
    "b AS (SELECT *, CASE WHEN s = 'O' THEN d + 30 END AS due FROM o WHERE s <> 'F' QUALIFY row_number() OVER (PARTITION BY k, inv ORDER BY d DESC, id DESC) = 1), "
    "p AS (SELECT b.id, max((y.d, y.id)) AS pay FROM b JOIN o y ON y.s = 'F' AND y.k = b.k AND y.d >= b.d AND (y.inv = b.inv OR y.amt = b.amt) GROUP BY b.id) "
    "SELECT b.id, b.k AS o_custkey, b.inv AS invoice, b.amt AS amount, strftime(due, '%Y-%m-%d') AS due, CASE WHEN pay IS NOT NULL THEN 'paid' WHEN due < DATE '2001-08-01' AND due >= DATE '2001-07-02' THEN 'overdue' WHEN due >= DATE '2001-08-01' THEN 'due' WHEN due IS NULL AND date_diff('day', b.d, DATE '2001-08-01') <= 45 THEN 'due' ELSE 'earlier' END AS state, "
    "y.id AS payment FROM b LEFT JOIN p USING (id) LEFT JOIN o y ON y.id = struct_extract_at(pay, 2)"
)
def bill_states(spark, sf):
    """Open orders are bills, finished ones payments, a priority stands for the invoice."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderpriority").alias("invoice"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("s"))
    bills = o.where("s <> 'F'").withColumn("due", F.when(F.col("s") == "O", F.date_add("day", 30)))
    return V.bill_states(bills, o.where("s = 'F'"), "o_custkey", F.lit("2001-08-01").cast("date")).withColumn("due", F.date_format("due", "yyyy-MM-dd"))


@query(
    "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'order' WHEN 'O' THEN 'bill' ELSE 'shipment' END AS kind, 'Shop ' || o_custkey AS name, 'R-' || o_orderkey AS ref, CASE WHEN o_orderstatus = 'P' THEN '94' || o_orderkey END AS number, "
    "o_totalprice AS amount, 'EUR' AS currency, strftime(o_orderdate, '%Y-%m-%d') AS starts, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'due' ELSE 'inTransit' END AS status FROM orders"
)
def facts_markup(spark, sf):
    """Orders written as JSON-LD of three types, and read back."""
    ref, shop, day, price = F.concat(F.lit("R-"), "o_orderkey"), F.struct(F.concat(F.lit("Shop "), "o_custkey").alias("name")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    typed = lambda t: F.lit(t).alias("@type")
    order = F.to_json(F.struct(typed("Order"), ref.alias("orderNumber"), shop.alias("merchant"), price.alias("price"), F.lit("EUR").alias("priceCurrency"), day.alias("orderDate"), F.lit("http://schema.org/OrderDelivered").alias("orderStatus")))
    bill = F.to_json(F.array(F.struct(typed("Invoice"), ref.alias("confirmationNumber"), shop.alias("provider"), F.struct(price.alias("price"), F.lit("EUR").alias("priceCurrency")).alias("totalPaymentDue"), day.alias("paymentDueDate"), F.lit("PaymentDue").alias("paymentStatus"))))
    part = F.struct(ref.alias("orderNumber"), shop.alias("seller"), price.alias("price"), F.lit("EUR").alias("priceCurrency"))
    parcel = F.to_json(F.struct(F.array(F.struct(typed("ParcelDelivery"), F.concat(F.lit("94 "), "o_orderkey").alias("trackingNumber"), part.alias("partOfOrder"), day.alias("expectedArrivalUntil"), F.lit("OrderInTransit").alias("deliveryStatus"))).alias("@graph")))
    body = F.when(F.col("o_orderstatus") == "F", order).when(F.col("o_orderstatus") == "O", bill).otherwise(parcel)
    html = F.concat(F.lit('<p>Hello</p><script type="application/ld+json">'), body, F.lit("</script>"))
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")  # rows are few bytes and much work, files are one task each
    mail = orders.select(F.col("o_orderkey").alias("id"), html.alias("html"), F.lit(None).cast("string").alias("text"))
    return K.facts(mail, "id", "html", "text").drop("ends")


@query("SELECT o_orderkey AS id, 'bill' AS kind, 'INV-' || o_orderkey AS ref, o_totalprice AS amount, 'EUR' AS currency, strftime(o_orderdate, '%Y-%m-%d') AS starts FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'order', 'A-' || (1000 + o_orderkey), o_totalprice, 'USD', NULL FROM orders WHERE o_orderstatus <> 'O'")
def facts_patterns(spark, sf):
    """Orders written as mails in plain words, and read back."""
    price = F.format_number("o_totalprice", 2)
    bill = F.concat(F.lit("Invoice number: INV-"), "o_orderkey", F.lit("\nAmount due: €"), price, F.lit("\nDue date: "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    bought = F.concat(F.lit("Thank you! Order #A-"), F.col("o_orderkey") + 1000, F.lit("\nSubtotal $1.00\nTotal $"), price)
    mail = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("").alias("html"), F.when(F.col("o_orderstatus") == "O", bill).otherwise(bought).alias("text"))
    return K.facts(mail, "id", "html", "text").select("id", "kind", "ref", "amount", "currency", "starts")
