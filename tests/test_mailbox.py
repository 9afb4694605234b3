"""Mailbox operators on literals: nulls, empty texts and tables, ties, broken markup."""

import datetime as dt

from pyspark.sql import functions as F

from threadlake.operators import mailbox as M
from threadlake.operators import markup as K
from threadlake.operators import views as V

DAY = dt.date(2024, 1, 1)


def after(n):
    return DAY + dt.timedelta(days=n)


def test_folders_hide_trash_and_spam(spark):
    rows = spark.createDataFrame([(1, ["INBOX", "STARRED"]), (2, ["SENT"]), (3, ["TRASH", "STARRED"]), (4, None), (5, ["INBOX", "SPAM"])], "id int, labels array<string>").withColumn("bits", M.flags(F.col("labels")))
    got = lambda f: [r["id"] for r in rows.where(M.in_folder(F.col("bits"), f)).orderBy("id").collect()]
    assert {f: got(f) for f in ("inbox", "starred", "trash", "spam", "done", "anywhere", "drafts")} == {"inbox": [1], "starred": [1], "trash": [3], "spam": [5], "done": [2, 4], "anywhere": [1, 2, 3, 4, 5], "drafts": []}


def test_attachment_kinds(spark):
    rows = spark.createDataFrame([("application/pdf", "x"), (None, "Sheet.XLSX"), ("image/png", None), ("application/octet-stream", "a.pptx"), ("application/msword", ""), (None, None)], "m string, f string")
    assert [r[0] for r in rows.select(M.attachment_kind(F.col("m"), F.col("f"))).collect()] == ["pdf", "spreadsheet", "image", "presentation", "doc", "other"]


def test_fielded_ranking_takes_null_fields_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, ["plan"], ["a"]), (2, ["other"], ["plan"]), (3, None, None), (4, ["none"], ["b"]), (5, [], ["c"])], "id int, subject array<string>, body array<string>")
    got = M.fielded_bm25(rows, "id", {"subject": 4.0, "body": 1.0}, ["plan"]).orderBy(F.desc("score"), "id").collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["score"] > got[1]["score"] > 0
    assert M.fielded_bm25(rows.limit(0), "id", {"subject": 4.0}, ["plan"]).count() == 0


def test_reranking_moves_only_the_top(spark):
    hits = spark.createDataFrame([(1, 1.0, True), (2, 0.99, None), (3, 0.5, True)], "id int, score double, mine boolean")
    assert sorted((r["id"], round(r["score"], 2)) for r in M.reranked(hits, "id", [(F.col("mine"), 0.05)], 2).collect()) == [(1, 1.05), (2, 0.99)]


def test_theoretical_scale(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (0.5,)], "s double")
    assert [round(r["t"], 4) for r in M.theoretical(rows, "s", "t").orderBy("s").collect()] == [0.0, 0.6667, 1.0]
    assert M.theoretical(rows.limit(0), "s", "t").count() == 0


def test_recipients_of_broken_json(spark):
    rows = spark.createDataFrame([(1, '[{"name":"A","email":" A@X.org "},{"email":""}]'), (2, "{broken"), (3, None)], "id int, to string")
    assert [(r["id"], r["name"], r["email"]) for r in M.recipients(rows, "to").collect()] == [(1, "A", "a@x.org")]


def test_respelling_prefers_company_then_frequency_then_letters(spark):
    c = spark.createDataFrame([("q", "b", 5), ("q", "a", 9), ("q", "c", 9), ("z", "k", 1)], "query string, word string, df int")
    p = spark.createDataFrame([("q", "b", 1)], "query string, word string, together int")
    assert {r["query"]: r["word"] for r in M.respelled(c, p, "query", "word").collect()} == {"q": "b", "z": "k"}
    assert M.respelled(c, p.limit(0), "query", "word").where("query = 'q'").first()["word"] == "a"


def test_recurring_charges(spark):
    rows = [("gym", after(30 * i), 20.0 + (i == 4)) for i in range(5)]  # monthly, one small change of price
    rows += [("shop", after(30 * i), float(10 + 40 * (i % 2))) for i in range(5)]  # amounts differ
    rows += [("often", after(d), 5.0) for d in (0, 30, 31, 90, 95)] + [("year", after(d), 99.0) for d in (0, 365)] + [("once", DAY, 1.0), ("gym", None, 3.0), ("gym", after(3), None)]
    charges = spark.createDataFrame(rows, "who string, day date, amount double")
    got = {r["who"]: (r["cadence"], r["charges"], r["amount"], r["status"]) for r in V.recurring(charges, ["who"], "day", "amount", F.lit(after(165)).cast("date")).collect()}
    assert got == {"gym": ("Monthly", 5, 21.0, "active"), "year": ("Yearly", 2, 99.0, "active")}
    later = lambda n: V.recurring(charges, ["who"], "day", "amount", F.lit(after(n)).cast("date")).where("who = 'gym'").first()["status"]
    assert (later(170), later(230)) == ("late", "stopped")
    assert V.recurring(charges.limit(0), ["who"], "day", "amount", F.current_date()).count() == 0


def test_bill_states(spark):
    bill = "id int, who string, invoice string, amount double, day date, due date"
    bills = spark.createDataFrame(
        [(1, "a", "7", 10.0, after(0), after(20)), (2, "a", "7", 10.0, after(5), after(20)), (3, "a", "8", 11.0, after(0), after(90)), (4, "b", None, 12.0, after(0), after(95)), (5, "b", None, 13.0, after(0), after(200)), (6, "c", "9", None, after(80), None), (7, "c", None, None, after(0), None)],
        bill,
    )
    paid = spark.createDataFrame([(20, "a", "7", 1.0, after(6)), (21, "a", "8", 9.0, after(-1)), (22, "b", None, 12.0, after(9)), (23, "c", None, None, after(99))], "id int, who string, invoice string, amount double, day date")
    got = {r["id"]: (r["state"], r["payment"]) for r in V.bill_states(bills, paid, "who", F.lit(after(100)).cast("date")).collect()}
    assert got == {2: ("paid", 20), 3: ("overdue", None), 4: ("paid", 22), 5: ("due", None), 6: ("due", None), 7: ("earlier", None)}
    assert V.bill_states(bills.limit(0), paid, "who", F.current_date()).count() == 0


def facts(spark, html, text):
    return [r.asDict() for r in K.facts(spark.createDataFrame([(1, html, text)], "id int, html string, text string"), "id", "html", "text").collect()]


def test_markup_of_bookings_and_broken_blocks(spark):
    flight = '{"@type":"http://schema.org/FlightReservation","reservationNumber":"QX7K2M","reservationStatus":"http://schema.org/ReservationCancelled","reservationFor":{"flightNumber":"21 8","airline":{"name":"Blue Air"},"departureTime":"2027-03-04T10:00"}}'
    html = f'<script type="application/ld+json">{{nonsense</script><SCRIPT type="application/ld+json">{flight.replace(chr(34), "&quot;")}</SCRIPT><script type="application/ld+json">[{{"@type":"Thing"}},{{"@type":["LodgingReservation"],"reservationFor":{{"name":"Inn"}},"checkinDate":"2027-03-04","totalPrice":"1.234,50","priceCurrency":"EUR"}}]</script>'
    got = {f["kind"]: f for f in facts(spark, html, "no facts here")}
    assert set(got) == {"flight", "lodging"}
    assert (got["flight"]["name"], got["flight"]["ref"], got["flight"]["number"], got["flight"]["status"], got["flight"]["starts"]) == ("Blue Air", "QX7K2M", "218", "cancelled", "2027-03-04T10:00")
    assert (got["lodging"]["name"], got["lodging"]["amount"], got["lodging"]["currency"]) == ("Inn", 1234.5, "EUR")


def test_patterns_fill_what_markup_leaves_out(spark):
    text = "Order #B-5512 has shipped.\nTotal: $1,204.50\nTracking RB123456785GB, and 123456789012"
    got = {f["kind"]: f for f in facts(spark, "", text)}
    assert (got["order"]["ref"], got["order"]["amount"], got["order"]["currency"]) == ("B-5512", 1204.5, "USD")
    assert (got["shipment"]["name"], got["shipment"]["number"]) == ("Post", "RB123456785GB")
    marked = '<script type="application/ld+json">{"@type":"Order","orderNumber":"B-5512"}</script>'
    assert [f["amount"] for f in facts(spark, marked, text) if f["kind"] == "order"] == [None]  # the markup's order stands
    assert facts(spark, None, None) == [] and facts(spark, "", "We went out in order to eat; nothing is due.") == []
