"""Panels on literals: nulls, ties, empty tables, repeated rows."""

import datetime as dt

from pyspark.sql import functions as F

from threadlake.operators import panels as P

T = dt.datetime(2024, 1, 1)


def people(spark):
    rows = [("a@x", ["mike", "delgado"], 3, 1), ("b@x", ["mike", "stone"], 5, 0), ("c@x", None, 9, 9), ("d@x", ["mikael"], 0, 0), ("me@x", ["mike"], 50, 0)]
    return spark.createDataFrame(rows, "email string, toks array<string>, sent_to long, received long")


def test_people_panel_drops_words_that_match_nobody(spark):
    p = people(spark)
    got = lambda *w, **k: [r["email"] for r in P.people_panel(p, "email", F.col("toks"), list(w), **k).collect()]
    assert got(("mike", False), ("invoice", False), own=["me@x"]) == ["b@x", "a@x"]
    assert got(("mike", False), ("del", True)) == ["a@x"]
    assert got(("invoice", False)) == [] and got() == [] and got(("m", True)) == []
    assert P.people_panel(p.limit(0), "email", F.col("toks"), [("mike", False)]).count() == 0


def test_sender_boosts_take_the_best_of_each_word(spark):
    got = P.sender_boosts(people(spark), "email", F.col("toks"), [("mike", False), ("stone", False), ("d", True)], 1)
    assert sorted(r["email"] for r in got.collect()) == ["b@x", "me@x"]


def test_merged_list_breaks_ties_by_identifier(spark):
    rows = spark.createDataFrame([("a", T, 1), ("a", T, 2), ("b", T, 3), (None, T, 4), ("b", None, 5)], "acc string, at timestamp, id int")
    assert [r["id"] for r in P.newest_merged(rows, "acc", "at", "id", 3).collect()] == [4, 3, 2]


def test_first_contacts_after_deletion(spark):
    old = spark.createDataFrame([("p", 1), ("p", 5), ("q", 2), ("r", 3)], "who string, seq int")
    firsts = old.groupBy("who").agg(F.min("seq").alias("seq"))
    new = spark.createDataFrame([("s", 9), ("r", 0), ("t", 7)], "who string, seq int")
    gone = spark.createDataFrame([(1,), (2,), (7,), (7,)], "seq int")
    got = {r["who"]: r["seq"] for r in P.firsts_after(firsts, old, new, gone, "who", "seq").collect()}
    assert got == {"p": 5, "r": 0, "s": 9}


def test_subjects_without_marks(spark):
    rows = spark.createDataFrame([("Re: AW[2]: Fwd:  The  Plan ",), ("fw: plan",), ("regarding: x",), (None,), ("Re:",)], "s string")
    base, reply = P.base_subject(F.col("s"))
    assert [tuple(r) for r in rows.select(base, reply).collect()] == [("the plan", True), ("plan", False), ("regarding: x", False), ("", False), ("", True)]


def test_late_replies_find_their_thread(spark):
    day = lambda n: T + dt.timedelta(days=n)
    rows = [(4, "Re: Lunch plan", day(9), None), (1, "Lunch plan", day(0), None), (2, "re: lunch plan", day(6), None), (3, "Lunch plan", day(30), None), (5, "Re: lunch plan", day(40), None), (6, "Re: hi", day(1), None), (7, "hi", day(0), None), (8, "Re: Lunch plan", day(31), "t9"), (9, "Re: lunch plan", day(32), None)]
    m = spark.createDataFrame(rows, "id int, subject string, at timestamp, known string").withColumn("acc", F.lit("a"))
    got = {r["id"]: r["thread"] for r in P.subject_threads(m, "acc", "subject", "at", "id", F.col("known")).collect()}
    assert got == {1: "1", 2: "1", 4: "1", 3: "3", 8: "t9", 9: "t9", 5: "5", 6: "6", 7: "7"}


def test_echoes_last_fifteen_minutes(spark):
    minute = lambda n: T + dt.timedelta(minutes=n)
    changes = spark.createDataFrame([(1, "m", minute(0)), (2, "m", minute(15)), (3, "m", minute(16)), (4, "n", minute(1)), (5, None, minute(1))], "id int, msg string, at timestamp")
    done = spark.createDataFrame([("m", minute(0))], "msg string, at timestamp")
    assert sorted(r["id"] for r in P.without_echoes(changes, done, ["msg"], "at").collect()) == [3, 4, 5]
    assert P.without_echoes(changes, done.limit(0), ["msg"], "at").count() == 5


def test_meetings_months_topics_and_pending(spark):
    e = spark.createDataFrame([("p", "u", "d1", 1, False), ("p", "u", "d1", 2, False), ("p", None, "d1", 3, False), ("p", "u", "d2", 4, True), ("p", "v", "d2", 5, None)], "who string, uid string, start string, id int, no boolean")
    assert [tuple(r) for r in P.meetings_with(e, "who", "uid", "start", "id", F.col("no")).collect()] == [("p", 2)]
    r = spark.createDataFrame([(T.date(), "EUR", 2.0), (T.date(), "EUR", None), (T.date(), "USD", None)], "day date, cur string, amount double")
    assert sorted((x["cur"], x["receipts"], x["total"]) for x in P.month_sums(r, "day", "cur", "amount").collect()) == [("EUR", 2, 2.0), ("USD", 1, 0.0)]
    d = spark.createDataFrame([("t", ["tax"]), ("t", ["tax", "tax"]), ("u", None), (None, ["tax"])], "thread string, toks array<string>")
    assert [tuple(x) for x in P.topic_counts(d, F.col("toks"), ["tax"], "thread").collect()] == [(3, 2)]
    assert [tuple(x) for x in P.topic_counts(d.limit(0), F.col("toks"), ["tax"], "thread").collect()] == [(0, 0)]
    m = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, at int")
    s = spark.createDataFrame([(2, 2), (2, 2), (1, 1)], "id int, version int")
    assert [x["id"] for x in P.scan_pending(m, s, "id", "at", 2, 5).collect()] == [1, 3]
