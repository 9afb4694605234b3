"""Operators on literals: what no table of the driver holds, and edge cases."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.operators import evaluation as E
from threadlake.operators import intervals as I
from threadlake.operators import search as S
from threadlake.operators import threads as T
from threadlake.operators import vectors as V
from threadlake.operators import views
from threadlake.sources import mail
from threadlake.streaming import streams as Z


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_tokens_fold_marks_and_plain_letters(spark):
    assert one(spark, X.tokens, "Øre, Łódź straße Ünï 42!") == ["ore", "lodz", "straße", "uni", "42"]
    assert one(spark, X.tokens, None) == []


def test_negation_is_two_valued(spark):
    rows = spark.createDataFrame([(None,), (True,), (False,)], "b boolean")
    assert [r[0] for r in rows.select(X.negated(F.col("b"))).collect()] == [True, False, True]


@pytest.mark.parametrize(("number", "ok"), [("9200123400567800901218", True), ("9200123400567800901212", False)])
def test_mod10(spark, number, ok):
    assert one(spark, X.mod10_ok, number) is ok


@pytest.mark.parametrize(("number", "ok"), [("RB123456785GB", True), ("RB123456784GB", False), ("RB12345678GB", False)])
def test_s10(spark, number, ok):
    assert bool(one(spark, X.s10_ok, number)) is ok


def test_chunks_of_long_and_short_texts(spark):
    def cut(n, most=None):
        made = spark.range(1).select(X.chunk_words(F.sequence(F.lit(1), F.lit(n)), most=most).alias("c")).first()["c"]
        return [(c["start"], c["length"]) for c in made]

    assert cut(50) == [(0, 50)]
    assert cut(95) == [(0, 95)]  # five new words join the opening
    assert cut(200) == [(0, 90), (70, 120), (170, 30)]
    assert sum(cut(5000)[-1]) == 5000 and len(cut(5000)) == 51
    assert cut(795, 8)[-1] == (670, 125)  # the tail joins the eighth
    assert cut(4995, 8)[-1] == (670, 120) and len(cut(5000, 8)) == 8


def test_upper_median_and_nearest_rank(spark):
    rows = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v long")
    assert E.upper_median(rows, "v").first()["median"] == 3
    assert E.nearest_rank(rows, "v", [0.0, 0.5, 0.75, 1.0]).first().asDict() == {"p0": 1, "p50": 2, "p75": 3, "p100": 4}
    assert E.upper_median(rows.limit(0), "v").count() == 0


def test_reply_states_follow_sequence_not_time(spark):
    m = spark.createDataFrame([(1, 1, "r"), (1, 2, "s"), (1, 3, "r"), (2, 1, "s")], "t long, q long, k string")
    got = {(r["t"], r["q"]): (r["unanswered"], r["replied"], r["awaiting"], r["reply"]) for r in T.reply_states(m, "t", "q", F.col("k") == "s", F.col("k") == "r").collect()}
    assert got == {(1, 1): (False, True, False, False), (1, 2): (False, False, False, True), (1, 3): (True, False, False, True), (2, 1): (False, False, True, False)}


def test_collapse_compares_with_the_last_kept(spark):
    c = spark.createDataFrame([(1, 1, 10), (1, 2, 12), (1, 3, 14), (1, 4, 15)], "k long, id long, day int")
    assert sorted(r["day"] for r in views.collapsed_charges(c, "k", "day", "id").collect()) == [10, 14]


def test_first_payment_is_after_the_bill_and_in_time(spark):
    b = spark.createDataFrame([("a", 10, 1), ("a", 30, 2), ("b", 5, 3)], "k string, at long, id long")
    p = spark.createDataFrame([("a", 9, 7), ("a", 10, 8), ("a", 200, 9)], "k string, at long, id long")
    assert {r["bill"]: r["payment"] for r in views.first_payment(b, p, "k", "at", 100).collect()} == {1: 8, 2: None, 3: None}


def test_overlaps_come_once_and_are_half_open(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 100, 101)], "k long, ls long, le long")
    b = spark.createDataFrame([(1, 50, 100), (1, 0, 1000), (1, 7, 7)], "k long, rs long, re long")
    got = sorted((r["ls"], r["rs"]) for r in I.overlaps(a, b, ["k"], 10).collect())
    assert got == [(0, 0), (0, 50), (100, 0)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in I.components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100


def test_components_without_edges(spark):
    assert I.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ndcg_and_reciprocal_rank_by_hand(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "query string, doc string, rank int")
    judged = spark.createDataFrame([("q", "b", 3), ("q", "c", 1), ("q", "d", 2)], "query string, doc string, grade int")
    got = {r["query"]: r["ndcg"] for r in E.ndcg(run, judged, 10).collect()}
    import math

    ideal = 3 / math.log2(2) + 2 / math.log2(3) + 1 / math.log2(4)
    assert got == {"q": round((3 / math.log2(3) + 1 / math.log2(4)) / ideal, 6), "z": 0.0}
    assert {r["query"]: r["rr"] for r in E.reciprocal_rank(run, judged, 2).collect()} == {"q": 0.5, "z": 0.0}


def test_minmax_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, s double")
    assert [r["n"] for r in S.minmax(rows, "s", "n").collect()] == [1.0, 1.0]


def test_unit_and_bits(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in v.select(V.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in v.select(V.bits(F.col("v"))).collect()] == [3, 0]


def test_provider_json_and_label_deltas(spark):
    text = '{"id":"m1","threadId":"t1","labelIds":["INBOX"],"internalDate":"1700000000000","payload":{"headers":[{"name":"FROM","value":"Ann <Ann@Example.org>"},{"name":"subject","value":"Hi"}]}}'
    rows = mail.from_provider_json(spark.createDataFrame([(text,), ("no json",)], "json string"))
    got = rows.where("id = 'm1'").first()
    assert (got["sender"], got["subject"], got["labels"]) == ("ann@example.org", "Hi", ["INBOX"])
    assert rows.where("id is null").count() == 1
    changed = mail.with_labels(rows.where("id = 'm1'"), F.array(F.lit("A"), F.lit("INBOX")), F.array(F.lit("INBOX"), F.lit("B")))
    assert changed.first()["labels"] == ["A"]


def test_mime_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: a@example.org\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nContent-Type: text/plain; charset=latin-1\r\n\r\nsch\xf6n\r\n")
    got = mail.mime_files(spark, str(tmp_path)).first()
    assert got["subject"] == "Grüße" and got["text"].strip() == "schön"


def test_calendar_and_receipts(spark):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u1\r\nSUMMARY:Long\r\n  title\r\nDTSTART:20260102T090000Z\r\nDTEND;VALUE=DATE:20260103\r\nEND:VEVENT\r\nEND:VCALENDAR"
    got = mail.calendar_events(spark.createDataFrame([(ics,), (None,)], "ics string")).collect()
    assert [(r["uid"], r["summary"], r["start"], r["end"]) for r in got] == [("u1", "Long title", datetime.datetime(2026, 1, 2, 9), datetime.datetime(2026, 1, 3))]
    mdn = "Final-Recipient: rfc822; Bob@Example.org\nOriginal-Message-ID: <1@x>\nDisposition: manual-action/MDN-sent-manually; displayed"
    got = mail.read_receipts(spark.createDataFrame([(mdn,), ("hello",)], "text string")).collect()
    assert [tuple(r) for r in got] == [("bob@example.org", "<1@x>", "displayed")]


def test_merge_prefers_terminal_then_generation(spark):
    r = spark.createDataFrame([("k", False, 9, 1, 1, "x"), ("k", True, 1, 1, 1, "sent"), ("m", False, 1, 1, 1, "a"), ("m", False, 2, 0, 0, "b")], "k string, t boolean, gen int, phase int, at int, body string")
    assert {x["k"]: x["body"] for x in Z.merge_records(r, "k", F.col("t")).collect()} == {"k": "sent", "m": "b"}


def test_entry_has_a_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() > 0


@pytest.mark.parametrize(("check", "number", "ok"), [(X.ups_ok, "1ZQ7W2E40005130278", True), (X.ups_ok, "1ZQ7W2E40005130279", False), (X.ups_ok, None, False), (X.dhl10_ok, "1234567891", True), (X.dhl10_ok, "1234567890", False), (X.fedex12_ok, "12345678901x", False)])
def test_tracking_numbers(spark, check, number, ok):
    assert one(spark, check, number) is ok


def test_codes_and_dates(spark):
    assert one(spark, X.codes, "Your code is 482913. Call 12345") == "482913"
    assert one(spark, X.codes, "room 4829") is None
    assert one(spark, X.iso_dates, "on 2026-02-28 and 2026-02-30") == [datetime.date(2026, 2, 28)]


def test_hash_embedding_is_bag_of_words(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, []), (4, None)], "id long, t array<string>")
    got = {r["id"]: r["v"] for r in V.hash_embedded(rows, "t", "v", 16).collect()}
    assert got[1] == got[2] and got[3] == got[4] == [0.0] * 16
    assert V.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_randomization(spark):
    rows = spark.createDataFrame([("x", 1.0, 0.0)] * 12 + [("y", 1.0, 0.0), ("y", 0.0, 1.0)], "g string, a double, b double")
    got = {r["g"]: r for r in E.randomization_test(rows, "g", "a", "b", 2000).collect()}
    assert got["x"]["p"] < 0.01 and got["y"]["p"] == 1.0 and got["x"]["difference"] == 1.0


def test_sweep_and_fusion(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, s string")
    b = spark.createDataFrame([(2, "y"), (3, "q"), (4, "w")], "id long, s string")
    assert {r["id"]: r["action"] for r in S.sweep(a, b, "id", "s").collect()} == {1: "add", 3: "replace", 4: "delete"}
    kw, sem = spark.createDataFrame([(1, 1.0)], "id long, score double"), spark.createDataFrame([(1, 0.5), (2, 1.0)], "id long, score double")
    assert {r["id"]: r["score"] for r in S.fused(kw, sem, "id", 0.25).collect()} == {1: 0.875, 2: 0.25}


def test_receipts_of_old_messages_lose_their_bodies(spark):
    m = spark.createDataFrame([(1, "2020-01-01", "x"), (2, "2024-01-01", "y"), (3, None, "z")], "id long, d string, body string").withColumn("d", F.col("d").cast("timestamp"))
    assert {r["id"]: r["body"] for r in mail.without_old_bodies(m, "d", "2023-01-01", ["body"]).collect()} == {1: None, 2: "y", 3: "z"}


def test_trec_run_and_envelope(spark, tmp_path):
    run = spark.createDataFrame([("q1", "d1", 1, 0.5)], "query string, doc string, rank int, score double")
    mail.write_trec_run(run, str(tmp_path / "run"), "t")
    assert [r[0] for r in spark.read.text(str(tmp_path / "run")).collect()] == ["q1 Q0 d1 1 0.500000 t"]
    assert mail.envelopes(run.select("doc"), "hits").first()["value"] == '{"version":1,"kind":"hits","data":{"doc":"d1"}}'


@pytest.mark.parametrize(
    ("text", "total"),
    [("Total $1\nTotal $2", "2"), ("Charged $9\nTotal $4\nbalance due $7", "4"), ("you paid\n\n€ 7,25", "7.25"), ("Subtotally $3", None), ("totals $3", None), ("Importe total: €1.234,5\nTotal 3", "1234.5"), ("", None), (None, None)],
)
def test_receipt_totals(spark, text, total):
    assert one(spark, X.receipt_total, text) == total


def test_tracking_parameters(spark):
    for url, want in (("https://a.example/p?GCLID=1&x=2#f", "https://a.example/p?x=2#f"), ("https://a.example/p?utm_source=n&__s=4", "https://a.example/p?utm_source=n"), ("https://a.example/unsubscribe?mkt_tok=9", "https://a.example/unsubscribe?mkt_tok=9"), ("https://remove.example/p?mkt_tok=9", "https://remove.example/p"), (None, None)):
        assert one(spark, X.without_tracking, url) == want


def test_judgments_without_a_query_hold_for_every_query(spark):
    run = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "query string, doc int, rank int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (8, 1)], "doc int, grade int")  # 8 and 9 are in no run
    pairs = run.select("query").distinct().crossJoin(labels)
    for measure in (E.ndcg, E.judged):
        assert sorted(map(tuple, measure(run, labels, 2).collect())) == sorted(map(tuple, measure(run, pairs, 2).collect()))
    assert {r["query"]: r["ndcg"] for r in E.ndcg(run, labels, 2).collect()} == {"a": round(1 / (1 + 1 / math.log2(3)), 6), "b": 0.0}
    assert {r["ndcg"] for r in E.ndcg(run, labels.where("grade > 1"), 2).collect()} == {0.0}
