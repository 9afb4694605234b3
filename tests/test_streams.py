"""Keyed tables with a log, figures kept by a feed, late replies as state, sessions closed by the watermark."""

import datetime

import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators.intervals import components
from threadlake.streaming import streams as Z
from threadlake.streaming import threading as T
from threadlake.streaming import upkeep as U



def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = Z.Table(spark, f"{tmp_path}/t", ["k"], 8)
    Z.upsert(table, spark.createDataFrame([(i, 0) for i in range(100)], "k long, v long"), [F.desc("v")])
    first = dict(table.entry()["folders"])
    Z.upsert(table, spark.createDataFrame([(7, 5)], "k long, v long"), [F.desc("v")])
    second = dict(table.entry()["folders"])
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    assert {r["k"]: r["v"] for r in table.read().collect()} == {i: 5 if i == 7 else 0 for i in range(100)}


def test_batches_that_come_twice_and_deletes(spark, tmp_path):
    table = Z.Table(spark, f"{tmp_path}/t", ["k"], 4)
    assert table.read() is None and table.at_keys(spark.createDataFrame([("a",)], "k string")) is None
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), (None, 9)], "k string, v long")
    for _ in range(2):
        Z.upsert(table, rows, [F.desc("v")], 0)
    assert len(table.entry()["folders"]) and table.entry()["version"] == 0
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", 3), ("b", 2), (None, 9)]
    Z.delete(table, spark.createDataFrame([("a",), ("zz",)], "k string"), 1)
    assert sorted(map(tuple, table.read().collect()), key=str) == [("b", 2), (None, 9)]
    assert [tuple(r) for r in table.at_keys(spark.createDataFrame([("b",), ("a",)], "k string")).collect()] == [("b", 2)]
    Z.delete(table, table.read().where("k is not null"))
    assert [tuple(r) for r in table.read().collect()] == [(None, 9)]


def test_table_goes_on_after_a_restart(spark, tmp_path):
    """The second run knows the first one's checkpoint and log only."""
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(source)
    for more in ([(2, "c"), (3, "d")], []):
        table = Z.Table(spark, f"{tmp_path}/t", ["k"], 4)
        Z.batches(Z.stream(spark, source), "x", lambda b, epoch, table=table: Z.upsert(table, b, [F.desc("v")], epoch), f"{tmp_path}/state")
        if more:
            spark.createDataFrame(more, "k long, v string").write.mode("append").parquet(source)
    assert sorted(map(tuple, Z.Table(spark, f"{tmp_path}/t", ["k"], 4).read().collect())) == [(1, "a"), (2, "c"), (3, "d")]


FEED = "seq long, id long, thread string, person string, unread boolean, at timestamp, deleted boolean"


def mailbox(spark, path):
    box = U.Mailbox(spark, path, "id", ["id", "thread", "person", "unread", "at"], 4)
    box.keep("threads", ["thread"], {"unread_n": F.col("unread").cast("long")}, "at")
    return box.keep("people", ["person"], {}, "at")


def test_figures_equal_a_recount(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for seq in range(240):
        at = None if rng.random() < 0.05 else datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=rng.randint(0, 40))
        rows.append((seq, rng.randint(0, 60), rng.choice("abc"), rng.choice(["x", "y", None]), rng.random() < 0.5, at, rng.random() < 0.3))
    for batch in range(4):
        box = mailbox(spark, f"{tmp_path}/m")  # a new one each time, as after a restart
        part = spark.createDataFrame(rows[60 * batch : 60 * batch + 60], FEED)
        box.apply(part, batch)
        if batch == 2:
            mailbox(spark, f"{tmp_path}/m").apply(part, batch)  # comes again
        last = {}
        for r in rows[: 60 * batch + 60]:
            last[r[1]] = r
        live = spark.createDataFrame([r for r in last.values() if not r[6]], FEED)
        for name, (kept, _) in box.figures.items():
            group = kept.group[0]
            want = live.where(f"{group} is not null").groupBy(group).agg(F.count(F.lit(1)).alias("n"), *([F.sum(F.col("unread").cast("long")).alias("unread_n")] if name == "threads" else []), F.min("at").alias("first"), F.max("at").alias("last"))
            assert sorted(map(tuple, kept.read().collect()), key=str) == sorted(map(tuple, want.collect()), key=str), (batch, name)
    assert sorted(r["id"] for r in box.messages.read().collect()) == sorted(r["id"] for r in live.collect())


def test_interrupted_batch_is_finished(spark, tmp_path):
    """One table was changed before the failure; the batch runs again and nothing counts twice."""
    rows = spark.createDataFrame([(0, 1, "a", "x", True, datetime.datetime(2026, 1, 1), False), (1, 2, "a", "y", False, datetime.datetime(2026, 1, 2), False)], FEED)
    box = mailbox(spark, f"{tmp_path}/m")
    box.messages.change = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        box.apply(rows, 0)
    mailbox(spark, f"{tmp_path}/m").apply(rows, 0)
    assert [(r["thread"], r["n"], r["unread_n"]) for r in mailbox(spark, f"{tmp_path}/m").figures["threads"][0].read().collect()] == [("a", 2, 1)]


def letters(rng):
    day = datetime.datetime(2026, 3, 1)
    rows = []
    for i in range(120):
        subject = rng.choice(["", "Re: ", "RE[2]: Fwd: ", "odp: ", "Fwd: "]) + rng.choice(["Budget  review", "ok", "Trip", "Trip: plan"])
        rows.append((rng.choice(["me", "you"]), f"m{i:03d}", subject, day + datetime.timedelta(hours=rng.randint(0, 24 * 40)), rng.random() < 0.2))
    return rows + [("me", "m000", rows[0][2], rows[0][3], rows[0][4]), (None, "n", "Trip", day, False), ("me", "q", None, day, False)]


@pytest.mark.parametrize("order", ["by time", "newest first", "shuffled"])
def test_late_replies_in_any_order(spark, tmp_path, order):
    schema = "account string, id string, subject string, at timestamp, refs boolean"
    rows = letters(random.Random(4))
    every = T.keyed(spark.createDataFrame(rows, schema), "account", "subject", "at", "id", F.col("refs"))
    want = sorted(tuple(r) for r in T.batch_edges(every).select("id", "parent").collect())
    rows = sorted(rows, key=lambda r: r[3], reverse=order == "newest first")
    if order == "shuffled":
        random.Random(1).shuffle(rows)
    for k in range(0, len(rows), 41):
        spark.createDataFrame(rows[k : k + 41], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    messages = T.keyed(Z.stream(spark, f"{tmp_path}/in", files_per_trigger=1), "account", "subject", "at", "id", F.col("refs"))
    table = Z.Table(spark, f"{tmp_path}/edges", ["account", "id"], 4)

    def put(batch, epoch):
        Z.upsert(table, batch.withColumn("epoch", F.lit(epoch)), [F.desc("epoch")], epoch)

    Z.batches(T.reply_edges(messages, "60 days"), "edges", put)
    got = sorted((r["id"], r["parent"]) for r in table.read().where("parent is not null").collect())
    assert got == want and len(want) > 10


def test_references_and_late_replies_make_threads(spark):
    """A message that names two threads merges them; a headerless reply follows its subject."""
    at = datetime.datetime(2026, 1, 1)
    rows = [("me", "a", "Plans", at, []), ("me", "c", "Re: One", at, ["b"]), ("me", "b", "Re: One", at, ["a"]), ("me", "d", "RE: Plans", at + datetime.timedelta(days=2), []), ("me", "e", "Re: Plans", at + datetime.timedelta(days=20), []), ("me", "f", "Plans", at + datetime.timedelta(days=20), [])]
    df = spark.createDataFrame(rows, "account string, id string, subject string, at timestamp, names array<string>")
    late = T.batch_edges(T.keyed(df, "account", "subject", "at", "id", F.size("names") > 0)).select("id", "parent")
    edges = T.reference_edges(df, "account", "id", F.col("names")).select("id", "parent").unionByName(late)
    got = {r["id"]: r["component"] for r in components(edges.select(F.col("id").alias("a"), F.col("parent").alias("b"))).collect()}
    assert got == {x: "a" for x in "abcd"}  # e follows d by 18 days, f is no reply


def test_unechoed_forgets_after_its_time(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [("k", at), ("k", at + datetime.timedelta(minutes=5)), ("j", at), ("k", at + datetime.timedelta(hours=3))]
    for r in rows:
        spark.createDataFrame([r], "k string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = Z.drained(Z.unechoed(Z.stream(spark, f"{tmp_path}/in", files_per_trigger=1), ["k"], "at"), "append", "echo")
    assert sorted(r["k"] for r in got.collect()) == ["j", "k", "k"]
