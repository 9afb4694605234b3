"""Messages in threads: roll-ups, reply states, waits, views. Order within a thread is the sequence number, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(messages: DataFrame, thread: str, seq: str, sender: str, text: str) -> DataFrame:
    """First non-empty text as the subject, latest as the snippet, the number of messages and of senders, the last position."""
    nonempty = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, F.struct(F.col(seq), F.col(text)))
    return messages.groupBy(thread).agg(
        F.min(nonempty).getField(text).alias("subject"),
        F.max_by(text, seq).alias("snippet"),
        F.count(F.lit(1)).alias("messages"),
        F.count_distinct(sender).alias("senders"),
        F.max(seq).alias("last_seq"),
    )


def later(condition: Column, thread: str, seq: str) -> Column:
    """Whether a later message of the thread meets the condition; one window instead of a self-join."""
    w = Window.partitionBy(thread).orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(condition).over(w), F.lit(False))


def earlier(condition: Column, thread: str, seq: str) -> Column:
    w = Window.partitionBy(thread).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(condition).over(w), F.lit(False))


def reply_states(messages: DataFrame, thread: str, seq: str, sent: Column, received: Column) -> DataFrame:
    """unanswered: received and nothing sent later. replied: received and sent later. awaiting: sent and nothing received later. reply: not the first."""
    m = messages.withColumns({"__s": sent, "__r": received})
    sent_later, received_later = later(F.col("__s"), thread, seq), later(F.col("__r"), thread, seq)
    return m.withColumns(
        {
            "unanswered": F.col("__r") & ~sent_later,
            "replied": F.col("__r") & sent_later,
            "awaiting": F.col("__s") & ~received_later,
            "reply": earlier(F.lit(True), thread, seq),
        }
    ).drop("__s", "__r")


def waits(messages: DataFrame, thread: str, seq: str, sent: Column, received: Column) -> DataFrame:
    """For each message sent after an unanswered one: the first received message that it answers and the steps between."""
    block = F.sum(sent.cast("int")).over(Window.partitionBy(thread).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    m = messages.withColumns({"__b": F.coalesce(block, F.lit(0)), "__s": sent, "__r": received})
    answered = m.groupBy(thread, "__b").agg(F.min(F.when(F.col("__r"), F.col(seq))).alias("received_at"), F.max(F.when(F.col("__s"), F.col(seq))).alias("sent_at"))
    return answered.where("received_at is not null and sent_at > received_at").select(thread, "received_at", "sent_at", (F.col("sent_at") - F.col("received_at")).alias("wait"))


def page(threads: DataFrame, before: int, n: int, key: str, ident: str) -> DataFrame:
    """Keyset pagination: the n newest before a position."""
    return threads.where(F.col(key) < before).orderBy(F.desc(key), F.desc(ident)).limit(n)


def membership(messages: DataFrame, thread: str, seq: str, views: dict[str, Column], unread: Column) -> DataFrame:
    """(view, thread): the last position and whether anything is unread, for every view a message belongs to."""
    names = F.filter(F.array(*[F.when(c, F.lit(v)) for v, c in views.items()]), lambda v: v.isNotNull())
    return messages.select(thread, seq, unread.alias("u"), F.explode(names).alias("view")).groupBy("view", thread).agg(F.max(seq).alias("last_seq"), F.max("u").alias("unread"))


def newest_per_key(df: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
