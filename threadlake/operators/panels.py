"""Panels beside a search, and tables kept up to date: people, receipts, meetings, pending scans, first contacts, threads by subject, echoes.

Every operator takes its columns by name. Null keys stand apart as one key unless stated otherwise; empty tables give empty results; ties
are broken by the identifier.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How long a subject keeps its thread open for replies without references, and an own change counts as an echo.
SUBJECT_DAYS, ECHO_MINUTES = 7, 15


def newest_merged(df: DataFrame, account: str, at: str, ident: str, k: int) -> DataFrame:
    """The newest ``k`` rows of all accounts together. Each account first keeps its own newest ``k``, so the last sort sees accounts times k rows."""
    order = [F.desc(at), F.desc(ident)]
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(account).orderBy(*order))).where(F.col("__n") <= k).drop("__n")
    return first.orderBy(*order).limit(k)


def answers(toks: Column, word: str, prefix: bool) -> Column:
    """A word of the name is the word typed, or begins with it; a null name answers to nothing."""
    some = F.exists(toks, lambda t: t.startswith(word)) if prefix else F.array_contains(toks, word)
    return F.coalesce(some, F.lit(False))


def warmth() -> Column:
    """How well a person is known: those written to count three times."""
    return F.col("sent_to") * 3 + F.col("received")


def people_panel(people: DataFrame, ident: str, toks: Column, words: list[tuple[str, bool]], own: list[str] | None = None, k: int = 5) -> DataFrame:
    """The best known ``k`` people who answer to every typed (word, is a prefix) that anybody answers to.

    ``people`` has sent_to and received. Words that match nobody are left out (one job, while the plan is built, counts them in one
    pass); if none is left, or all words have one letter together, nobody is shown. Own addresses are not shown.
    """
    if not words or sum(len(w) for w, _ in words) < 2:
        return people.limit(0)
    known = people.where(F.col("sent_to") + F.col("received") > 0)
    hits = known.agg(*[F.max(answers(toks, w, p)).alias(f"w{i}") for i, (w, p) in enumerate(words)]).first()
    left = [answers(toks, w, p) for i, (w, p) in enumerate(words) if hits[f"w{i}"]]
    if not left:
        return people.limit(0)
    return known.where(reduce(and_, left) & ~F.col(ident).isin(own or [])).orderBy(F.desc(warmth()), F.asc(ident)).limit(k)


def sender_boosts(people: DataFrame, ident: str, toks: Column, words: list[tuple[str, bool]], k: int = 10) -> DataFrame:
    """Whose mail a search lifts: of each typed word of two letters or more, the best known ``k`` who answer to it, each person once."""
    words = [(w, p) for w, p in words if len(w) > 1]
    if not words:
        return people.select(ident).limit(0)
    which = F.array_compact(F.array(*[F.when(answers(toks, w, p), F.lit(i)) for i, (w, p) in enumerate(words)]))
    each = people.where(F.col("sent_to") + F.col("received") > 0).select(ident, warmth().alias("__warm"), F.explode(which).alias("__word"))
    best = Window.partitionBy("__word").orderBy(F.desc("__warm"), F.asc(ident))
    return each.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k).select(ident).distinct()


def month_sums(receipts: DataFrame, day: str, currency: str, amount: str) -> DataFrame:
    """Receipts and sums by month and currency, never converted; refunds are negative amounts, and a null amount counts as a receipt only."""
    return receipts.groupBy(F.trunc(day, "month").alias("month"), currency).agg(F.count(F.lit(1)).alias("receipts"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))


def meetings_with(events: DataFrame, person: str, uid: str, start: str, ident: str, declined: Column) -> DataFrame:
    """Meetings of each person: one for each (uid, start); an event without a uid is its own. Declined ones, or null, do not count."""
    one = F.coalesce(F.concat(F.lit("u"), F.col(uid).cast("string"), F.lit("\n"), F.col(start).cast("string")), F.concat(F.lit("i"), F.col(ident).cast("string")))
    return events.where(~F.coalesce(declined, F.lit(True))).groupBy(person).agg(F.count_distinct(one).alias("meetings"))


def scan_pending(messages: DataFrame, scanned: DataFrame, ident: str, at: str, version: int, most: int | None = None) -> DataFrame:
    """Messages that no scanner of this version has read, newest first, at most ``most``: a new version makes all pending again."""
    done = scanned.where(F.col("version") >= version).select(ident).distinct()
    left = messages.join(done, ident, "left_anti")
    return left if most is None else left.orderBy(F.desc(at), F.desc(ident)).limit(most)


def firsts_after(firsts: DataFrame, messages: DataFrame, added: DataFrame, removed: DataFrame, person: str, seq: str) -> DataFrame:
    """(person, seq) of the first messages after a change. ``messages`` are those from before it, ``removed`` has the seq of those that go.

    A person whose first message goes is counted anew from what is left of their messages, all others keep their row or take an
    earlier new one; so only the people that lost their first message are read again. One without any message left is gone.
    """
    gone = removed.select(seq).distinct()
    kept = firsts.join(gone, seq, "left_anti").select(person, seq)
    lost = firsts.join(gone, seq, "left_semi").select(person)
    anew = messages.join(lost, person, "left_semi").join(gone, seq, "left_anti").select(person, seq)
    fresh = added.join(gone, seq, "left_anti").select(person, seq)
    return kept.unionByName(anew).unionByName(fresh).groupBy(person).agg(F.min(seq).alias(seq))


#: What mail programs put before the subject of a reply and of a forwarded message.
REPLY_MARKS = ("re", "aw", "sv", "vs", "antw", "odp", "ref", "rif")
FORWARD_MARKS = ("fw", "fwd", "wg", "tr", "rv", "enc", "doorst")


def base_subject(subject: Column) -> tuple[Column, Column]:
    """A subject without reply and forward marks, spaces collapsed, lower-cased; and whether a reply mark was there. Null is empty."""
    x = F.coalesce(subject, F.lit(""))
    reply, both = "|".join(REPLY_MARKS), "|".join(REPLY_MARKS + FORWARD_MARKS)
    marks = F.regexp_extract(x, rf"^((?:\s*(?i:{both})\s*(?:\[[^\]:]*\])?\s*:)*)", 1)
    return F.lower(F.trim(F.regexp_replace(F.substr(x, F.length(marks) + 1), r"\s+", " "))), marks.rlike(rf"(?i)\b({reply})\b")


def subject_threads(messages: DataFrame, account: str, subject: str, at: str, ident: str, known: Column) -> DataFrame:
    """``messages`` with their thread: the one that references name (``known``), else, for a reply without any, the latest thread of its
    account and subject if a message of that subject came within seven days before, else the message's own.

    Subjects of fewer than three letters join nothing. Messages arrive in any order: what counts is their time.
    """
    base, reply = base_subject(F.col(subject))
    rows = messages.withColumns({"__base": F.when(F.length(base) >= 3, base).otherwise(F.concat(F.lit("\n"), F.col(ident).cast("string"))), "__known": known.cast("string"), "__reply": reply})
    w = Window.partitionBy(account, "__base").orderBy(at, ident)
    near = F.coalesce(F.col(at) - F.lag(at).over(w) <= F.expr(f"INTERVAL '{SUBJECT_DAYS}' DAY"), F.lit(False))
    own = F.when(~(F.col("__known").isNull() & F.col("__reply") & F.col("__near")), F.coalesce("__known", F.col(ident).cast("string")))
    rows = rows.withColumn("__near", near).withColumn("__own", own)
    return rows.withColumn("thread", F.last("__own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__base", "__known", "__reply", "__near", "__own")


def without_echoes(changes: DataFrame, done: DataFrame, keys: list[str], at: str, minutes: int = ECHO_MINUTES) -> DataFrame:
    """``changes`` that are not the echo of an own one: the same keys, done at most ``minutes`` before. One ordered list by key, no inequality join."""
    both = changes.withColumn("__own", F.lit(False)).unionByName(done.select(*keys, at).withColumn("__own", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, F.desc("__own")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__own"), F.col(at)), ignorenulls=True).over(w)
    echo = F.coalesce(F.col(at) - last <= F.expr(f"INTERVAL '{minutes}' MINUTE"), F.lit(False))
    return both.withColumn("__echo", echo).where(~F.col("__own") & ~F.col("__echo")).drop("__own", "__echo")


def address_uses(messages: DataFrame, person: str, address: str, sent: Column) -> DataFrame:
    """Contact details: how often each of a person's addresses wrote and was written to; unknown directions count for neither."""
    s = F.coalesce(sent, F.lit(None).cast("boolean"))
    return messages.groupBy(person, address).agg(F.count_if(~s).alias("from_them"), F.count_if(s).alias("to_them"))


def topic_counts(messages: DataFrame, toks: Column, words: list[str], thread: str) -> DataFrame:
    """How often a topic comes up: messages with any of its words, and their threads; one row."""
    said = reduce(or_, [F.array_contains(toks, w) for w in words], F.lit(False))
    threads = messages.where(F.coalesce(said, F.lit(False))).groupBy(thread).agg(F.count(F.lit(1)).alias("__n"))
    return threads.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("messages"), F.count(F.lit(1)).alias("threads"))


def in_tense(day: Column, today: Column, tense: str) -> Column:
    """``past``: before today; ``future``: from today on; a null day is in neither."""
    return F.coalesce(day < today if tense == "past" else day >= today, F.lit(False))


def latest_of_kind(items: DataFrame, person: str, kind: str, at: str, ident: str) -> DataFrame:
    """The newest item of each person and kind, by one aggregate."""
    return items.groupBy(person, kind).agg(F.max_by(ident, F.struct(at, ident)).alias(ident), F.max(at).alias(at))
