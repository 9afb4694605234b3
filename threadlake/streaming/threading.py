"""Threads of messages that come in any order: references, and late replies by subject as state.

A headerless reply belongs to the message of its account and subject before it, if that is at most seven days older. Which message that is can
change when an older one comes late, so each (account, subject) keeps its latest messages as state and emits edges (message, parent):
a new edge for a message replaces its last one, and a null parent takes it back. Edges are union edges: threads are the components of the
edges that are valid and of those that references name, and so do not depend on the order in which messages came.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.panels import SUBJECT_DAYS, base_subject
from .streams import ROCKS

WINDOW_MS = SUBJECT_DAYS * 24 * 3600 * 1000
EDGES = "account string, subject string, id string, parent string"


def keyed(messages: DataFrame, account: str, subject: str, at: str, ident: str, refs: Column) -> DataFrame:
    """(account, subject, id, at, late_reply) of messages whose subject can join any: three letters at least, and a known time. ``refs`` says whether a message names others."""
    base, reply = base_subject(F.col(subject))
    rows = messages.select(F.col(account).cast("string").alias("account"), base.alias("subject"), F.col(ident).cast("string").alias("id"), F.col(at).alias("at"), (reply & ~F.coalesce(refs, F.lit(False))).alias("late_reply"))
    return rows.where("account is not null and id is not null and at is not null and length(subject) >= 3")


def parents(seen: list[tuple[int, str, bool]]) -> dict[str, str]:
    """Of each late reply the message before it, if that is near enough; ``seen`` is ordered by (time, id)."""
    return {b[1]: a[1] for a, b in zip(seen, seen[1:], strict=False) if b[2] and b[0] - a[0] <= WINDOW_MS and a[1] != b[1]}


class SubjectState(StatefulProcessor):
    """The messages of one account and subject that can still be somebody's parent or child."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "at long, id string, late_reply boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(x) for x in self.seen.get()]
        held = {x[1] for x in old}
        now = list(old)
        for pdf in rows:
            for at, ident, late in zip(pdf["ms"].tolist(), pdf["id"].tolist(), pdf["late_reply"].tolist(), strict=True):
                if ident not in held:  # a message that comes again is the same one
                    held.add(ident)
                    insort(now, (int(at), ident, bool(late)))
        before, after = parents(old), parents(now)
        changed = [(i, p) for i, p in after.items() if before.get(i) != p] + [(i, None) for i in before if i not in after]
        # what has a later neighbour and is out of any late message's reach is done
        least = timerValues.getCurrentWatermarkInMs() - WINDOW_MS
        kept = [x for k, x in enumerate(now) if x[0] >= least or k == len(now) - 1]
        self.seen.put(kept)
        if old:  # a subject that is new has no timer yet
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(kept[-1][0] + WINDOW_MS, timerValues.getCurrentWatermarkInMs()) + 1)
        if changed:
            yield pd.DataFrame({"account": key[0], "subject": key[1], "id": [c[0] for c in changed], "parent": [c[1] for c in changed]}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def reply_edges(messages: DataFrame, late: str) -> DataFrame:
    """Changes of edges (``EDGES``) from a stream of ``keyed`` rows; messages may be ``late`` by that much."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = messages.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("account", "subject").transformWithStateInPandas(SubjectState(), EDGES, "Append", "EventTime")


def reference_edges(messages: DataFrame, account: str, ident: str, names: Column) -> DataFrame:
    """(account, id, parent) for every message that a message names; what names nothing has none."""
    return messages.select(F.col(account).cast("string").alias("account"), F.col(ident).cast("string").alias("id"), F.explode(names).alias("parent")).where("account is not null and id is not null and parent is not null")


def batch_edges(rows: DataFrame) -> DataFrame:
    """The edges of a whole table of ``keyed`` rows, as the stream leaves them: what it must come to in any order."""
    w = Window.partitionBy("account", "subject").orderBy("at", "id")
    near = F.coalesce(F.unix_millis("at") - F.lag(F.unix_millis("at")).over(w) <= WINDOW_MS, F.lit(False))
    once = rows.dropDuplicates(["account", "subject", "id"])
    return once.withColumn("parent", F.when(F.col("late_reply") & near, F.lag("id").over(w))).where("parent is not null").select("account", "subject", "id", "parent")

