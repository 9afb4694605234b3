"""Streaming forms: windows with watermarks, deduplication, standing queries, last-writer-wins merges, upserts.

Sources are folders of Parquet files read as streams; a job runs on what is there (``availableNow``) and
keeps its state in a checkpoint below the shared folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..session import shared_dir, written


def stream(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int = 4) -> DataFrame:
    """The Parquet files of a folder whose names fit, as a stream; the schema is their own."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drained(df: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream to its present end. Append: the rows written; complete: the last result; update: the last row of each of ``keys``.

    In update mode a micro-batch writes only what it changed, under its own number, so one that comes twice replaces itself, and
    the state that the watermark has passed is dropped.
    """
    spark = df.sparkSession
    base = shared_dir(spark, name)
    if mode == "append":
        df.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{base}/out")

    if mode == "update":

        def change(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

        df.writeStream.outputMode(mode).foreachBatch(change).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        rest = [c for c in df.columns if c not in keys]
        changed = spark.read.schema(StructType(df.schema.fields + [StructField("epoch", LongType())])).parquet(f"{base}/out")
        return changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("last")).select(*[k for k in keys], "last.*").select(*df.columns)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def batches(df: DataFrame, name: str, put: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Each micro-batch to ``put``, which must give the same result if a batch comes twice; with ``state``, a folder, a later call goes on behind the last batch."""
    state = state or f"{shared_dir(df.sparkSession, name)}/state"
    df.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, at: str, width: str, by: list[str], late: str, slide: str | None = None) -> DataFrame:
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, at: str, gap: str, by: list[str], late: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def first_only(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """One row for each key; what was seen is forgotten once the watermark has passed it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


class Table:
    """A keyed table of Parquet files: rows lie in buckets by the hash of their key, and a change rewrites the buckets it touches.

    Every version is one entry of a log beside the data: which folder holds each bucket, and which batch made it. An entry is written
    behind its data, so a reader sees whole versions only, and a new ``Table`` at the same place goes on where the last one ended,
    after a restart, too. A batch number that the log has already is not merged again.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def entry(self) -> Row | None:
        """The last entry: version, batch, schema, the folders by bucket."""
        try:
            log = self.spark.read.schema("version long, batch long, schema string, folders map<int,string>").parquet(f"{self.path}/log")
        except AnalysisException:
            return None
        return log.orderBy(F.desc("version")).first()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _at(self, entry: Row, buckets: list[int] | None = None) -> DataFrame:
        folders = [p for b, p in sorted(entry["folders"].items()) if buckets is None or b in buckets]
        schema = StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The last version; None if there is none yet."""
        entry = self.entry()
        return None if entry is None else self._at(entry)

    def at_keys(self, keys: DataFrame) -> DataFrame | None:
        """The rows whose key is in ``keys``; only their buckets are read."""
        entry = self.entry()
        if entry is None:
            return None
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # numbers below self.buckets
        return self._at(entry, touched).join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def change(self, rows: DataFrame, into: Callable[[DataFrame | None, DataFrame], DataFrame], batch: int | None = None) -> bool:
        """The buckets that ``rows`` touch become ``into(what they hold, rows)``; False if this batch was merged before.

        ``into`` gets whole buckets and must keep every row in its bucket, that is, not change keys.
        """
        entry = self.entry()
        if entry is not None and batch is not None and entry["batch"] is not None and batch <= entry["batch"]:
            return False
        rows = written(rows, "changes")
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]
        old = None if entry is None else self._at(entry, touched)
        version = 0 if entry is None else entry["version"] + 1
        new = into(old, rows)
        data = f"{self.path}/data/{version:08d}-{uuid.uuid4().hex}"
        dealt = new.withColumn("__bucket", self._bucket()).repartition("__bucket", F.pmod(F.xxhash64(*self.key), F.lit(4 * self.buckets)))
        dealt.write.partitionBy("__bucket").parquet(data)
        try:
            made = {r[0] for r in self.spark.read.parquet(data).select("__bucket").distinct().collect()}
        except AnalysisException:  # nothing is left of these buckets
            made = set()
        folders = {} if entry is None else {b: p for b, p in entry["folders"].items() if b not in touched}
        folders |= {b: f"{data}/__bucket={b}" for b in made}
        row = [(version, batch if batch is not None else entry and entry["batch"], json.dumps(new.schema.jsonValue()), folders)]
        self.spark.createDataFrame(row, "version long, batch long, schema string, folders map<int,string>").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return True


def upsert(table: Table, rows: DataFrame, order: list[Column], batch: int | None = None) -> None:
    """Last copy wins; a batch that comes twice changes nothing."""
    table.change(rows, lambda old, new: latest(new if old is None else old.unionByName(new), table.key, order), batch)


def delete(table: Table, keys: DataFrame, batch: int | None = None) -> None:
    """The rows of these keys go."""
    table.change(keys.select(*table.key), lambda old, gone: gone.limit(0) if old is None else old.join(gone.distinct(), table.key, "left_anti"), batch)


def merge_records(records: DataFrame, key: str, terminal: Column) -> DataFrame:
    """Last writer wins: a terminal phase beats all, then the larger generation, phase and clock, then the larger body."""
    return records.groupBy(key).agg(F.max_by("body", F.struct(terminal, "gen", "phase", "at", "body")).alias("body"))


def claims(matches: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each (rule, message) fires once at most."""
    return first_only(matches, keys, at, late)


def standing_queries(events: DataFrame, rules: list[tuple[str, Column, bool]]) -> DataFrame:
    """(rule, event): rules in order; after a match of a rule that stops, later ones do not see the event."""
    open_ = F.lit(True)
    hits = []
    for name, condition, stops in rules:
        hit = F.coalesce(condition, F.lit(False)) & open_
        hits.append(F.when(hit, F.lit(name)))
        if stops:
            open_ = open_ & ~hit
    return events.withColumn("rule", F.explode(F.filter(F.array(*hits), lambda r: r.isNotNull())))


def breaker(fired: DataFrame, rule: str, at: str, width: str, most: int) -> DataFrame:
    """Rules by window with whether they fired more than ``most`` times in it."""
    return fired.groupBy(rule, F.window(at, width)).agg(F.count(F.lit(1)).alias("n")).withColumn("paused", F.col("n") > most)


class EchoState(StatefulProcessor):
    """When the last event of a key that was let through came."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("echo_ms", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        through = []
        for ms in every["echo_ms"].tolist():
            through.append(last is None or abs(ms - last) > self.ttl_ms)
            if through[-1] and (last is None or ms > last):
                last = ms
        self.last.update((last,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last + self.ttl_ms, timerValues.getCurrentWatermarkInMs()) + 1)
        yield every[through].drop(columns="echo_ms")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unechoed(events: DataFrame, keys: list[str], at: str, ttl: str = "15 minutes") -> DataFrame:
    """Without echoes: an event within ``ttl`` of the last of its keys that was let through is left out, whatever batch it is in. Keys are forgotten once the watermark is that far behind them."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = events.withWatermark(at, ttl).withColumn("echo_ms", F.unix_millis(at))
    return rows.groupBy(*keys).transformWithStateInPandas(EchoState(ttl_ms), events.schema, "Append", "EventTime")


def closed(df: Callable[[DataFrame], DataFrame], events: DataFrame, end: list[tuple], name: str) -> DataFrame:
    """What ``df`` appends over ``events`` once everything is closed: a first run to their present end, then one more on the same checkpoint in which
    the rows ``end``, far in the future, move the watermark past all state."""
    spark, base = events.sparkSession, shared_dir(events.sparkSession, name)
    spark.createDataFrame([], events.schema).write.parquet(f"{base}/end")
    for rows in ([], end):
        spark.createDataFrame(rows, events.schema).coalesce(1).write.mode("append").parquet(f"{base}/end")
        made = df(events.unionByName(spark.readStream.schema(events.schema).parquet(f"{base}/end")))
        made.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/out")
