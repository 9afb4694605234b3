"""Sources and sinks around messages: provider JSON, MIME files, calendars, receipts, TREC runs, envelopes."""

from __future__ import annotations

import email
import email.policy
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "id string, threadId string, labelIds array<string>, internalDate string, snippet string, payload struct<headers:array<struct<name:string,value:string>>>"


def header(headers: Column, name: str) -> Column:
    """The first header of that name, whatever its case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def from_provider_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """A provider's message JSON as columns; text that is not JSON gives nulls."""
    m = rows.select(F.from_json(column, PROVIDER).alias("m"))
    heads = F.col("m.payload.headers")
    return m.select(
        F.col("m.id").alias("id"),
        F.col("m.threadId").alias("thread"),
        F.col("m.labelIds").alias("labels"),
        F.timestamp_millis(F.col("m.internalDate").cast("long")).alias("date"),
        F.lower(F.trim(F.regexp_extract(header(heads, "From"), r"([^<>\s]+@[^<>\s]+)", 1))).alias("sender"),
        header(heads, "Subject").alias("subject"),
        F.col("m.snippet").alias("snippet"),
    )


def with_labels(messages: DataFrame, add: Column, remove: Column, labels: str = "labels") -> DataFrame:
    """Label deltas: what is added is there once, what is removed is gone."""
    return messages.withColumn(labels, F.array_except(F.array_union(F.coalesce(labels, F.array().cast("array<string>")), add), remove))


def mime_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file of a folder as a message: sender, subject, date, text. A part in a broken charset is decoded with replacements."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                m = email.message_from_bytes(data, policy=email.policy.default)
                body = m.get_body(("plain", "html"))
                try:
                    text = body.get_content() if body else ""
                except (LookupError, UnicodeDecodeError):
                    text = body.get_payload(decode=True).decode("utf-8", "replace")
                rows.append((p, str(m["from"] or ""), str(m["subject"] or ""), str(m["message-id"] or ""), text))
            yield pd.DataFrame(rows, columns=["path", "sender", "subject", "message_id", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, sender string, subject string, message_id string, text string")


def calendar_events(rows: DataFrame, column: str = "ics") -> DataFrame:
    """uid, summary, start, end, zone, rule, exceptions and attendees of each VEVENT of an iCalendar text; folded lines are unfolded first.

    Start, end and exceptions are local times of the zone (null: UTC, or a time of no zone); ``operators.recurrence`` expands them.
    """
    unfolded = F.regexp_replace(F.coalesce(column, F.lit("")), r"\r?\n[ \t]", "")
    pieces = F.filter(F.split(unfolded, "BEGIN:VEVENT"), lambda p: p.contains("END:VEVENT"))
    events = rows.select(F.explode(F.transform(pieces, lambda p: F.substring_index(p, "END:VEVENT", 1))).alias("v"))
    value = lambda name: rf"(?m)^{name}(?:;(?:\"[^\"\r\n]*\"|[^:\"\r\n])*)?:([^\r\n]*)"
    field = lambda name: F.nullif(F.trim(F.regexp_extract("v", value(name), 1)), F.lit(""))
    time = lambda x: F.coalesce(F.try_to_timestamp(F.regexp_replace(x, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(x, F.lit("yyyyMMdd")))
    left_out = F.flatten(F.transform(F.regexp_extract_all("v", F.lit(value("EXDATE")), F.lit(1)), lambda x: F.split(x, ",")))
    return events.select(
        field("UID").alias("uid"),
        field("SUMMARY").alias("summary"),
        time(field("DTSTART")).alias("start"),
        time(field("DTEND")).alias("end"),
        F.nullif(F.regexp_extract("v", r"(?m)^DTSTART[^:\r\n]*;TZID=\"?([^;:\"\r\n]+)", 1), F.lit("")).alias("zone"),
        field("RRULE").alias("rule"),
        F.filter(F.transform(left_out, lambda x: time(F.trim(x))), lambda t: t.isNotNull()).alias("exceptions"),
        F.transform(F.regexp_extract_all("v", F.lit(value("ATTENDEE")), F.lit(1)), lambda a: F.lower(F.regexp_replace(F.trim(a), r"(?i)^mailto:", ""))).alias("attendees"),
    )


def read_receipts(rows: DataFrame, column: str = "text") -> DataFrame:
    """Final recipient, original message and disposition of a receipt; rows that are none are left out."""
    field = lambda name: F.trim(F.regexp_extract(column, rf"(?im)^{re.escape(name)}:\s*(?:rfc822;)?\s*([^\r\n]+)", 1))
    out = rows.select(F.lower(field("Final-Recipient")).alias("recipient"), field("Original-Message-ID").alias("original"), F.lower(F.regexp_extract(field("Disposition"), r"([a-z]+)\s*$", 1)).alias("disposition"))
    return out.where("original <> '' and disposition <> ''")


def envelopes(rows: DataFrame, kind: str, version: int = 1) -> DataFrame:
    """One JSON object for each row, with its kind and version."""
    return rows.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(kind).alias("kind"), F.struct("*").alias("data"))).alias("value"))


def write_trec_run(run: DataFrame, path: str, tag: str, query: str = "query", doc: str = "doc") -> None:
    """Lines of query, Q0, document, rank, score and tag."""
    run.select(F.concat_ws(" ", F.col(query), F.lit("Q0"), F.col(doc), F.col("rank"), F.format_string("%.6f", F.col("score").cast("double")), F.lit(tag)).alias("value")).write.mode("overwrite").text(path)


def compacted(spark: SparkSession, path: str, to: str, rows_per_file: int = 5_000_000) -> None:
    """The same rows in fewer files."""
    spark.read.parquet(path).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(to)


def without_old_bodies(messages: DataFrame, date: str, before: str, columns: list[str]) -> DataFrame:
    """Bodies of messages before a day set to null; the rows stay."""
    old = F.col(date) < F.lit(before).cast("timestamp")
    return messages.withColumns({c: F.when(~F.coalesce(old, F.lit(False)), F.col(c)) for c in columns})
