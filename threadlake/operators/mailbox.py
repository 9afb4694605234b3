"""What a mailbox asks of its messages: flags and folders, fielded ranking, rule figures, recipients, judgments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .search import B, FLOOR, K1

#: Labels that have a flag of their own; bit i stands for the i-th.
FLAGS = ("INBOX", "SENT", "DRAFT", "TRASH", "SPAM", "UNREAD", "STARRED", "IMPORTANT")


def flags(labels: Column) -> Column:
    """The labels that have a flag as bits of one number; null labels have none."""
    bit = lambda i, name: F.when(F.coalesce(F.array_contains(labels, name), F.lit(False)), F.lit(1 << i)).otherwise(0)
    return reduce(lambda a, b: a + b, [bit(i, n) for i, n in enumerate(FLAGS)])


def flagged(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(F.lit(1 << FLAGS.index(name))) != 0


def in_folder(bits: Column, folder: str) -> Column:
    """A folder's messages. ``done`` is what left the inbox, ``anywhere`` is all; only trash, spam and anywhere show what is in trash or spam."""
    hidden = flagged(bits, "TRASH") | flagged(bits, "SPAM")
    if folder == "anywhere":
        return F.lit(True)
    if folder == "done":
        return ~flagged(bits, "INBOX") & ~hidden
    if folder in ("trash", "spam"):
        return flagged(bits, folder.upper())
    return flagged(bits, {"drafts": "DRAFT"}.get(folder, folder.upper())) & ~hidden


def attachment_kind(mime: Column, filename: Column) -> Column:
    """pdf, image, doc, spreadsheet, presentation or other, by media type first and then by the name's ending."""
    m, ext = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when((m == "application/pdf") | (ext == "pdf"), "pdf")
        .when(m.startswith("image/") | ext.isin("png", "jpg", "jpeg", "gif", "webp", "heic"), "image")
        .when(m.contains("spreadsheet") | m.contains("excel") | ext.isin("xls", "xlsx", "csv", "ods"), "spreadsheet")
        .when(m.contains("presentation") | m.contains("powerpoint") | ext.isin("ppt", "pptx", "odp", "key"), "presentation")
        .when(m.contains("msword") | m.contains("wordprocessing") | ext.isin("doc", "docx", "odt", "rtf"), "doc")
        .otherwise("other")
    )


def fielded_bm25(rows: DataFrame, ident: str, fields: dict[str, float], words: list[str]) -> DataFrame:
    """(ident, score) of rows with any of the words; ``fields`` are columns of tokens with their weights.

    A word's frequency is the weighted sum over the fields, lengths are those of all fields together. What scores need is
    written once, narrow, so the texts are tokenised once.
    """
    plain = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    often = lambda c, w: F.size(plain(c)) - F.size(F.array_remove(plain(c), w))
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    cols = {f"tf{i}": total([often(c, w) * F.lit(float(k)) for c, k in fields.items()]) for i, w in enumerate(words)}
    counted = written(rows.select(ident, total([F.size(plain(c)) for c in fields]).alias("dl"), *[v.alias(k) for k, v in cols.items()]), "fielded")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(k) > 0).alias(f"d{k}") for k in cols]).first()
    score = F.lit(0.0)
    for k in cols:
        idf = F.greatest(F.lit(FLOOR), F.log(F.lit((stats["n"] - stats[f"d{k}"] + 0.5) / (stats[f"d{k}"] + 0.5))))
        score += idf * F.col(k) * (K1 + 1) / (F.col(k) + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"] or 1.0)))
    return counted.where(reduce(lambda a, b: a | b, [F.col(k) > 0 for k in cols])).select(ident, score.alias("score"))


def reranked(hits: DataFrame, ident: str, boosts: list[tuple[Column, float]], depth: int = 200) -> DataFrame:
    """The first ``depth`` hits, ordered anew by score plus the weights of the conditions that hold; a condition that is unknown does not."""
    top = hits.orderBy(F.desc("score"), F.asc(ident)).limit(depth)
    return top.withColumn("score", reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(0.0) for c, w in boosts], F.col("score")))


def theoretical(df: DataFrame, score: str, out: str) -> DataFrame:
    """Cosines scaled from their least possible value, -1, to the best one found; between 0 and 1."""
    best = df.agg(F.max(score)).first()[0]
    scaled = F.lit(1.0) if best is None or best <= -1 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(score) + 1) / F.lit(best + 1.0)))
    return df.withColumn(out, scaled)


def newest_matches(df: DataFrame, predicate: Column, at: str, ident: str, k: int | None = None) -> DataFrame:
    """Unranked: rows that match, newest first, at most ``k``; what is unknown does not match."""
    found = df.where(F.coalesce(predicate, F.lit(False)))
    return found if k is None else found.orderBy(F.desc(at), F.desc(ident)).limit(k)


def recipients(df: DataFrame, json: str) -> DataFrame:
    """A row for each ``{name, email}`` of a JSON array; addresses are lower-cased; broken JSON and empty addresses give none."""
    people = F.from_json(json, "array<struct<name:string,email:string>>")
    rows = df.withColumn("__p", F.explode(people)).withColumn("email", F.lower(F.trim("__p.email"))).withColumn("name", F.col("__p.name"))
    return rows.where("email <> ''").drop("__p", json)


def rule_figures(log: DataFrame, rule: str = "rule", at: str = "at") -> DataFrame:
    """For each rule what it did and what it would have done, when it last ran and last failed; ``log`` has matched, dry_run and ok."""
    return log.groupBy(rule).agg(
        F.coalesce(F.sum(F.when(~F.col("dry_run") & F.col("ok"), F.col("matched")).otherwise(0)), F.lit(0)).alias("applied"),
        F.coalesce(F.sum(F.when(F.col("dry_run"), F.col("matched")).otherwise(0)), F.lit(0)).alias("dry_run_matches"),
        F.max(at).alias("last_run"),
        F.max(F.when(~F.col("ok"), F.col(at))).alias("last_error"),
    )


def badges(items: DataFrame, view: str, thread: str, active: Column) -> DataFrame:
    """Threads with an active item, by view."""
    return items.groupBy(view).agg(F.count_distinct(F.when(active, F.col(thread))).alias("n"))


def replied_after(messages: DataFrame, asked: DataFrame, thread: str, at: str, ours: Column) -> DataFrame:
    """``asked`` (thread, since) with whether somebody else wrote later; a thread's messages are first reduced to the latest one that is not ours."""
    last = messages.where(~F.coalesce(ours, F.lit(False))).groupBy(thread).agg(F.max(at).alias("__last"))
    return asked.join(last, thread, "left").withColumn("replied", F.coalesce(F.col("__last") > F.col("since"), F.lit(False))).drop("__last")


def graded(rows: DataFrame, rules: list[tuple[Column, int]], out: str = "grade") -> DataFrame:
    """Judgments by rule: the first rule that holds gives the grade, else 0."""
    return rows.withColumn(out, F.coalesce(*[F.when(c, F.lit(g)) for c, g in rules], F.lit(0)))


def respelled(candidates: DataFrame, partners: DataFrame, query: str, word: str) -> DataFrame:
    """The candidate of each query that most texts share with the query's other words, then that most texts have, then the first by letters.

    ``candidates`` (query, word, df), ``partners`` (query, word, together): texts that hold the candidate and another word of the query.
    """
    both = candidates.join(partners, [query, word], "left").withColumn("together", F.coalesce("together", F.lit(0)))
    w = Window.partitionBy(query).orderBy(F.desc("together"), F.desc("df"), F.asc(word))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
