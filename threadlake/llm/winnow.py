"""Document fingerprints by winnowing, in DataFrame expressions alone.

Every ``K`` characters in a row are a gram, and its hash is the polynomial residue (CRC-32) of their code points: the
value that a rolling update would have, taken from the bytes of each gram, as SQL functions have no running state. Of
each ``W`` grams in a row the smallest hash is taken, of equal ones the rightmost, and kept with its position (in
characters). So two texts that share K + W - 1 characters in a row share a fingerprint, wherever the passage stands
and whether or not there is white space in it.

Hash and position are packed in one number (32 and 31 bits), of which the smallest is the winnowed one, and the minimum
over a window is built by doubling: log2(W) passes over an array. A text is taken in pieces of ``PIECE`` windows, which
overlap by what a window needs, so the arrays of a very long text stay short.
The likeness of two fingerprints is the Jaccard index of their distinct hashes; two empty ones have 1.

A text with fewer than K + W - 1 characters is one window, one with fewer than K one gram; a null or empty text has
the empty fingerprint. Equal texts have equal fingerprints. For the next document, rows are ordered
by identifier descending, then text; null identifiers come last. Rows are dealt to ranges of the identifier, and
the first row of the following range is sent along, so no window needs all rows. Repeated rows
are neighbours of each other; a single row is its own neighbour; an empty table gives an empty
result; only the identifier and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import bucket_of, is_cut, range_cuts

K, W = 16, 16
PIECE = 4096
LEAST = -(2**63)
LOW31 = 2**31 - 1


def nothing() -> Column:
    return F.array().cast("array<bigint>")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: an expression that is merely named is put in wherever the name stands, into loops as well."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def packed(crc: Column, position: Column) -> Column:
    """The hash above, 2^31 - 1 minus the position below."""
    return F.shiftleft(crc, 31) + (F.lit(LOW31) - position)


def grams(text: Column, first: Column) -> Column:
    """Every gram of the text, whose first character stands at position ``first``. A character is four bytes in UTF-32."""
    each = lambda points: F.transform(F.sequence(F.lit(1), F.length(points) - (4 * K - 1), F.lit(4)), lambda at, i: packed(F.crc32(F.substring(points, at, F.lit(4 * K))), first + i))
    return bound(F.encode(text, "UTF-32"), each)


def lesser(a: Column, by: int) -> Column:
    """The smaller of a[i] and a[i + by]."""
    n = F.size(a) - by
    return F.zip_with(F.slice(a, 1, n), F.slice(a, by + 1, n), lambda x, y: F.when(x < y, x).otherwise(y))


def minima(grams_: Column) -> Column:
    """The smallest of every W neighbours, each once, in order of position."""
    by, now = 1, grams_
    levels = []
    while by < W:
        levels.append(by)
        by *= 2

    def rest(a: Column, steps: list[int]) -> Column:
        return F.array_distinct(lesser(a, steps[0])) if len(steps) == 1 else bound(lesser(a, steps[0]), lambda b: rest(b, steps[1:]))

    return bound(now, lambda a: rest(a, levels))


def windows(text: Column, start: Column, end: Column) -> Column:
    """What the windows whose first grams stand at ``start`` to ``end`` - 1 select, piece by piece."""
    piece = lambda at: F.substring(text, at + 1, F.least(F.lit(PIECE), end - at) + (K + W - 2))
    return F.when(end > start, F.flatten(F.transform(F.sequence(start, end - 1, F.lit(PIECE)), lambda at: minima(grams(piece(at), at))))).otherwise(nothing())


def short(text: Column) -> Column:
    """The fingerprint of a text with less than a whole window."""
    one = F.array(packed(F.crc32(F.encode(text, "UTF-32")), F.lit(0)))
    return F.when(F.length(text) >= K, F.array(F.array_min(grams(text, F.lit(0))))).when(F.length(text) > 0, one).otherwise(nothing())


def last_window(text: Column) -> Column:
    """How many whole windows a text has."""
    return F.length(text) - (K + W - 2)


def winnowed(text: Column, shared: Column | None = None, start: Column | None = None) -> Column:
    """The fingerprint as an array of packed numbers; ``shared``: what the windows before ``start`` select, where that is known."""
    whole = windows(text, F.lit(0), last_window(text)) if shared is None else F.concat(shared, windows(text, start, last_window(text)))
    return F.when(last_window(text) > 0, F.array_distinct(whole)).otherwise(short(text))


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: F.shiftright(p, 31)))


def shown(prints: Column) -> Column:
    """position:hash, comma-joined; both hexadecimal."""
    return F.array_join(F.transform(prints, lambda p: F.concat(F.lower(F.hex(F.lit(LOW31) - p.bitwiseAND(F.lit(LOW31)))), F.lit(":"), F.lower(F.hex(F.shiftright(p, 31))))), ",")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


ORDER = ("range", "guest", "key")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, WindowSpec]:
    """Each row with the text of the next one, by descending identifier, after the last the first; and the window that says so.

    Rows with ``guest`` over 0 stand in for the rows of other ranges and are to be left out in the end.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))
    cuts = range_cuts(docs, key, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    top = docs.agg(F.max(key)).first()[0]
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key"))
    at = bucket_of(F.col("key"), cuts)
    # a range ends, downwards, before the largest key of the range below it: that row follows as a guest; the first row of all follows the last range
    guests = F.when(F.col("key") == F.lit(top), F.lit(0))
    below = F.when(is_cut(F.col("key"), at, cuts), at + 1)
    places = F.filter(F.array(F.struct(at.alias("range"), F.lit(0).alias("guest")), F.struct(below.alias("range"), F.lit(1).alias("guest")), F.struct(guests.alias("range"), F.lit(2).alias("guest"))), lambda p: p["range"].isNotNull())
    dealt = rows.select("*", F.inline(places)).repartitionById(len(cuts) + 1, F.col("range"))
    order = Window.partitionBy("range").orderBy("guest", F.desc("key"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)), order


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by the first as many of the following text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint, prints (packed numbers) of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.select(id_col, winnowed(F.col("__text")).alias("prints"))
    return rows.select(id_col, shown(F.col("prints")).alias("fingerprint"), "prints")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row."""
    rows, order = with_next(docs, id_col, text_col)
    third = edited(F.col("text"), F.coalesce("next_text", F.lit("")))
    # the windows that end before the edited part are the same in both texts and looked at once
    kept = F.greatest(F.length("text") - F.floor(F.length("text") / 3).cast("int") - (K + W - 2), F.lit(0))
    made = rows.select(id_col, *ORDER, F.length("text").cast("long").alias("n_chars"), "text", F.when(F.col("guest") == 0, third).alias("changed"), kept.alias("kept"))
    made = made.withColumn("head", windows(F.col("text"), F.lit(0), F.col("kept")))
    each = lambda c: winnowed(F.col(c), F.col("head"), F.col("kept"))
    made = made.select(id_col, *ORDER, "text", "n_chars", F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), each("text").alias("own"), F.when(F.col("guest") == 0, each("changed")).alias("near"))
    made = made.withColumn("following", F.lead("own").over(order)).where("guest = 0")
    sets = made.select(id_col, "n_chars", "edited_sha256", "own", "near", hashes(F.col("own")).alias("h0"), hashes(F.col("near")).alias("h1"), hashes(F.col("following")).alias("h2"))
    return sets.select(
        id_col,
        "n_chars",
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("near")).alias("edited_fingerprint"),
        likeness(F.col("h0"), F.col("h1")).cast("double").alias("near_edited"),
        likeness(F.col("h0"), F.col("h2")).cast("double").alias("near_next"),
    )
