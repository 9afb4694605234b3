"""Phrases whose words keep company, found with word-id suffix arrays.

A text, A-Z lower-cased, is cut into pieces at ``SEPARATORS`` and the pieces into words at spaces and tabs. All is counted for
each language by itself (null: ``und``): n are its word occurrences, f a phrase's contiguous occurrences within pieces.
Candidates are phrases of 2 to ``MOST`` words with a = f >= ``least``. A cut after the first k words gives l and r, the f of both parts, and
the score floor(1000000 a a / (l r)); the lowest-scoring cut counts, ties to the smallest k. A candidate whose words lie
contiguously inside a longer candidate with 100 f(longer) >= ``percent`` a is dropped. What is left is ranked by score, a (both
descending) and phrase (bytes, ascending).

Blocks of documents (``blocks``) are the shards of text: the numbers of a block's words stand one after another with a mark of its own
behind each piece, the suffix array is built by prefix doubling, and the intervals in which neighbours agree in n words are the n-grams and their counts.
They are merged globally by key in one round for each n. No part of a phrase is rarer than the phrase, so words below ``least``
end a piece for n = 2, and n-grams with a part below it are not sent: whatever is left out cannot be a candidate.

Null and empty texts have no words. Repeated rows count as often as they occur; languages that differ in case or space
are different. An empty table gives an empty result; only language and text are read. Numbers are exact: the products are Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .blocks import Block, answered, asks, distinct, gaps, gaps_within, mixed, pack, summed_within, unpack, word_keys
from .common import written
from .decontaminate import suffix_array

LEAST, MOST, PERCENT, TOP = 10, 3, 50, 2000
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: The bytes at which a text is cut into pieces, besides line ends: fixed by the rule.
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_TO_LINES = bytes(10 if b in SEPARATORS else b for b in range(256))
BREAK = b"\xff"
PHRASE = "lang string, ids array<long>, a long, l long, r long, score long"


def words_of(text: bytes, lang: bytes) -> list[bytes]:
    """The words, each behind its language, and a break after each piece."""
    spaced = text.lower().translate(_TO_LINES).replace(b"\n", b" \xff ").split()
    return [lang + blocks.PART + w if w != BREAK else BREAK for w in spaced] + [BREAK]


def tokens_of(text: bytes, batch: pa.RecordBatch, row: int) -> list[bytes]:
    return words_of(text, (batch.column(0)[row].as_py()).encode())


def ask_words(shards: int):
    def ask(b: Block, number: int):
        counts = np.bincount(b.tokens, minlength=len(b.words))
        key = word_keys(b.words)
        return asks(key, number, shards, lambda at: pack(counts[at], meta=blocks.NEXT.join(b.words[i] if b.words[i] != BREAK else b"" for i in at)))

    return ask


def answer_words(shards: int, least: int):
    """Numbers (from 1, 0: too rare, or the break) and counts; about the shard: its frequent words, and occurrences by language."""

    def answer(shard: int, ids: list[int], payloads: list[bytes]):
        total: dict[bytes, int] = {}
        given = []
        for p in payloads:
            meta, (counts,) = unpack(p)
            words = meta.split(blocks.NEXT)
            given.append(words)
            for w, c in zip(words, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        total.pop(b"", None)
        known = sorted((w for w, c in total.items() if c >= least), key=lambda w: (-total[w], w))  # frequent words have small numbers
        number = {w: i * shards + shard + 1 for i, w in enumerate(known)}
        for i, words in zip(ids, given, strict=True):
            yield i, pack(np.array([number.get(w, 0) for w in words], np.int64), np.array([total[w] if w in number else 0 for w in words], np.int64))
        sums: dict[str, int] = {}
        for w, c in total.items():
            lang = w.split(blocks.PART, 1)[0].decode()
            sums[lang] = sums.get(lang, 0) + c
        yield None, pack(np.array(list(number.values()), np.int64), np.array([total[w] for w in known], np.int64), meta=(sums, known))

    return answer


def intervals(t: np.ndarray, order: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a position, how many) of each n-gram: the runs of the suffix array in which neighbours' common prefix has n words. ``room`` is how many words each position has before its piece ends."""
    fit = order[room[order] >= n]
    common = np.ones(max(len(fit) - 1, 0), bool)
    for k in range(n):
        common &= t[fit[1:] + k] == t[fit[:-1] + k]
    first = np.flatnonzero(np.append(True, ~common)) if len(fit) else np.zeros(0, np.int64)
    return fit[first], np.diff(np.append(first, len(fit)))


class Pieces:
    """A block's pieces with rare words as breaks, and their suffix array."""

    def __init__(self, b: Block):
        self.b = b
        self.number, self.count = (a[b.tokens] for a in b.kept("1"))
        stop = self.number == 0
        n = len(stop)
        ends = int(stop.sum())
        self.t = np.where(stop, np.cumsum(stop) - 1, b.tokens.astype(np.int64) + ends)  # marks first, each its own
        after = np.where(stop, np.arange(n), n)
        self.room = np.minimum.accumulate(after[::-1])[::-1] - np.arange(n)
        self.order = suffix_array(self.t)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return intervals(self.t, self.order, self.room, n)

    def langs(self, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The languages of these positions, and each one's index among them."""
        names: dict[bytes, int] = {}
        of_word = np.array([names.setdefault(w.split(blocks.PART, 1)[0], len(names)) for w in self.b.words], np.int64)
        return [x.decode() if x != BREAK else "" for x in names], of_word[self.b.tokens[at]]

    def keys(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        return [self.number[at + k] for k in range(n)]

    def ask(self, n: int, at: np.ndarray, times: np.ndarray, number: int, shards: int):
        """n-grams at these positions: their words' numbers, counts and languages."""
        keys = self.keys(at, n)
        names, lang = self.langs(at)
        payload = lambda i: pack(gaps(keys[0][i]), gaps_within(keys[1][i], keys[0][i]), *[k[i] for k in keys[2:]], times[i], lang[i], meta=names)
        return asks(mixed(*keys), number, shards, payload, tuple(keys))

    def answers(self, n: int, at: np.ndarray, shards: int, payloads: list[bytes]) -> np.ndarray:
        keys = self.keys(at, n)
        return answered(mixed(*keys), shards, payloads, 1, tuple(keys))[0]

    def pair_counts(self, shards: int, payloads: list[bytes]) -> np.ndarray:
        """f of the two words from each position on, 0 where that is rare or no pair."""
        at, times = self.grams(2)
        out = np.zeros(len(self.t), np.int64)
        fit = self.order[self.room[self.order] >= 2]
        out[fit] = np.repeat(self.answers(2, at, shards, payloads), times)
        return out


def cut_scores(a: int, cuts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(score, l, r) of the lowest-scoring cut, the first of equals."""
    scored = [(1_000_000 * a * a // (left * right), left, right) for left, right in cuts]
    return min(scored, key=lambda s: s[0])


def answer_grams(n: int, least: int):
    """How often each n-gram occurs, 0 below ``least``; about the shard: its candidates."""

    def answer(shard: int, ids: list[int], payloads: list[bytes]):
        names: dict[str, int] = {}
        parts = []
        for p in payloads:
            own, arrays = unpack(p)
            arrays[0] = np.cumsum(arrays[0])
            arrays[1] = summed_within(arrays[1], arrays[0])
            arrays[n + 1] = np.array([names.setdefault(x, len(names)) for x in own], np.int64)[arrays[n + 1]]
            parts.append(arrays)
        if not parts:
            return
        cols = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
        first, which = distinct(*cols[:n])
        total = np.bincount(which, weights=cols[n]).astype(np.int64)
        total[total < least] = 0
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        for i, lo, hi in zip(ids, cut[:-1], cut[1:], strict=True):
            yield i, pack(total[which[lo:hi]])
        at = first[total > 0]
        yield None, pack(*[c[at] for c in cols[:n]], total[total > 0], cols[n + 1][at], meta=list(names))

    return answer


def candidates(came: DataFrame, n: int) -> DataFrame:
    """(lang, ids, a): the shards' candidates of n words as rows."""

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                names, cols = unpack(p)
                for start in range(0, len(cols[0]), 1 << 16):
                    part = [c[start : start + (1 << 16)] for c in cols]
                    m = len(part[0])
                    ids = pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, n), pa.int32()), pa.array(np.stack(part[:n], 1).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in part[n + 1]], pa.string()), ids, pa.array(part[n])], names=["lang", "ids", "a"])

    return came.where("block is null").select("payload").mapInArrow(run, "lang string, ids array<long>, a long")


def scored(found: DataFrame) -> DataFrame:
    """``PHRASE`` of candidates with ``parts``, the f of both parts of each cut; Python's integers keep the products exact."""

    def run(batches):
        for batch in batches:
            made = [cut_scores(a, list(zip(p[::2], p[1::2], strict=True))) for a, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2, 0))], names=["lang", "ids", "a", "l", "r", "score"])

    return found.select("lang", "ids", "a", "parts").mapInArrow(run, PHRASE)


def frequent_words(came: DataFrame) -> DataFrame:
    """(id, word, f) of the words that are not rare."""

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                (_, known), (ids, counts) = unpack(p)
                words = [w.split(blocks.PART, 1)[1] for w in known]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts)], names=["id", "word", "f"])

    return came.where("block is null").select("payload").mapInArrow(run, "id long, word string, f long")


def occurrences(came: DataFrame) -> DataFrame:
    """(lang, n) of all words."""

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                sums = unpack(p)[0][0]
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "n"])

    return came.where("block is null").select("payload").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def mined(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidates that are not dropped (``PHRASE``, words by number), the words (id, word), and (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    of = blocks.blocks_of(rows, tokens_of, "phrase-blocks")
    shards = of.shards
    words = written(spark, blocks.by_shard(blocks.first_asks(of, ask_words(shards)), of, answer_words(shards, least)), "phrase-words")

    def pairs(number: int, uri: str, payloads: list[bytes]) -> pa.Table:
        b = Block(uri)
        b.keep("1", *answered(word_keys(b.words), shards, payloads, 2))
        p = Pieces(b)
        at, times = p.grams(2)
        return blocks.sent(p.ask(2, at, times, number, shards))

    def triples(number: int, uri: str, payloads: list[bytes]) -> pa.Table:
        p = Pieces(Block(uri))
        pair = p.pair_counts(shards, payloads)
        at, times = p.grams(3)
        some = (pair[at] > 0) & (pair[at + 1] > 0)
        at, times = at[some], times[some]
        return blocks.sent(p.ask(3, at, times, number, shards))

    twos = written(spark, blocks.by_shard(blocks.by_block(words, of, pairs, blocks.ROW), of, answer_grams(2, least)), "phrase-pairs")
    threes = written(spark, blocks.by_shard(blocks.by_block(twos, of, triples, blocks.ROW), of, answer_grams(3, least)), "phrase-triples")
    two, three = written(spark, candidates(twos, 2), "phrase-candidates"), written(spark, candidates(threes, 3), "phrase-candidates")
    vocabulary = written(spark, frequent_words(words), "phrase-vocabulary")
    inside = three.select(F.explode(F.array(F.slice("ids", 1, 2), F.slice("ids", 2, 2))).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    alone = two.join(inside, "ids", "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))

    def word(i: int) -> DataFrame:
        return vocabulary.select(F.col("id").alias(f"w{i}"), F.col("f").alias(f"f{i}"))

    def pair(name: str) -> DataFrame:
        return two.select(F.col("ids").alias(name), F.col("a").alias(f"f_{name}"))

    at = lambda i: F.get("ids", F.lit(i)).alias(f"w{i}")
    alone = alone.select("lang", "ids", "a", at(0), at(1)).join(word(0), "w0").join(word(1), "w1").withColumn("parts", F.array("f0", "f1"))
    # all parts of a candidate are frequent, too, so every join finds its row
    longer = three.select("lang", "ids", "a", at(0), at(2), F.slice("ids", 1, 2).alias("head"), F.slice("ids", 2, 2).alias("tail"))
    longer = longer.join(pair("head"), "head").join(pair("tail"), "tail").join(word(0), "w0").join(word(2), "w2").withColumn("parts", F.array("f0", "f_tail", "f_head", "f2"))
    columns = ["lang", "ids", "a", "parts"]
    return scored(alone.select(columns).unionByName(longer.select(columns))), vocabulary.select("id", "word"), occurrences(words)


def phrases(docs: DataFrame, top: int | None = TOP, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases, or all."""
    spark = docs.sparkSession
    found, words, n = mined(docs, lang_col, text_col, least, percent)
    if top:
        # by number first: ties at the last place stay until their words are known. A language is dealt out before its first are put together
        order = F.desc("score"), F.desc("a")
        for part in ([F.col("lang"), F.pmod(F.xxhash64("ids"), F.lit(PARTS))], [F.col("lang")]):
            found = found.withColumn("near", F.rank().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("near") <= top).drop("near")
    found = written(spark, found, "phrase-ranked")
    spelled = found.select("ids", F.posexplode("ids").alias("at", "id")).join(words, "id").groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = found.join(spelled, "ids").join(n, "lang")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = named.withColumn("rank", F.row_number().over(by).cast("long"))
    if top:
        named = named.where(F.col("rank") <= top)
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
