"""Language-model scoring with an n-gram trie of Elias-Fano levels.

The model is an interpolated n-gram model with hierarchical Dirichlet smoothing:

    p1(w)         = (c(w) + 1) / (N + V + 1)
    pk(w | ctx)   = (c(ctx w) + MU[k] * pk-1(w | shorter ctx)) / (c(ctx) + MU[k])

It sums to one for every context. A context of two words or more has a level of its own from ``min_context`` occurrences
on, below that its shorter context speaks; this is part of the model at every size, no count is dropped. A text's score is the sum of the
logarithms of its words and one end; the first word has no context.

A level of the trie holds, for each context (a node of the level above), its successors:

* contexts: an ascending Elias-Fano sequence of their numbers;
* pointers: an Elias-Fano sequence of where each context's successors begin;
* successors: word numbers made strictly ascending over the whole level by adding the last value of the context before
  (one Elias-Fano sequence); a query searches the successor of that base plus its word;
* counts: an Elias-Fano sequence of their running sums, so a count takes about two bits more than the mean one.

Probabilities follow from counts, are smoothed and kept in steps of 1/``STEP`` of a decade.

Levels are cut into shards by context (a context of more than ``SPLIT`` occurrences also by successor). Each is one file in the
shared folder that is memory-mapped and searched (copied to the executor's own disk first where the folder is not a local file
system). Documents meet the shards in rounds (``blocks``): a block sends its distinct n-grams with its own counts, the shard builds
its level from those of training documents and answers for all. Nothing is broadcast and no task sees the whole model.

What travels and what blocks keep between rounds is what the other side cannot know: shards answer how often *other* blocks have
an n-gram, mostly not at all, and blocks find the probability themselves. Words are numbered by the length of their count, then by the
first block that has them, so the rare words of a block have numbers close together, however large the vocabulary is.

Null and empty texts have the end alone. Repeated rows count as often as they occur. Rows of unknown training status
(a null flag) are not learned from. With nothing to learn from, every word is unknown: N = V = 0. An empty table gives an
empty result; other columns are not read. A document is never split, so a block is at least as long as its longest document.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import Block, arranged, asks, distinct, gaps, gaps_within, mixed, pack, summed_within, unpack, word_keys
from .common import fs_of, put_file, shared_dir, written

ORDER = 3
MU = {2: 500.0, 3: 20.0}
MIN_CONTEXT = 8
STEP = 64
#: Occurrences of a context in one shard, about.
SPLIT = 500_000
#: A block in usual ones: larger blocks have fewer distinct n-grams a token and send fewer rows, and need more memory.
BLOCK = 2
#: The end of a text: no word has this byte.
END = b"\xff"


def packed(values: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    """Numbers of ``bits`` bits (one for all or one each), one after another in 64-bit words; one word more, so that two can always be read."""
    bits = np.broadcast_to(np.int64(bits), len(values))
    ends = np.cumsum(bits)
    out = np.zeros((int(ends[-1]) if len(ends) else 0) // 64 + 2, np.uint64)
    if len(values):
        at = ends - bits
        part, shift = values.astype(np.uint64) & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1)), (at & 63).astype(np.uint64)
        word = at >> 6
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(part << shift, first)
        over = np.flatnonzero((at & 63) + bits > 64)
        out[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
    return out


def unpacked(words: np.ndarray, bits: int | np.ndarray, i: np.ndarray) -> np.ndarray:
    """The i-th numbers of ``packed`` ones."""
    return taken(words, bits, i * bits)


def taken(words: np.ndarray, bits: int | np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of ``bits`` bits (one for all or one each) that begin with these bits of the words."""
    if np.isscalar(bits) and not bits:
        return np.zeros(len(at), np.int64)
    bits = np.asarray(bits, np.uint64)
    shift = (at & 63).astype(np.uint64)
    spill = (words[(at >> 6) + 1] << np.uint64(1)) << (np.uint64(63) - shift)
    return (((words[at >> 6] >> shift) | spill) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def lengths_of(numbers: np.ndarray) -> np.ndarray:
    """Binary digits of numbers below 2**53."""
    return np.frexp(numbers.astype(np.float64))[1].astype(np.int64)


def by_length(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as their lengths, which compress, and the bytes of all digits behind the first, which do not. A word's digits are as good as even once its length is known."""
    lengths = lengths_of(a)
    bits = np.maximum(lengths - 1, 0)
    return lengths, packed(a, bits).view(np.uint8)[: -(-int(bits.sum()) // 8)]


def of_lengths(lengths: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """What ``by_length`` was given."""
    bits = np.maximum(lengths - 1, 0)
    ends = np.cumsum(bits)
    words = np.zeros((int(ends[-1]) if len(ends) else 0) // 64 + 2, np.uint64)
    words.view(np.uint8)[: len(digits)] = digits
    return np.where(lengths > 0, taken(words, bits, ends - bits) | (np.int64(1) << bits), 0)


def unusual(a: np.ndarray, usual: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps of the places of numbers that are not ``usual``, and these numbers."""
    at = np.flatnonzero(a != usual)
    return gaps(at), a[at]


def usually(n: int, usual: int, gap: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The n numbers that ``unusual`` was given."""
    out = np.full(n, usual, np.int64)
    out[np.cumsum(gap)] = others
    return out


class EliasFano:
    """An ascending sequence of numbers: low bits packed, high bits in unary. How many ones are before each 64-bit word is counted when it is opened."""

    def __init__(self, words: np.ndarray):
        self.n, self.low_bits, highs = int(words[0]), int(words[1]), int(words[2])
        self.low, self.high = words[3 : len(words) - highs], words[len(words) - highs :]
        ones = np.bitwise_count(self.high)
        self.before = np.cumsum(ones, dtype=np.int64) - ones

    @staticmethod
    def build(values: np.ndarray) -> np.ndarray:
        """The sequence as 64-bit words: number, low bits, words of high bits, then low and high."""
        n, v = len(values), values.astype(np.uint64)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) + 1 if n else 0) // 64 + 2, np.uint64)
        if n:
            word = place >> 6
            first = np.flatnonzero(np.diff(word, prepend=-1))
            high[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first)
        return np.concatenate([np.array([n, bits, len(high)], np.uint64), packed(v, bits), high])

    def _select(self, before: np.ndarray, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where the k-th (from 0) set bit is, of bits with ``before`` set ones before each word."""
        at = np.searchsorted(before, k, "right") - 1
        left, word, place = k - before[at], words(at), np.zeros(len(k), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count((word >> place) & np.uint64((1 << width) - 1))
            over = left >= ones
            left -= ones * over
            place += over * np.uint64(width)
        return at * 64 + place.astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = self._select(self.before, lambda at: self.high[at], i) - i
        return (high << self.low_bits) | unpacked(self.low, self.low_bits, i)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the first index whose value is not below x, n if there is none; whether it is x)"""
        high = x >> self.low_bits
        zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        most = len(self.high) * 64 - self.n - 1  # zeros but the last, which ends all buckets
        ends = lambda h: self._select(zeros, lambda at: ~self.high[at], np.minimum(h, most)) - np.minimum(h, most)  # noqa: E731  ones before the h-th zero
        lo, hi = np.where(high > 0, ends(np.maximum(high - 1, 0)), 0), ends(high)
        beyond = high > most
        lo, end = np.where(beyond, self.n, lo), np.where(beyond, self.n, hi)
        want, hi = x & ((1 << self.low_bits) - 1), end.copy()
        going = np.flatnonzero(lo < hi)
        while len(going):
            mid = (lo[going] + hi[going]) // 2
            less = unpacked(self.low, self.low_bits, mid) < want[going]
            lo[going[less]] = mid[less] + 1
            hi[going[~less]] = mid[~less]
            going = going[lo[going] < hi[going]]
        some = np.flatnonzero(lo < end)  # still in the bucket of x's high bits: equal if the low bits are
        same = np.zeros(len(x), bool)
        same[some] = unpacked(self.low, self.low_bits, lo[some]) == want[some]
        return lo, same

    def successor(self, x: np.ndarray) -> np.ndarray:
        return self.search(x)[0]


class Level:
    """One shard of one level, memory-mapped."""

    def __init__(self, path: str):
        words = np.memmap(path, np.uint64, "r")
        sizes = words[1 : 1 + int(words[0])].astype(np.int64)
        parts = np.split(words[1 + len(sizes) :], np.cumsum(sizes)[:-1])
        self.contexts, self.pointers, self.successors, self.sums = map(EliasFano, parts)

    def codes(self, nodes: np.ndarray) -> np.ndarray:
        """The numbers that nodes were built with."""
        return self.sums[nodes + 1] - self.sums[nodes]

    def all_codes(self) -> np.ndarray:
        return np.diff(self.sums[np.arange(self.sums.n)])

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, codes: np.ndarray) -> bytes:
        """Rows by ascending (context, word), each with a number from 0 up."""
        n = len(contexts)
        first = np.flatnonzero(np.diff(contexts, prepend=-1))
        last = np.append(first[1:], n) - 1 if n else first
        base = np.cumsum(words[last] + 1) - (words[last] + 1)
        values = np.repeat(base, np.diff(np.append(first, n))) + words + 1
        parts = [EliasFano.build(contexts[first]), EliasFano.build(np.append(first, n)), EliasFano.build(values), EliasFano.build(np.cumsum(np.append(0, codes)))]
        return b"".join(p.tobytes() for p in [np.array([len(parts), *map(len, parts)], np.uint64), *parts])

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The node of each (context, word), -1 where the level has none. Neighbours with one context look it up once."""
        out = np.full(len(contexts), -1, np.int64)
        if not self.contexts.n or not len(contexts):
            return out
        first = np.flatnonzero(np.diff(contexts, prepend=-1))
        rank, there = self.contexts.search(contexts[first])
        rank = np.where(there, rank, 0)
        begin, end = self.pointers[rank], self.pointers[rank + 1]
        base = np.where(begin > 0, self.successors[np.maximum(begin - 1, 0)], 0)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(contexts))))
        some = np.flatnonzero(there[run])
        run = run[some]
        node, same = self.successors.search(base[run] + words[some] + 1)
        inside = same & (node < end[run])
        out[some[inside]] = node[inside]
        return out


def mapped(uri: str) -> Level:
    """The level in a file, which is mapped where it lies or from a copy on this machine's disk."""
    fs, path = fs_of(uri)
    if fs.type_name == "local":
        return Level(path)
    with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(path, compression=None) as f:
        while chunk := f.read(1 << 22):
            copy.write(chunk)
        copy.flush()
        return Level(copy.name)  # the mapping outlives the name


def code_of(p: np.ndarray) -> np.ndarray:
    """Probabilities as the steps below 1 that stand for them."""
    return np.minimum(np.rint(-np.log10(p) * STEP), 65534).astype(np.int64)


def learned_words(b: Block) -> np.ndarray:
    """How often the block's training documents have each word."""
    return np.bincount(b.tokens, weights=np.repeat(learns(b), b.lengths), minlength=len(b.words)).astype(np.int64)


def alphabetic(words: list[bytes]) -> np.ndarray:
    """Each word's place in order: lists of words in order are short when compressed."""
    return pc.rank(pa.array(words, pa.large_binary())).to_numpy().astype(np.int64)


def ask_words(shards: int):
    """A block's words with how often its training documents have them."""

    def ask(b: Block, number: int):
        learned = learned_words(b)

        def payload(i: np.ndarray) -> bytes:
            raw = blocks.NEXT.join([b.words[j] if b.words[j] != END else b"" for j in i])
            return pack(*unusual(learned[i], 1), meta=(len(raw), pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)))

        return asks(word_keys(b.words), number, shards, payload, (alphabetic(b.words),))

    return ask


def learns(b: Block) -> np.ndarray:
    return np.asarray(b.docs.column(1).fill_null(False)).astype(np.float64)


def answer_words(shards: int):
    """How often other blocks have a word in training, the first block that has it, and gaps of the numbers (of words that training has) in ascending order; about the shard: occurrences and distinct words in training."""

    def answer(shard: int, ids: list[int], payloads: list[bytes]):
        total: dict[bytes, int] = {}
        home: dict[bytes, int] = {}
        given = []
        for at, p in enumerate(payloads):
            (size, raw), counts = unpack(p)
            words = pa.decompress(raw, size, "zstd", asbytes=True).split(blocks.NEXT)
            counts = usually(len(words), 1, *counts)
            given.append((words, counts))
            for w, c in zip(words, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
                home.setdefault(w, at)
        # words of large counts first; words come by home and then in order, and stay so where counts are as long
        known = sorted((w for w, c in total.items() if c), key=lambda w: -total[w].bit_length())
        number = {w: i for i, w in enumerate(known)}
        for i, (words, counts) in zip(ids, given, strict=True):
            numbers = np.array([number[w] for w in words if w in number], np.int64)
            others = np.array([total[w] for w in words], np.int64) - counts
            yield i, pack(*unusual(others, 0), np.array([home[w] for w in words], np.int64), gaps(np.sort(numbers)), meta=(shard, len(words)))
        yield None, pack(np.array([sum(total.values()), len(known)], np.int64))

    return answer


def answers(by: np.ndarray, own: np.ndarray, payloads: list[bytes], many: int, plain: Callable[..., list[np.ndarray]]) -> list[np.ndarray]:
    """The ``many`` arrays that ``plain(shard, counts, arrays...)`` makes of each shard's answer, in the order of a block's entries.

    ``by`` is the order in which the entries went to the shards, ``own`` the block's counts of them, to which the shards' are added.
    """
    parts, begin = [], 0
    for p in payloads:
        if p:
            (shard, n), (gap, others, *rest) = unpack(p)
            parts.append(plain(shard, own[by[begin : begin + n]] + usually(n, 0, gap, others), *rest))
            begin += n
    out = [np.zeros(len(by), np.int64) for _ in range(many)]
    for a, some in zip(out, zip(*parts), strict=False):
        a[by] = np.concatenate(some)
    return out


def word_answers(b: Block, shards: int, payloads: list[bytes]) -> list[np.ndarray]:
    """Numbers (from 1, 0: not in training) and counts of the block's words."""

    def plain(shard: int, count: np.ndarray, home: np.ndarray, gap: np.ndarray) -> list[np.ndarray]:
        some = np.flatnonzero(count)
        number = np.zeros(len(count), np.int64)
        number[some[np.lexsort((home[some], -lengths_of(count[some])))]] = np.cumsum(gap) * shards + shard + 1
        return [number, count]

    return answers(arranged(word_keys(b.words), shards, (alphabetic(b.words),)), learned_words(b), payloads, 2, plain)


class Text:
    """A block between the rounds: for each position the logarithm so far, its word, its context's number and count."""

    def __init__(self, b: Block, shards: int, payloads: list[bytes], total: int, distinct_words: int, mu: dict[int, float], min_context: int):
        self.b, self.mu, self.min_context = b, mu, min_context
        number, count = word_answers(b, shards, payloads)
        b.words = []  # they have their numbers
        self.number, self.known = number, count[b.tokens] > 0
        log = np.log10((count + 1) / (total + distinct_words + 1))
        self.base, self.log = np.bincount(b.doc, weights=log[b.tokens], minlength=len(b.lengths)), log[b.tokens].astype(np.float32)
        # the word before is the context of what follows: how often it occurs, its number, and its number in the block
        self.inner = np.append(False, b.doc[1:] == b.doc[:-1])[: len(b.tokens)]
        self.seen, self.context, self.local = self.before(count[b.tokens]), self.before(number[b.tokens]), self.before(b.tokens)
        self.held = None

    def before(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), a.dtype)
        out[1:] = a[:-1]
        out *= self.inner
        return out

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions of the distinct n-grams to ask for, which of them each open position has, the open positions)."""
        if self.held is None:
            every = np.flatnonzero((self.seen >= (self.min_context if k > 2 else 1)) & self.known)
            first, which = distinct(self.local[every], self.b.tokens[every])
            self.held = every[first], which.astype(np.int32), every.astype(np.int32)
        return self.held

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, word, hash) of the n-grams at these positions; a common context is dealt out by word."""
        context, word = self.context[at], self.number[self.b.tokens[at]]
        salts = np.maximum(-(-self.seen[at] // SPLIT), 1)
        return context, word, mixed(context, mixed(word) % salts)

    def learned(self, k: int) -> np.ndarray:
        """How often the block's training documents have each n-gram."""
        at, which, every = self.grams(k)
        return np.bincount(which, weights=learns(self.b)[self.b.doc[every]], minlength=len(at)).astype(np.int64)

    def ask(self, k: int, number: int, shards: int):
        context, word, key = self.entries(self.grams(k)[0])
        learned = self.learned(k)
        return asks(key, number, shards, lambda i: pack(gaps(context[i]), *by_length(gaps_within(word[i], context[i])), *unusual(learned[i], 1)), (context, word))

    def take(self, k: int, shards: int, payloads: list[bytes], last: bool) -> None:
        """The answers of level k become each position's probability, and but for the last level the contexts of the next."""
        at, which, every = self.grams(k)
        context, word, key = self.entries(at)

        def plain(shard: int, times: np.ndarray, gap: np.ndarray | None = None) -> list[np.ndarray]:
            if last:
                return [times]
            number = np.zeros(len(times), np.int64)
            number[times >= self.min_context] = np.cumsum(gap) * shards + shard + 1
            return [times, number]

        times, *node = answers(arranged(key, shards, (context, word)), self.learned(k), payloads, 1 if last else 2, plain)
        lower, seen = code_of(10.0 ** self.log[at].astype(np.float64)), self.seen[at]
        code = code_of(np.minimum((times + self.mu[k] * 10.0 ** (-lower / STEP)) / (seen + self.mu[k]), 1.0))
        has = np.flatnonzero(self.seen >= (self.min_context if k > 2 else 1))
        self.log[has] += np.log10(self.mu[k] / (self.seen[has] + self.mu[k]))  # of words that training does not have
        self.log[every] = -(code / STEP)[which]
        if last:
            return
        del at, context, word, key, lower, seen, code, has
        for name, a in (("seen", np.where(times >= self.min_context, times, 0)), ("context", node[0]), ("local", np.arange(1, len(times) + 1, dtype=np.int32))):
            setattr(self, name, None)
            spread = np.zeros(len(self.log), a.dtype)
            spread[every] = a[which]
            setattr(self, name, self.before(spread))
        self.held = None


def answer_grams(k: int, shards: int, folder: str, min_context: int, last: bool):
    """How often other blocks have the n-grams in training; but for the last level also gaps of the numbers of those that are contexts of the next, which ascend."""

    def answer(shard: int, ids: list[int], payloads: list[bytes]):
        if not ids:
            return
        parts = []
        for p in payloads:
            gap, lengths, digits, *counts = unpack(p)[1]
            context = np.cumsum(gap)
            parts.append((context, summed_within(of_lengths(lengths, digits), context), usually(len(context), 1, *counts)))
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        context, word, learned = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        first, which = distinct(context, word)
        times = np.bincount(which, weights=learned, minlength=len(first)).astype(np.int64)
        context, word = context[first], word[first]
        some = np.flatnonzero(times)
        uri = f"{folder}/{k}/{shard:06d}.level"
        data = Level.build(context[some], word[some], times[some])
        put_file(uri, lambda out: out.write(data))
        level = mapped(uri)
        node = level.find(context, word)
        counts = level.all_codes()
        times = np.where(node >= 0, np.append(counts, 0)[node], 0)
        number = np.append(np.cumsum(counts >= min_context) - 1, 0)[node]  # contexts of the next level are numbered among themselves
        for i, lo, hi in zip(ids, cut[:-1], cut[1:], strict=True):
            own = which[lo:hi]
            others, meta = unusual(times[own] - learned[lo:hi], 0), (shard, int(hi - lo))
            yield i, pack(*others, meta=meta) if last else pack(*others, gaps(number[own][times[own] >= min_context]), meta=meta)

    return answer


def scored(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: dict[int, float] | None = None, min_context: int = MIN_CONTEXT) -> DataFrame:
    """``id_col``, n_tokens, n_known (tokens that training has), train_tokens, base_score (the words alone), score, for every row; learned from rows where ``learn`` holds."""
    spark, mu = docs.sparkSession, mu or MU
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    of = blocks.blocks_of(rows, lambda text, batch, i: [*text.lower().split(), END], "lm-blocks", BLOCK)
    shards, folder = of.shards, shared_dir(spark, "lm-trie")
    came = written(spark, blocks.by_shard(blocks.first_asks(of, ask_words(shards)), of, answer_words(shards)), "lm-words")
    total, vocabulary = (sum(x) for x in zip((0, 0), *(unpack(r[0])[1][0].tolist() for r in came.where("block is null").select("payload").toLocalIterator()), strict=True))

    def received(k: int, uri: str, payloads: list[bytes]) -> Text:
        """A block after the answers of level k, which it keeps as they came for the rounds behind."""
        if k < order:
            blocks.write(f"{uri}.{k}", payloads)
        told = lambda j: payloads if j == k else blocks.read(f"{uri}.{j}")
        text = Text(Block(uri), shards, told(1), total, vocabulary, mu, min_context)
        for j in range(2, k + 1):
            text.take(j, shards, told(j), j == order)
        return text

    def step(k: int):
        def run(number: int, uri: str, payloads: list[bytes]) -> pa.Table:
            return blocks.sent(received(k - 1, uri, payloads).ask(k, number, shards))

        return run

    for k in range(2, order + 1):
        # one job to the end: shuffles keep what a lost executor had, tables between would only be further copies
        came = blocks.by_shard(blocks.by_block(came, of, step(k), blocks.ROW), of, answer_grams(k, shards, folder, min_context, k == order))

    kind = rows.schema["id"].dataType.simpleString()

    def last(number: int, uri: str, payloads: list[bytes]) -> pa.Table:
        text = received(order, uri, payloads)
        b, n = text.b, len(text.b.lengths)
        sums = [text.base, np.bincount(b.doc, weights=text.log, minlength=n)]
        known = np.bincount(b.doc, weights=text.known, minlength=n).astype(np.int64)
        return pa.Table.from_arrays(
            [b.docs.column(0), pa.array(b.lengths), pa.array(known), pa.array(np.full(n, total)), pa.array(sums[0]), pa.array(sums[1])],
            names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return blocks.by_block(came, of, last, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
