"""Benchmark decontamination with suffix arrays of the training texts.

The documents of a task are training shards: their words, numbered, stand one after another with a mark of its own
behind each document, and the shard's suffix array holds all positions, ordered by the whole suffix up to its document's
end. Every test suffix is binary-searched in every shard, word by word: the range of suffixes that agree with it narrows
until none is left, which gives its longest verbatim match and where that is; the range at the length of a window is all
occurrences of the window, and each is extended to its longest verbatim match.

A window is ``window`` consecutive words of an item, or the whole item if it has fewer words but
one at least. A document word inside any occurrence of a window is hit. Words are runs of digits,
letters and all characters beyond ASCII, A-Z lower-cased.

Hits and items take time in proportion to the texts, however often a passage repeats on either side; only the places of matches, if asked for,
are as many as pairs of repeats.

Null and empty texts have no words, on either side. Repeated documents are judged alike; items with
equal texts are all reported, one without an identifier as ``null``. Empty tables give an empty result, an empty
benchmark gives no hits. The benchmark is written to the shared folder in blocks of about ``BLOCK`` bytes, and each shard
is searched for one after another: nothing is broadcast and nothing grows with it but time. Documents are
never split, so a shard is at least as long as its longest document.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fs_of, put_file, shared_dir, spells, tidy, written

WINDOW = 10
SHARD_WORDS = 400_000
BLOCK = 16 << 20
#: Bytes of benchmark blocks that a task keeps; further ones are read again for each shard.
KEPT = 64 << 20
#: Occurrences that are extended at a time.
STEP = 1_000_000

#: What becomes of each byte: A-Z lower case, what is in no word a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCHES = "array<struct<item:string,item_at:long,at:long,length:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


class Tests:
    """A block of the benchmark: names of the items, their words as numbers of the block's vocabulary, one item after another."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        vocabulary: dict[bytes, int] = {}
        items = [(i, ws) for i, ws in items if ws]
        self.names = [i for i, _ in items]
        flat = [vocabulary.setdefault(w, len(vocabulary)) for _, ws in items for w in ws]
        self.flat, self.vocabulary = np.array(flat, np.int32), list(vocabulary)
        lengths = np.array([len(ws) for _, ws in items], np.int64)
        #: Of each suffix its item, and how many words it has.
        self.item = np.repeat(np.arange(len(items)), lengths)
        self.start = np.cumsum(lengths) - lengths
        self.left = (self.start + lengths)[self.item] - np.arange(len(flat)) if items else np.zeros(0, np.int64)

    def windows(self, window: int) -> np.ndarray:
        """The length of the window that begins at each suffix, 0 if none does."""
        whole = np.where(self.at() == 0, self.left, 0)
        return np.where(self.left >= window, window, np.where(whole < window, whole, 0))

    def at(self) -> np.ndarray:
        """Where in its item each suffix begins."""
        return np.arange(len(self.flat)) - self.start[self.item] if len(self.flat) else self.left


class Blocks:
    """The benchmark's blocks for one task."""

    def __init__(self, uris: list[str]):
        self.uris, self.kept, self.size = uris, {}, 0

    def __iter__(self) -> Iterator[Tests]:
        for uri in self.uris:
            if uri in self.kept:
                yield self.kept[uri]
                continue
            fs, path = fs_of(uri)
            with fs.open_input_stream(path, compression=None) as f:
                data = f.read()
            tests = pickle.loads(data)
            if self.size + 4 * len(data) <= KEPT:
                self.kept[uri] = tests
                self.size += 4 * len(data)
            yield tests


class Shard:
    """The words of some documents and their suffix array."""

    def __init__(self, docs: list[list[bytes]]):
        self.lengths = np.array([len(d) for d in docs], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        number: dict[bytes, int] = {}
        ends = len(docs)
        t: list[int] = []
        for k, ws in enumerate(docs):
            t += [number.setdefault(w, ends + len(number)) for w in ws]
            t.append(k)  # a mark that no other document has, before all words
        self.words, self.number = np.array(t, np.int64), number
        self.order = suffix_array(self.words)

    def find(self, tests: Tests, window: int):
        """(longest match of each suffix, a place of it, suffixes whose window occurs, the ranges of their occurrences)."""
        t, order, numbers = self.words, self.order, np.array([self.number.get(w, -1) for w in tests.vocabulary], np.int64)
        q = numbers[tests.flat] if len(tests.flat) else tests.left
        firsts = t[order]
        lo, hi = np.searchsorted(firsts, q, "left"), np.searchsorted(firsts, q, "right")
        longest, place, wanted = np.zeros(len(q), np.int64), np.full(len(q), -1, np.int64), tests.windows(window)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active, k = np.flatnonzero((lo < hi) & (q >= 0)), 1
        lo, hi = lo[active], hi[active]
        while len(active):
            longest[active], place[active] = k, order[lo]
            done = wanted[active] == k
            hits.append((active[done], lo[done], hi[done]))
            more = tests.left[active] > k
            active, lo, hi = active[more], lo[more], hi[more]
            word = q[active + k]
            lo = bisect(t, order, k, word, lo, hi, False)
            hi = bisect(t, order, k, word, lo, hi, True)
            some = lo < hi
            active, lo, hi, k = active[some], lo[some], hi[some], k + 1
        at, lo, hi = (np.concatenate([h[i] for h in hits] or [np.zeros(0, np.int64)]) for i in range(3))
        return longest, place, q, at, lo, hi

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def bisect(t: np.ndarray, order: np.ndarray, k: int, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """In each range of suffixes that agree in k words, where the next word is no longer less (or: no longer as small)."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        there = t[order[mid] + k]
        up = there <= word[open_] if right else there < word[open_]
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def suffix_array(t: np.ndarray) -> np.ndarray:
    """All positions by their whole suffixes: prefix doubling, and each round sorts only what is still tied. Every document ends with a value of its own, so no comparison goes beyond it."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    fresh = np.concatenate([[True], np.diff(t[order]) != 0])[:n]
    rank = np.zeros(n, np.int64)
    first = np.flatnonzero(fresh)
    rank[order] = first[np.cumsum(fresh) - 1] if n else first
    tied = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])[:n]))
    h = 1
    while len(tied):
        at = order[tied]
        key = rank[at] * (n + 1) + rank[at + h]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        fresh = np.concatenate([[True], np.diff(key) != 0])
        first = np.flatnonzero(fresh)
        rank[at] = tied[first[np.cumsum(fresh) - 1]]
        tied = tied[~(fresh & np.concatenate([fresh[1:], [True]]))]
        h *= 2
    return order


def occurrences(shard: Shard, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which range, place) of all suffixes in these ranges, ``STEP`` at a time, about."""
    counts = hi - lo
    cuts = np.searchsorted(np.cumsum(counts), np.arange(STEP, counts.sum() + STEP, STEP)) if len(counts) else []
    for part in np.split(np.arange(len(lo)), np.unique(np.asarray(cuts, np.int64) + 1)):
        if len(part):
            within = np.arange(counts[part].sum()) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
            yield np.repeat(part, counts[part]), shard.order[np.repeat(lo[part], counts[part]) + within]


class Items:
    """Which items each document has: documents meet ranges, and ranges meet sets of items, of which equal ones are one."""

    def __init__(self, docs: int):
        self.classes: list[set[int]] = [set() for _ in range(docs)]
        self.sets: dict[frozenset, int] = {}

    def add(self, tests: Tests, which: np.ndarray, suffixes: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        """``suffixes`` lie in the ranges ``which``; the documents ``doc`` have the ranges ``at``."""
        pairs = np.unique(np.stack([which, tests.item[suffixes]], 1), axis=0)
        cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
        name = [self.sets.setdefault(frozenset(tests.names[k] for k in items.tolist()), len(self.sets)) for items in np.split(pairs[:, 1], cuts)]
        for d, k in np.unique(np.stack([doc, np.asarray(name)[at]], 1), axis=0).tolist():
            self.classes[d].add(k)

    def lists(self) -> list[list[str]]:
        """Each document's items, sorted; documents with the same sets share the work."""
        sets, made = list(self.sets), {}
        out = []
        for c in self.classes:
            key = frozenset(c)
            if key not in made:
                made[key] = sorted(set().union(*(sets[k] for k in key)))
            out.append(made[key])
        return out


def longest_windows(shard: Shard, tests: Tests, q: np.ndarray, wanted: np.ndarray, suffixes: np.ndarray, lo: np.ndarray, hi: np.ndarray, matches: list[set]) -> None:
    """Adds to each document's ``matches`` every longest match with its places. These are pairs of places in documents and in items."""
    t, start = shard.words, tests.at()
    for which, at in occurrences(shard, lo, hi):
        j = suffixes[which]
        reach = wanted[j]
        # what begins one word earlier, too, is part of a longer match
        outer = ~((start[j] > 0) & (at > 0) & (t[at - 1] == q[j - 1]))
        j, at, reach = j[outer], at[outer], reach[outer]
        going = np.arange(len(j))
        while len(going := going[tests.left[j[going]] > reach[going]]) and len(going := going[t[at[going] + reach[going]] == q[j[going] + reach[going]]]):
            reach[going] += 1
        doc = shard.document(at)
        for d, k, i, p, n in zip(doc.tolist(), tests.item[j].tolist(), start[j].tolist(), (at - shard.starts[doc]).tolist(), reach.tolist(), strict=True):
            matches[d].add((tests.names[k], i, p, n))


def judge_shard(docs: list[list[bytes]], blocks: Blocks, window: int, places: bool = True) -> list[tuple]:
    """(n_words, n_hit, items, longest, matches) of each document.

    Windows that are equal have one range of the suffix array, so each range is marked and met by its documents once, however many items have
    it and however often: that takes time in proportion to the shard and the benchmark. Only ``places`` asks for pairs of places.
    """
    shard = Shard(docs)
    depth = np.zeros(len(shard.words) + 1, np.int64)
    items = Items(len(docs))
    matches: list[set] = [set() for _ in docs]
    for tests in blocks:
        _, _, q, suffixes, lo, hi = shard.find(tests, window)
        if not len(suffixes):
            continue
        wanted = tests.windows(window)
        # a range and a length: the whole of a short item can have the range of a longer window
        ranges, first, which = np.unique(np.stack([lo, hi, wanted[suffixes]], 1), axis=0, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        docs_of, at_of = [], []
        for r, at in occurrences(shard, ranges[:, 0], ranges[:, 1]):
            np.add.at(depth, at, 1)
            np.add.at(depth, at + ranges[r, 2], -1)
            met = np.unique(np.stack([shard.document(at), r], 1), axis=0)
            docs_of.append(met[:, 0])
            at_of.append(met[:, 1])
        items.add(tests, which, suffixes, np.concatenate(docs_of), np.concatenate(at_of))
        if places:
            longest_windows(shard, tests, q, wanted, suffixes, lo, hi, matches)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(depth)[:-1] > 0)])
    made = zip(shard.lengths.tolist(), shard.starts.tolist(), items.lists(), matches, strict=True)
    return [(n, int(hit[s + n] - hit[s]), f, max((x[3] for x in m), default=0), sorted(m, key=lambda x: (x[2], x[0], x[1]))) for n, s, f, m in made]


def prepare(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """The benchmark's words in blocks in the shared folder; their paths."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_dir(spark, "benchmark")

    @tidy
    def run(batches):
        from pyspark import TaskContext

        tests = Tests([(i, words_of(t)) for b in batches for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True)])
        uri = f"{folder}/{TaskContext.get().partitionId():05d}.items"
        put_file(uri, lambda out: out.write(pickle.dumps(tests)))
        yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["path"])

    manifest = written(spark, rows.repartition(max(1, -(-size // BLOCK))).mapInArrow(run, "path string"), "benchmark-manifest")
    return sorted(r[0] for r in manifest.collect())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), places: bool = True) -> DataFrame:
    """``id_col``, the columns to keep, n_words, n_hit, items array<string> (sorted as strings), and with ``places`` longest (words) and matches, for every row.

    ``matches`` are the longest verbatim matches of a window or more: item, the word of the item and the word of the
    document where it begins (from 0), and its length in words; by place in the document.
    """
    uris = prepare(benchmark)
    rows = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    names = [id_col, *keep, "n_words", "n_hit", "items", *["longest", "matches"] * places]
    place = pa.list_(pa.struct([("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("length", pa.int64())]))

    @tidy
    def run(batches):
        blocks = Blocks(uris)
        for whole, words in shards(batches, rows_at):
            made = judge_shard(words, blocks, window, places)
            cols = [pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string())))]
            if places:
                cols.append(pa.array([m[3] for m in made], pa.int64()))
                cols.append(pa.array([[dict(zip(("item", "item_at", "at", "length"), x, strict=True)) for x in m[4]] for m in made], place))
            yield pa.RecordBatch.from_arrays([*whole.columns[:-1], *cols], names=names)

    rows_at = len(keep) + 1
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return rows.mapInArrow(run, f"{kinds}, n_words long, n_hit long, items array<string>" + f", longest long, matches {MATCHES}" * places)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item, item_at, length, ``id_col``, at: for every suffix of every item its longest verbatim match in all documents, however short, and a place of it. Suffixes whose first word no document has are left out."""
    uris = prepare(benchmark)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches):
        blocks = Blocks(uris)
        for whole, words in shards(batches, 1):
            shard = Shard(words)
            for tests in blocks:
                longest, place, *_ = shard.find(tests, WINDOW)
                j = np.flatnonzero(longest)
                doc = shard.document(place[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tests.names[k] for k in tests.item[j]], pa.string()), pa.array(tests.at()[j]), pa.array(longest[j]), whole.column(0).take(pa.array(doc)), pa.array(place[j] - shard.starts[doc])],
                    names=["item", "item_at", "length", id_col, "at"],
                )

    found = rows.mapInArrow(run, f"item string, item_at long, length long, `{id_col}` {kind}, at long")
    best = F.max_by(F.struct(id_col, "at"), "length")
    return found.groupBy("item", "item_at").agg(F.max("length").alias("length"), best.alias("p")).select("item", "item_at", "length", F.col("p")[id_col].alias(id_col), F.col("p.at").alias("at"))


def shards(batches, at: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """The rows of each shard in one batch, whose column ``at`` is the text, and the words of each."""
    held, words, n = [], [], 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        for start, size in spells(batch.column(at), 128, 1 << 20):
            b = batch.slice(start, size)
            held.append(b)
            words += [words_of(t) for t in b.column(at).to_pylist()]
            n += sum(map(len, words[-b.num_rows :]))
            if n >= SHARD_WORDS:
                yield whole(), words
                held, words, n = [], [], 0
    if held:
        yield whole(), words


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they were, in which no window occurs."""
    uris, at = prepare(benchmark), docs.columns.index(text_col)

    @tidy
    def run(batches):
        blocks = Blocks(uris)
        for whole, words in shards(batches, at):
            yield whole.filter(pa.array([m[1] == 0 for m in judge_shard(words, blocks, window, False)]))

    return docs.mapInArrow(run, docs.schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
