"""Blocks of tokenised documents, and rounds in which they ask shards for what the whole corpus knows of their keys.

A block is the documents of a task up to about ``BLOCK_BYTES`` of text (a longer one on its own): their words are numbered in
a table of the block's own, and numbers and table go to one file in the shared folder. In a round every block sends each
shard its distinct keys with their counts, one packed row a block and shard; Spark shuffles the rows by shard; the
shard adds up, and answers every block in the order of its keys, again one packed row; Spark shuffles those by block.
What travels are distinct keys of a block, so a frequent key is counted before the shuffle and has at most one entry a block:
no shard grows with the share that a key has. Shards are sized by entries, so their number follows the corpus.

Files and rows depend on the input alone, and files are moved into place whole: a task that is lost is run again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fs_of, put_file, shared_dir, spells, tidy, written

BLOCK_BYTES = 16 << 20
#: Tokens of all blocks for one shard.
SHARD_TOKENS = 2_500_000
#: Between the parts of a key or a list of words: bytes that UTF-8 never has.
PART, NEXT = b"\xfe", b"\xff"
ROW = "block long, shard int, payload binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])


def pack(*arrays: np.ndarray, meta=None) -> bytes:
    """Arrays of numbers from 0 up in the narrowest type that holds them, each byte's places together, compressed; ``meta`` is any small object."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
        out.append((width, len(a), pa.compress(np.ascontiguousarray(planes).data, "zstd", asbytes=True)))
    return pickle.dumps((meta, out))


def unpack(payload: bytes) -> tuple[object, list[np.ndarray]]:
    """What ``pack`` was given, the arrays as 64-bit numbers."""
    meta, out = pickle.loads(payload)
    return meta, [np.ascontiguousarray(np.frombuffer(pa.decompress(raw, n * width, "zstd"), np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(-1).astype(np.int64) for width, n, raw in out]


def gaps(a: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, the first from 0."""
    return np.diff(a, prepend=0)


def gaps_within(a: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Differences of numbers that ascend while ``by`` stays the same; the first of each run as it is."""
    out = a.copy()
    same = np.flatnonzero(by[1:] == by[:-1]) + 1
    out[same] -= a[same - 1]
    return out


def summed_within(gap: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What ``gaps_within`` was given."""
    total = np.cumsum(gap)
    first = np.flatnonzero(np.diff(by, prepend=-1))
    before = (total[first] - gap[first]) if len(first) else total
    return total - np.repeat(before, np.diff(np.append(first, len(gap))))


def ordered(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by these keys, numbers from 0 up; by one number where all keys fit into it. Equal rows come in any order."""
    tops = [int(k.max()) + 1 if len(k) else 1 for k in keys]
    whole = 1
    for top in tops:
        whole *= top
    if whole >= 1 << 62:
        return np.lexsort(keys[::-1])
    key = keys[0].astype(np.int64)
    for k, top in zip(keys[1:], tops[1:], strict=True):
        key *= top
        key += k
    return np.argsort(key)


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct key, ascending; which of them each row is)"""
    order = ordered(*keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def mixed(*keys: np.ndarray) -> np.ndarray:
    """A 63-bit hash of rows of integers."""
    h = np.full(len(keys[0]), 0x243F6A8885A308D3, np.uint64)
    for k in keys:
        h = (h ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).astype(np.int64)


def read(uri: str):
    fs, path = fs_of(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return pickle.loads(f.read())


def write(uri: str, value) -> None:
    put_file(uri, lambda out: out.write(pickle.dumps(value)))


class Block:
    """Documents (a record batch without texts), their tokens as numbers of ``words``, how many each document has."""

    def __init__(self, uri: str):
        self.uri = uri
        self.docs, tokens, lengths, blob = read(uri)
        self.tokens, self.lengths = unpack(tokens)[1][0].astype(np.int32), unpack(lengths)[1][0]
        self.words: list[bytes] = pa.decompress(blob[1], blob[0], "zstd", asbytes=True).split(b" ")
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def keep(self, name: str, *arrays: np.ndarray) -> None:
        """What a round has learned, for the rounds behind it."""
        write(f"{self.uri}.{name}", pack(*arrays))

    def kept(self, name: str) -> list[np.ndarray]:
        return unpack(read(f"{self.uri}.{name}"))[1]


def save_block(uri: str, docs: pa.RecordBatch, tokens: list[np.ndarray], words: list[bytes]) -> int:
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
    # frequent words get small numbers, whose upper bytes then say little
    by = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(len(by))
    flat = rank[flat] if len(flat) else flat
    raw = b" ".join([words[i] for i in by])  # no word has a space
    write(uri, (docs, pack(flat), pack(np.array([len(t) for t in tokens], np.int64)), (len(raw), pa.compress(raw, "zstd", asbytes=True))))
    return len(flat)


class Table(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Blocks:
    """All blocks of a table: their folder, and how many blocks and tokens there are."""

    def __init__(self, folder: str, manifest: DataFrame):
        self.folder, self.manifest = folder, manifest
        self.count, tokens = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        self.shards = max(1, -(-tokens // SHARD_TOKENS))


def uri_of(folder: str, block: int) -> str:
    return f"{folder}/{block:012x}.block"


def blocks_of(rows: DataFrame, words_of: Callable[[bytes, pa.RecordBatch, int], list[bytes]], name: str, times: int = 1) -> Blocks:
    """The blocks of ``rows``, whose last column is the text, of ``times`` the usual size. ``words_of(text, batch, row)`` gives a document's tokens."""
    folder, most = shared_dir(rows.sparkSession, name), times * BLOCK_BYTES
    at = len(rows.columns) - 1

    @tidy
    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for docs, tokens, table in filled(batches):
            block = (part << 24) + made
            n = save_block(uri_of(folder, block), docs, tokens, list(table))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([n], pa.int64())], names=["block", "tokens"])
            made += 1

    def filled(batches):
        held, tokens, table, size = [], [], Table(), 0

        def whole():
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0], tokens, table

        for batch in batches:
            texts = batch.column(at)
            rest = batch.select(range(at))
            for start, n in spells(texts, 256, 1 << 20):
                some = texts.slice(start, n).cast(pa.binary()).to_pylist()
                more = sum(len(t or b"") for t in some)
                if held and size + more > most:
                    yield whole()
                    held, tokens, table, size = [], [], Table(), 0
                part = rest.slice(start, n)
                tokens += [table.numbers(words_of(t or b"", part, i)) for i, t in enumerate(some)]
                held.append(part)
                size += more
        if held:
            yield whole()

    return Blocks(folder, written(rows.sparkSession, rows.mapInArrow(run, "block long, tokens long"), f"{name}-manifest"))


def asks(key: np.ndarray, block: int, shards: int, payload: Callable[[np.ndarray], bytes], order: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[int, int, bytes]]:
    """A row for each shard that gets some of the entries with hashes ``key``, sorted there by ``order``; one empty row if there are no entries, so that every block gets an answer."""
    by = arranged(key, shards, order)
    cuts = np.searchsorted((key % shards)[by], np.arange(shards + 1))
    if not len(key):
        yield block, block % shards, b""
    for s in np.flatnonzero(np.diff(cuts)):
        yield block, int(s), payload(by[cuts[s] : cuts[s + 1]])


def arranged(key: np.ndarray, shards: int, order: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """In which order a block's entries go to the shards, and so come back."""
    return ordered(key % shards, *order) if order else np.argsort(key % shards, kind="stable")


def answered(key: np.ndarray, shards: int, payloads: list[bytes], many: int, order: tuple[np.ndarray, ...] = (), plain: Callable[[object, list[np.ndarray]], list[np.ndarray]] = lambda meta, arrays: arrays) -> list[np.ndarray]:
    """The shards' ``many`` arrays of answers, which come by ascending shard, in the order of the entries. ``plain`` makes such arrays of what a shard packed."""
    parts = [plain(*unpack(p)) for p in payloads if p]
    out = []
    for i in range(many):
        a = np.zeros(len(key), np.int64)
        if parts:
            a[arranged(key, shards, order)] = np.concatenate([p[i] for p in parts])
        out.append(a)
    return out


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 for w in words), np.int64, len(words))


def lean(run):
    """A group's function that gives its memory back when it ends."""

    def whole(key, table):
        return next(tidy(lambda: iter([run(key, table)]))())

    return whole


#: Tasks of a round at most; more blocks or shards share them.
TASKS = 8192


def dealt(rows: DataFrame, key: str, many: int) -> DataFrame:
    """Rows by key in a number of tasks that follows the work, not the packed bytes, which are few."""
    return rows.repartition(min(max(many, 1), TASKS), F.col(key))


def by_shard(sent: DataFrame, of: Blocks, answer: Callable[[int, list[int], list[bytes]], Iterator[tuple[int | None, bytes]]]) -> DataFrame:
    """Each shard's rows to ``answer(shard, blocks, payloads)``, which yields rows for blocks and, with no block, rows about the shard."""

    @lean
    def run(key, table):
        shard = key[0].as_py()
        blocks = table.column("block").to_pylist()
        by = np.argsort(np.array(blocks), kind="stable").tolist()
        payloads = table.column("payload")
        given = [(blocks[i], payloads[i].as_py()) for i in by]
        empty = [b for b, p in given if not p]
        full = [(b, p) for b, p in given if p]
        rows = [(b, shard, b"") for b in empty] + [(b, shard, p) for b, p in answer(shard, [b for b, _ in full], [p for _, p in full])]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], _SCHEMA.types[i]) for i in range(3)], schema=_SCHEMA)

    return dealt(sent, "shard", of.shards).groupBy("shard").applyInArrow(run, ROW)


def by_block(came: DataFrame, of: Blocks, step: Callable[[int, str, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """Each block's answers, by ascending shard, to ``step(block, uri, payloads)``."""
    folder = of.folder

    @lean
    def run(key, table):
        order = np.argsort(table.column("shard").to_numpy(), kind="stable").tolist()
        payloads = table.column("payload")
        return step(key[0].as_py(), uri_of(folder, key[0].as_py()), [payloads[i].as_py() for i in order])

    return dealt(came.where("block is not null"), "block", of.count).groupBy("block").applyInArrow(run, schema)


def sent(rows: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], _SCHEMA.types[i]) for i in range(3)], schema=_SCHEMA)


def first_asks(of: Blocks, ask: Callable[[Block, int], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """The rows that ``ask(block, number)`` sends for each block."""
    folder = of.folder

    @tidy
    def run(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield from sent(ask(Block(uri_of(folder, number)), number)).to_batches()

    return dealt(of.manifest.select("block"), "block", of.count).mapInArrow(run, ROW)
