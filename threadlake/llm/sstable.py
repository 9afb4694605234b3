"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: blocks of entries whose keys drop the prefix they
share with the entry before (zstd-compressed as a whole), a sparse index with the last key and the
place of each block, a Bloom filter of the keys, and a footer that locates both. A lookup asks the
filter, finds the block by binary search in the index, and reads that block alone.

Keys are identifiers as 8 big-endian bytes with the sign bit turned over, so bytes sort as numbers
do; a null identifier is the empty key and comes first. Equal identifiers are kept, in the order of
their texts. Values are ids of 2 bytes where the vocabulary allows it, else 4, little-endian. A
null or empty text has the end id alone. Rows are dealt out in ranges of the identifier, cut at
about equal counts and so many that a shard has about ``SHARD`` bytes of text at most; each task writes one shard
under another name and moves it into place. An empty
table gives no shard and an empty result; only the identifier and the text are read.

Words are cut at spaces and line feeds, which the tokenizer's normaliser and splitter drop anyway,
and each distinct one is encoded once in a worker's table that is emptied at ``TABLE_CHARS`` characters; texts are
taken in slices bounded in bytes, a very long one on its own.
That needs a pre-tokenizer that drops white space; a probe of the tokenizer refuses others
(``ValueError``).
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, fs_of, range_cuts, shared_dir, spells, tidy, written

TABLE_CHARS = 8_000_000
MARKS = ".,;:!?*%&$#|"
BLOCK = 1 << 18
MAGIC = b"SSTABLE1"
FOOTER = struct.Struct("<QQQQQQBB6x8s")  # index at, index bytes, filter at, filter bytes, documents, ids, bytes of an id, hashes
BITS, HASHES = 10, 7
SHARD = 128 << 20
ROWS, SIZE = 512, 1 << 20
LEAST = -(2**63)

_tables: dict[str, WordTable] = {}


class WordTable:
    """Distinct word -> its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        probe = "It's  A b-1\n\nc. d \n"
        whole, apart = self.encode([probe])[0], b"".join(self.encode(probe.replace("\n", " ").split(" ")))
        if whole != apart:
            raise ValueError("the tokenizer keeps white space: words are not independent")
        if self.encode(["ab.cd!!"])[0] != b"".join(self.encode(["ab", ".", "cd", "!!"])):
            raise ValueError("the tokenizer joins marks with letters")
        self.lowers = self.encode(["AbÉ"]) == self.encode(["abé"])
        self.table: dict[str, bytes] = {}
        self.chars = 0
        self.vocabulary = self.tok.get_vocab_size()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, text: str | None) -> list[str]:
        """The text at its spaces and line feeds; already lower-cased where that is the normaliser's own lower case: Latin-1 without a special token."""
        text = (text or "").replace("\n", " ")
        if self.lowers and "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.split(" ")

    def texts(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        table = self.table
        if self.chars > TABLE_CHARS:
            table.clear()
            self.chars = 0
        new: set[str] = set()
        for c in cut:
            new.update(c)
        # the splitter parts letters from the marks behind them, so both are encoded apart and less often
        parted = {w: (base, w[len(base) :]) for w in new.difference(table) if (base := w.rstrip(MARKS)) is not w and base[-1:].lower().isalpha() and "<|" not in w}
        ask = {w for w in new.difference(table) if w not in parted}
        for pair in parted.values():
            ask.update(pair)
        words = list(ask.difference(table))
        self.chars += sum(map(len, words)) + sum(map(len, parted))
        table.update(zip(words, self.encode(words), strict=True))
        table.update((w, table[base] + table[tail]) for w, (base, tail) in parted.items())
        get = table.__getitem__
        return [b"".join(map(get, c)) for c in cut]


def word_table(path: str) -> WordTable:
    """A worker's table: shards are small, so a table for each would learn the common words again and again."""
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def key_of(ident: int | None) -> bytes:
    return b"" if ident is None else struct.pack(">Q", ident + 2**63)


def ident_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def bloom_bits(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """Positions of each key: two 64-bit hashes combined ``hashes`` times."""
    a = np.fromiter((xxhash.xxh64_intdigest(k, 0) for k in keys), np.uint64, len(keys))
    b = np.fromiter((xxhash.xxh64_intdigest(k, 1) | 1 for k in keys), np.uint64, len(keys))
    return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """One shard; entries come in ascending key order."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = fs_of(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.width, self.z = width, zstandard.ZstdCompressor(1)
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index = bytearray()
        self.keys: list[bytes] = []
        self.ids = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: 32-bit little-endian."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys do not ascend")
        value = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(ids) // 4
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.z.compress(bytes(self.block))
            self.out.write(data)
            self.index += varint(len(self.last)) + self.last + varint(self.at) + varint(len(data))
            self.at += len(data)
            self.block, self.last = bytearray(), b""

    def close(self) -> tuple[int, int]:
        self.flush()
        bits = max(64, (len(self.keys) * BITS + 7) // 8 * 8)
        field = np.zeros(bits, np.bool_)
        field[bloom_bits(self.keys, bits, HASHES).ravel().astype(np.int64)] = True
        bloom, index = np.packbits(field).tobytes(), bytes(self.index)
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.ids, self.width, HASHES, MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.keys), self.ids


class Reader:
    """One shard: lookup of a key, or all entries in order."""

    def __init__(self, uri: str):
        fs, path = fs_of(uri)
        self.f = fs.open_input_file(path)
        foot = self.f.read_at(FOOTER.size, self.f.size() - FOOTER.size)
        at, size, bloom_at, bloom_size, self.documents, self.ids, self.width, self.hashes, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"not a sorted string table: {uri}")
        raw, i = self.f.read_at(size, at), 0
        self.lasts: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        while i < len(raw):
            n, i = read_varint(raw, i)
            self.lasts.append(raw[i : i + n])
            p, i = read_varint(raw, i + n)
            n, i = read_varint(raw, i)
            self.places.append((p, n))
        self.bloom = np.frombuffer(self.f.read_at(bloom_size, bloom_at), np.uint8)
        self.z = zstandard.ZstdDecompressor()

    def may_hold(self, key: bytes) -> bool:
        at = bloom_bits([key], len(self.bloom) * 8, self.hashes)[0].astype(np.int64)
        return bool((self.bloom[at >> 3] >> (7 - (at & 7)) & 1).all())

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, size = self.places[i]
        raw, j, key = self.z.decompress(self.f.read_at(size, at)), 0, b""
        while j < len(raw):
            shared, j = read_varint(raw, j)
            own, j = read_varint(raw, j)
            n, j = read_varint(raw, j)
            key = key[:shared] + raw[j : j + own]
            j += own
            yield key, np.frombuffer(raw, f"<u{self.width}", n // self.width, j)
            j += n

    def get(self, ident: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier."""
        key, out = key_of(ident), []
        if not self.may_hold(key):
            return out
        i = bisect.bisect_left(self.lasts, key)
        while i < len(self.places):
            for k, ids in self.block(i):
                if k == key:
                    out.append(ids)
                elif k > key:
                    return out
            i += 1
        return out

    def entries(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def close(self) -> None:
        self.f.close()


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the shards; their manifest: shard, path, last_key, documents, ids."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))
    if not shards:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    cuts = range_cuts(docs, key, shards)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), bucket_of(key, cuts).alias("shard"))
    dealt = rows.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "text")
    end = struct.pack("<I", end_id)

    @tidy
    def run(batches):
        table = word_table(tokenizer)
        width = 2 if max(table.vocabulary, end_id + 1) <= 1 << 16 else 4
        shard, w, uri, ident = None, None, "", None

        def closed():
            n, ids = w.close()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([ident], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.int64())], names=["shard", "path", "last_key", "documents", "ids"])

        for batch in batches:
            for start, n in spells(batch.column(1), ROWS, SIZE):
                b = batch.slice(start, n)
                for i, value, s in zip(b.column(0).to_pylist(), table.texts(b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                    if s != shard:
                        if w:
                            yield closed()
                        shard, uri = s, f"{folder}/{s:06d}.sst"
                        w = Writer(uri, width)
                    w.add(key_of(i), value + end)
                    ident = i
        if w:
            yield closed()

    return dealt.mapInArrow(run, "shard int, path string, last_key long, documents long, ids long")


def read_shards(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """Every document of the shards, with the number of ids of all documents before it."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each shard, no more
    placed = manifest.select("path", before.cast("long").alias("start")).repartition(n)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * ids

    def run(batches):
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r, out, size = Reader(path), [], 0
                for key, value in r.entries():
                    row = [ident_of(key), start, len(value), zlib.crc32(value.astype("<u4").tobytes())]
                    out.append(row + [value.astype(np.int32)] * ids)
                    start += len(value)
                    size += 50 + 4 * len(value) * ids
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                r.close()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of the wanted identifiers: each goes to the shard of its range and is searched there."""
    rows = sorted((r["last_key"] if r["last_key"] is not None else LEAST, r["path"]) for r in manifest.select("last_key", "path").collect())  # a row for each shard
    paths = [p for _, p in rows]
    at = bucket_of(F.col(id_col).cast("long"), [k for k, _ in rows])

    def run(batches):
        opened: dict[int, Reader] = {}
        for b in batches:
            out = []
            for ident, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ident is not None and i < len(paths):
                    if i not in opened:
                        opened[i] = Reader(paths[i])
                    out += [(ident, v.astype(np.int32)) for v in opened[i].get(ident)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return wanted.select(F.col(id_col).cast("long"), at.alias("at")).repartition("at").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, **options) -> DataFrame:
    spark = docs.sparkSession
    manifest = written(spark, write_shards(docs, tokenizer, shared_dir(spark, "sst"), end_id, **options), "sst-manifest")
    return read_shards(manifest)
