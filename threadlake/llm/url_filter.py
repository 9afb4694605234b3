"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

A list of rules and of blocked places becomes one file: the ascending xxhash64 keys, the offsets of
the stored strings, the strings. Every url asks for each suffix of its host that has no more labels than the
longest listed host (longer ones can't be listed) with each prefix of its path that is as long as some listed path; ``searchsorted`` finds all keys of a batch at once, and a
hit counts only if the stored string is the very string asked for, so a digest collision decides
nothing.

Null urls and urls without ``://`` have empty host and path and fit nothing. Of the rules that fit,
the longest (host and path together) wins; a tie is impossible, as two rules of one length that both
fit a url are the same string. Repeated rows are judged alike; an empty table gives an empty result;
only the two named columns are read, so further columns and their names do not matter.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fs_of, put_file, shared_dir, tidy

#: (verdict, host and path); a rule's host ends at its first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Blocked places for urls that no rule fits.
BLOCKED = ("ads.example.net/", "tracker.example.net/", "spam.example.com/")

MAGIC = b"DIGESTS2"
ROWS = 4096
KINDS = ("allow", "block", "listed")


def build(uri: str, rules: Iterable[tuple[str, str]], blocked: Iterable[str]) -> None:
    """Write the array. The lists come from the caller's memory, so they are as bounded as it is."""
    texts = [(s, KINDS.index(v)) for v, s in rules] + [(s, 2) for s in blocked]
    keyed = sorted({(xxhash.xxh64_intdigest(s.encode()), s.encode(), k) for s, k in texts})
    blob = io.BytesIO()
    offsets = [0]
    for _, s, k in keyed:
        blob.write(bytes([k]) + s)
        offsets.append(blob.tell())
    lens = sorted({len(s[s.index("/") :]) for s, _ in texts})
    labels = max((s[: s.index("/")].count(".") + 1 for s, _ in texts), default=0)

    def write(out):
        out.write(MAGIC + struct.pack("<QQQ", len(keyed), len(lens), labels))
        out.write(np.array([h for h, _, _ in keyed], "<u8").tobytes())
        out.write(np.array(offsets, "<u8").tobytes())
        out.write(np.array(lens, "<u8").tobytes())
        out.write(blob.getvalue())

    put_file(uri, write)


class DigestArray:
    """The file, mapped into memory where it is local, else read once by a worker."""

    def __init__(self, uri: str):
        from pyarrow import fs as pafs

        fs, path = fs_of(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            raw = np.memmap(path, np.uint8, "r")
        else:
            with fs.open_input_stream(path, compression=None) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"not a digest array: {uri}")
        n, m, self.labels = struct.unpack("<QQQ", raw[8:32].tobytes())
        at = 32
        self.keys = raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = raw[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.path_lengths = [int(x) for x in raw[at : at + 8 * m].view("<u8")]
        self.blob = raw[at + 8 * m :]

    def find(self, asked: list[bytes]) -> list[list[int]]:
        """For each string, the kinds it is stored with."""
        digests = np.fromiter((xxhash.xxh64_intdigest(s) for s in asked), np.uint64, len(asked))
        lo, hi = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        out: list[list[int]] = [[] for _ in asked]
        for i in np.flatnonzero(hi > lo):
            for j in range(lo[i], hi[i]):
                entry = self.blob[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes()
                if entry[1:] == asked[i]:
                    out[i].append(entry[0])
        return out


def judge(hosts: list[str], paths: list[str], array: DigestArray) -> tuple[list[str | None], list[str]]:
    """Rule (or None) and verdict of each host and path."""
    asked: list[bytes] = []
    owner: list[int] = []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        parts = host.rsplit(".", array.labels)[-array.labels :] if host and array.labels else []
        suffixes = [".".join(parts[k:]) for k in range(len(parts))]
        for n in array.path_lengths:
            if n <= len(path):
                for s in suffixes:
                    asked.append((s + path[:n]).encode())
                    owner.append(i)
    rules: list[str | None] = [None] * len(hosts)
    verdicts = ["allow"] * len(hosts)
    best = [-1] * len(hosts)
    for s, i, kinds in zip(asked, owner, array.find(asked), strict=True):
        for k in kinds:
            if k < 2 and len(s) > best[i]:
                best[i], rules[i], verdicts[i] = len(s), s.decode(), KINDS[k]
            elif k == 2 and best[i] < 0:
                verdicts[i] = "block"
    return rules, verdicts


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES, blocked: Iterable[str] = BLOCKED
) -> DataFrame:
    """``id_col``, host, path, rule (null: none fits), verdict for every row."""
    spark = pages.sparkSession
    uri = f"{shared_dir(spark, 'urls')}/digests.bin"
    build(uri, rules, blocked)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = pages.select(
        F.col(id_col),
        F.translate(F.regexp_extract(url, split, 1), upper, lower).alias("host"),
        F.regexp_extract(url, split, 2).alias("path"),
    )

    @tidy
    def run(batches):
        array = DigestArray(uri)
        for b in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            rule, verdict = judge(b.column(1).to_pylist(), b.column(2).to_pylist(), array)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*b.schema.names, "rule", "verdict"])

    kind = parts.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
