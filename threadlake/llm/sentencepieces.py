"""SentencePiece encoding and decoding with a table of distinct chunks.

In a model whose pieces never hold a whitespace marker after another character, no merge can cross
from a word into the marker of the next one. A text is then cut at its spaces, each distinct marked
word is segmented once by the sentencepiece library, and the ids are joined back by position. The
cut is as exact as the library itself: it is refused (``ValueError``) for a model with crossing
pieces, a normalisation other than identity, or without the leading marker. Texts are also cut at line
feeds, if no piece holds one: an unknown character is never merged with a neighbour.

The table lives as long as a task and is emptied once its chunks have ``TABLE_CHARS`` characters, so memory is
bounded and only time depends on how often words repeat. Texts are taken in slices bounded in bytes, a very long one on its own. A null text is the empty text, which has no ids.
Repeated rows are encoded alike; an empty table gives an empty result; only the identifier and the
text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spells, tidy

MARK = "▁"
TABLE_CHARS = 1_000_000
ROWS, SIZE = 512, 1 << 20

_models: dict = {}


class ChunkCodec:
    """Distinct chunk -> (ids as text, how many, decoded text, ids as 32-bit bytes)."""

    def __init__(self, model: str):
        self.sp = processor(model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a marker after another character: the chunks are not independent")
        probe = "  ﬁ é ½  a "
        if self.sp.decode(self.sp.encode(probe)) != probe or not self.sp.id_to_piece(self.sp.encode("a")[0]).startswith(MARK):
            raise ValueError("the model normalises texts: chunks would not be texts")
        self.lines = not any("\n" in p for p in pieces)
        self.table: dict[str, tuple[str, int, str, bytes]] = {}
        self.chars = 0

    def chunks(self, text: str) -> list[str]:
        """The marked words, whose concatenation is the text after a leading marker."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        words = text.split(" ")
        if "" in words:  # runs of spaces, or one at an end: the markers belong to the word that follows
            out, run = [], ""
            for w in words:
                run += MARK
                if w:
                    out.append(run + w)
                    run = ""
            if run:
                out.append(run)
        else:
            out = [MARK + w for w in words]
        if self.lines and "\n" in text:
            cut: list[str] = []
            for c in out:
                if "\n" in c:
                    parts = c.split("\n")
                    cut.append(parts[0] + "\n")
                    cut += [p + "\n" for p in parts[1:-1]]
                    if parts[-1]:
                        cut.append(parts[-1])
                else:
                    cut.append(c)
            return cut
        return out

    def learn(self, new: list[str]) -> None:
        """Segments the chunks at one go. The library puts a marker before every text: one is taken off, or a leading line feed shields it."""
        marked = [c for c in new if c.startswith(MARK) and len(c) > 1]
        inner = [c for c in new if not c.startswith(MARK)]
        ids = self.sp.encode([c[1:].replace(MARK, " ") for c in marked], num_threads=1) if marked else []
        shield = len(self.sp.encode("\n"))
        ids += [x[shield:] for x in self.sp.encode(["\n" + c for c in inner], num_threads=1)] if inner else []
        chunks = marked + inner
        if MARK in new:
            chunks.append(MARK)
            ids.append([self.sp.piece_to_id(MARK)])
        texts = self.sp.decode(ids, num_threads=1) if ids else []
        for c, x, t in zip(chunks, ids, texts, strict=True):
            self.chars += len(c)
            self.table[c] = (",".join(map(str, x)), len(x), " " + t if c[0] == MARK else t, np.array(x, np.int32).tobytes())

    def encode(self, texts: list[str | None]) -> list[list[tuple[str, int, str, bytes]]]:
        """For each text its table entries in order."""
        cut = [self.chunks(t or "") for t in texts]
        if self.chars > TABLE_CHARS:
            self.table.clear()
            self.chars = 0
        new: set[str] = set()
        for c in cut:
            new.update(c)
        self.learn(list(new.difference(self.table)))
        get = self.table.__getitem__
        return [list(map(get, c)) for c in cut]


def processor(model: str):
    """The library's model, loaded once by a worker; its size is fixed."""
    if model not in _models:
        import sentencepiece

        _models[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _models[model]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = True) -> DataFrame:
    """``id_col``, n_tokens, and as asked: ids array<int> and decoded (the text of ``decode(ids)``), ids_sha256 and decoded_sha256."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    names = [id_col, "n_tokens"] + ["ids_sha256", "decoded_sha256"] * digests + ["ids", "decoded"] * ids

    @tidy
    def run(batches):
        c = ChunkCodec(model)
        for batch in batches:
            for start, n in spells(batch.column(1), ROWS, SIZE):
                b = batch.slice(start, n)
                found = c.encode(b.column(1).to_pylist())
                joined = [",".join([e[0] for e in f]) for f in found]
                decoded = ["".join([e[2] for e in f])[1:] for f in found]
                cols = [b.column(0), pa.array([sum([e[1] for e in f]) for f in found], pa.int64())]
                if digests:
                    cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in y]) for y in (joined, decoded)]
                if ids:
                    ends = np.cumsum([0] + [sum([e[1] for e in f]) for f in found])
                    flat = np.frombuffer(b"".join([e[3] for f in found for e in f]), np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long" + ", ids_sha256 string, decoded_sha256 string" * digests + ", ids array<int>, decoded string" * ids)
