"""Harmonic packing of token sequences into training windows.

A document is cut into pieces whose lengths are reciprocals of the capacity:
class k holds pieces of capacity // k tokens, and k of them fill a bin.  Every
task fills the bins of its own rows, so nothing is shuffled.  What a task has
left in bins that aren't full is cut into powers of two, which add up to full
bins but for at most one sequence of each smaller power.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm.common import prepare, texts

CAPACITY = 2048
# Tokens of padding that a full bin of a class may have.
MAX_PADDING = 8
# Words that a worker's encoder remembers: some 200 MB; fewer cost time.
CACHED_WORDS = 400_000


def class_sizes(capacity: int, max_padding: int = MAX_PADDING) -> list[int]:
    """Piece lengths, largest first: capacity // k wherever k pieces fill a bin up to `max_padding`."""
    sizes = {capacity // k for k in range(1, capacity + 1)}
    return sorted((s for s in sizes if capacity % s <= max_padding), reverse=True)


class Piece(NamedTuple):
    row: int  # the document, as its number in the task
    start: int
    length: int


class Packer:
    """Deals the pieces of one task into sequences; `add` and `finish` give (sequence, offset, piece)."""

    def __init__(self, capacity: int = CAPACITY):
        if capacity & (capacity - 1):
            raise ValueError(f"the capacity is a power of two, not {capacity}")
        self.capacity = capacity
        self.sizes = np.asarray(class_sizes(capacity)[::-1])
        self.open: dict[int, list[Piece]] = {}
        self.sequences = 0

    def add(self, row: int, length: int) -> Iterator[tuple[int, int, Piece]]:
        start = 0
        while start < length:
            size = int(self.sizes[np.searchsorted(self.sizes, min(length - start, self.capacity), "right") - 1])
            bin_ = self.open.setdefault(size, [])
            bin_.append(Piece(row, start, size))
            if len(bin_) == self.capacity // size:
                yield from self._close(self.open.pop(size))
            start += size

    def finish(self) -> Iterator[tuple[int, int, Piece]]:
        blocks: dict[int, list[list[Piece]]] = {}
        for bin_ in self.open.values():
            for row, start, length in bin_:
                for bit in reversed(range(length.bit_length())):
                    if length >> bit & 1:
                        blocks.setdefault(1 << bit, []).append([Piece(row, start, 1 << bit)])
                        start += 1 << bit
        self.open = {}
        size = 1
        while size < self.capacity:
            have = blocks.pop(size, [])
            blocks.setdefault(2 * size, []).extend(a + b for a, b in zip(have[::2], have[1::2], strict=False))
            if len(have) % 2:
                yield from self._close(have[-1])
            size *= 2
        for block in blocks.get(self.capacity, []):
            yield from self._close(block)

    def _close(self, pieces: list[Piece]) -> Iterator[tuple[int, int, Piece]]:
        offset = 0
        for piece in pieces:
            yield self.sequences, offset, piece
            offset += piece.length
        self.sequences += 1


_SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ROWS = 1024  # of a batch that is handed on


def _pack(path: str, kind: str, end_id: int, capacity: int, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens.encoder(path, kind, cached), Packer(capacity)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        waiting: dict[int, tuple[object, bytes, int]] = {}  # documents with pieces in open bins: id, token ids, tokens still open
        out: list[tuple] = []
        id_type = None

        def place(placed: Iterator[tuple[int, int, Piece]]) -> None:
            for sequence, offset, (row, start, length) in placed:
                doc_id, ids, left = waiting[row]
                out.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, first + sequence, offset))
                waiting[row] = (doc_id, ids, left - length)
                if left == length:
                    del waiting[row]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        row = 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts(batch)), strict=True):
                waiting[row] = (doc_id, ids + end, len(ids) // 4 + 1)
                place(packer.add(row, len(ids) // 4 + 1))
                row += 1
                if len(out) >= _ROWS:
                    yield batch_of(out)
                    out.clear()
        place(packer.finish())
        if out:
            yield batch_of(out)

    return run


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED_WORDS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its token ids, then `end_id`; `ids` are the piece's, as
    little-endian unsigned 32-bit integers; `cached` words are remembered by
    each worker's encoder.  Every id lies in exactly one piece
    and no sequence is longer than `capacity`; shorter ones are padded, unless
    their length is a power of two.  `sequence_id` is unique, with the task's
    number in its upper bits.  A null or empty text is the end id alone; a null
    id is kept; repeated rows are packed each for itself.  Other columns are
    not read; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_pack(tokenizer, kind, end_id, capacity, cached), _SCHEMA.format(id=id_type))
