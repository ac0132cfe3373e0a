"""Token ids as Arrow files with fixed-size-list batches.

A shard is one Arrow file: rows of `input_ids`, a fixed-size list of ids, and
`mask`, which of them are tokens and not padding.  All rows have one length
and no compression, so a reader maps the file and finds any row by
arithmetic, without a copy.  The file's metadata lists its documents and their
lengths.  Documents follow each other in ascending order of their ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm.common import Scratch, prepare, texts

SEQUENCE = 2048
# Tokens after which a shard is closed, at the end of a document.
SHARD_TOKENS = 1 << 23
# Pieces of words that a worker's encoder remembers: some 65 MB.
CACHED_WORDS = 400_000
_ROWS_A_BATCH = 256


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shard(uri: str, ids: np.ndarray, doc_ids: pa.Array, lengths: list[int], sequence: int = SEQUENCE) -> None:
    """One shard; it appears under its name only when it is whole."""
    rows = -(-len(ids) // sequence)
    padded = np.zeros(rows * sequence, dtype=ids.dtype)
    padded[: len(ids)] = ids
    mask = np.zeros(rows * sequence, dtype=bool)
    mask[: len(ids)] = True
    table = pa.table({
        "input_ids": pa.FixedSizeListArray.from_arrays(pa.array(padded), sequence),
        "mask": pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence),
    })
    index = pa.BufferOutputStream()
    documents = pa.table({"doc_id": doc_ids, "n_tokens": pa.array(lengths, pa.int64())})
    with pa.ipc.new_stream(index, documents.schema) as out:
        out.write_table(documents)
    table = table.replace_schema_metadata({b"documents": index.getvalue().to_pybytes(), b"tokens": str(len(ids)).encode()})
    store, path = _store(uri)
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/_{name}") as file, pa.ipc.new_file(file, table.schema) as out:
        out.write_table(table, max_chunksize=_ROWS_A_BATCH)
    store.move(f"{folder}/_{name}", path)


class Shard:
    """Random access to a shard: rows by number, documents by number."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        local = store.type_name == "local"
        self.file = pa.memory_map(path) if local else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.file)
        found = self.reader.schema.metadata
        self.documents = pa.ipc.open_stream(found[b"documents"]).read_all()
        self.tokens = int(found[b"tokens"])
        self.sequence = self.reader.schema.field("input_ids").type.list_size
        self.starts = np.concatenate([[0], np.cumsum(self.documents.column("n_tokens").to_numpy())]).astype(np.int64)

    def row(self, number: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of a row; the ids are a view of the file."""
        batch = self.reader.get_batch(number // _ROWS_A_BATCH)
        at = number % _ROWS_A_BATCH
        return batch.column("input_ids").slice(at, 1).flatten().to_numpy(), batch.column("mask").slice(at, 1).flatten()

    def tokens_between(self, start: int, end: int) -> np.ndarray:
        span = self.sequence * _ROWS_A_BATCH
        parts = []
        for number in range(start // span, -(-end // span)):
            ids = self.reader.get_batch(number).column("input_ids").flatten().to_numpy()
            parts.append(ids[max(0, start - number * span) : end - number * span])
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def document(self, number: int) -> np.ndarray:
        return self.tokens_between(int(self.starts[number]), int(self.starts[number + 1]))

    def close(self) -> None:
        self.file.close()


def _write(folder: str, path: str, kind: str, end_id: int, sequence: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = tokens.encoder(path, kind, CACHED_WORDS), TaskContext.get().partitionId(), 0
        width = np.uint16 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else np.uint32
        end = np.asarray([end_id], dtype=width)
        parts: list[np.ndarray] = []
        doc_ids, lengths, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal parts, doc_ids, lengths, held, number
            uri = f"{folder}/shard-{part:06d}-{number:04d}-{uuid.uuid4().hex}.arrow"
            whole = np.concatenate(parts)
            parts.clear()  # before the shard takes room of its own
            write_shard(uri, whole, pa.array(doc_ids, id_type), lengths, sequence)
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "uri": [uri], "n_tokens": [held]})
            parts, doc_ids, lengths, held, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts(batch)), strict=True):
                parts += [np.frombuffer(ids, dtype="<u4").astype(width), end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4 + 1)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    return run


def write_token_files(
    spark: SparkSession,
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    kind: str = "byte",
    end_id: int = 2,
    sequence: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Lazily write shards into `folder`; rows (part, number, uri, n_tokens), one a shard, in order of part and number.

    Texts go to tasks by ranges of their ids and are encoded there.  A shard
    counts only if its row is kept, so a task that ran twice does no harm.
    A null or empty text is the end id alone; a null id comes first; rows that
    share an id follow each other in the order of their texts' hashes.  Other
    columns are not read; an empty table gives no shard.
    """
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(_write(folder, tokenizer, kind, end_id, sequence, shard_tokens), "part long, number long, uri string, n_tokens long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
            shard = Shard(uri)
            documents = shard.documents.column("doc_id").combine_chunks()
            for at in range(0, len(documents), 1024):
                to = min(len(documents), at + 1024)
                cut = 4 * (shard.starts[at : to + 1] - shard.starts[at])
                whole = shard.tokens_between(int(shard.starts[at]), int(shard.starts[to])).astype("<u4").tobytes()
                ids = [whole[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                starts = pa.array(base + shard.starts[at:to])
                yield pa.RecordBatch.from_arrays([documents.slice(at, to - at), starts, pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
            shard.close()


def read_token_files(spark: SparkSession, shards: DataFrame, id_type: str = "long") -> DataFrame:
    """The documents in the shards, read from the files: doc_id, start, ids.

    `start` counts the ids of all documents before; `ids` are little-endian
    unsigned 32-bit integers.  `shards` has one row for each 8 M tokens, which
    one task sums up in order.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part", "number")) - F.col("n_tokens")
    placed = shards.select("part", "number", "uri", before.alias("base"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, "uri").select("uri", "base")
    return dealt.mapInArrow(_read, f"doc_id {id_type}, start long, ids binary")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", **options) -> DataFrame:
    """Write all documents as shards into the shared folder and read them back."""
    scratch = Scratch(spark, "tokens")
    written = write_token_files(spark, docs, f"{scratch.path}/files", tokenizer, id_col=id_col, **options)
    # The list is small: by `part`, rows of a task that runs again stay together, and adaptive execution makes few files of it.
    shards = scratch.table(written.repartition("part"), "shards")
    return read_token_files(spark, shards, docs.schema[id_col].dataType.simpleString())
