"""Helpers that the corpus operators share: scratch tables, bit filters, text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The largest bit filter that is ever built: 2**26 bits, 8 MB.  A filter over
# more keys than that lets more rows pass; what passes is always joined exactly.
MAX_FILTER_BITS = 1 << 26
_BITMAP_BITS = 32768  # bits of one bitmap that bitmap_construct_agg makes


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Where the setting is missing on one machine, as in tests, a folder of this
    machine is made and set as the checkpoint folder; on a cluster that fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


# Rows that Spark hands to Python at once, unless the session says otherwise: texts may be long.
ROWS_A_BATCH = 1000


_shipped: set[str] = set()  # applications whose workers can import this package


def prepare(spark: SparkSession) -> None:
    """Before Python workers get texts: send them this package, and make batches small where their size is still Spark's default."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="quern-")) / "quern_package.zip", "w") as package:
            for file in sorted(home.rglob("*.py")):
                package.write(file, file.relative_to(home.parent))
        context.addPyFile(package.filename)
        _shipped.add(context.applicationId)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") in (None, "10000"):
        spark.conf.set(name, str(ROWS_A_BATCH))


class Scratch:
    """Tables of one run of an operator, written as Parquet in the shared folder.

    They cut lineage and outlive lost executors.  A result may still read them,
    so they stay until the end of the process, or until whoever `owned` the run
    releases them.
    """

    open: list[Scratch] = []
    owner: str | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.owner = spark, Scratch.owner
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.open.append(self)

    def table(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.options(**(options or {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        Scratch.open.remove(self)
        _delete(self.spark, self.path)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Runs in this block belong to `owner`; what it owned before, and has written by now, is deleted first."""
    for scratch in [s for s in Scratch.open if s.owner == owner]:
        scratch.close()
    Scratch.owner = owner
    try:
        yield
    finally:
        Scratch.owner = None


def _delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context.hadoopConfiguration()).delete(target, True)


@atexit.register
def _close_all() -> None:
    for scratch in list(Scratch.open):
        try:
            scratch.close()
        except Exception:  # noqa: BLE001 - the JVM may have gone already
            return


def filter_bits(n_keys: int) -> int:
    """Bits of a filter for so many keys: 16 a key, a power of two, within MAX_FILTER_BITS."""
    return min(MAX_FILTER_BITS, max(_BITMAP_BITS, 1 << (16 * max(1, n_keys) - 1).bit_length()))


def bit_of(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits))


def bit_filter(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """(part, bitmap): the set bits of `key` modulo `bits`, at most bits / 8 bytes in all."""
    at = bit_of(key, bits) + 1
    return (
        keys.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("at"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("at").alias("bitmap"))
    )


def flagged(rows: DataFrame, name: str, key: Column, bits: int, bitmaps: DataFrame) -> DataFrame:
    """`rows` with a boolean column: whether the key may be in the filter.

    The bitmaps take at most bits / 8 bytes, so they are broadcast.
    """
    at = bit_of(key, bits)
    place = rows.withColumn("quern_part", F.floor(at / _BITMAP_BITS) + 1).withColumn("quern_at", at % _BITMAP_BITS)
    small = F.broadcast(bitmaps.select(F.col("part").alias("quern_part"), F.col("bitmap").alias("quern_bitmap")))
    byte = F.conv(F.hex(F.expr("substring(quern_bitmap, cast(quern_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(quern_at % 8 as int))")) != 0, F.lit(False))
    return place.join(small, "quern_part", "left").withColumn(name, hit).drop("quern_part", "quern_at", "quern_bitmap")


def passing(rows: DataFrame, key: Column, bits: int, bitmaps: DataFrame) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and few others."""
    return flagged(rows, "quern_may", key, bits, bitmaps).where("quern_may").drop("quern_may")


def parted(rows: DataFrame, key: Column, keys: DataFrame, keys_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among `keys`, rows whose key isn't): only the first need a join, and so a shuffle."""
    bits = filter_bits(keys.count())
    both = flagged(rows, "quern_may", key, bits, bit_filter(keys, keys_key, bits))
    return both.where("quern_may").drop("quern_may"), both.where("not quern_may").drop("quern_may")


def bits_to_numpy(bitmaps: DataFrame, bits: int) -> np.ndarray:
    """The filter as bytes on the driver: at most MAX_FILTER_BITS / 8 of them."""
    out = np.zeros(bits // 8, dtype=np.uint8)
    width = _BITMAP_BITS // 8
    for row in bitmaps.collect():
        out[(row["part"] - 1) * width : row["part"] * width] = np.frombuffer(bytes(row["bitmap"]), dtype=np.uint8)
    return out


def in_bits(filter_bytes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 keys may be in the filter."""
    at = (keys.astype(np.int64) & np.int64(len(filter_bytes) * 8 - 1)).astype(np.int64)
    return (filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one; null is an empty text."""
    array = batch.column(column)
    for at in range(0, len(array), 256):
        for value in array.slice(at, 256).to_pylist():
            yield value or ""


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of a batch without copies; null is an empty text."""
    array = batch.column(column)
    if not (pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)):
        array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
