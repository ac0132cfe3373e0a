"""Removal of long repeated byte strings, by column-wise sorting of aligned contexts.

Two places that share a string of LENGTH bytes also share an anchor in it: the
least of its hashes of shorter strings, which depends on the string alone.  So
only contexts round anchors that stand in several places are gathered, anchor
by anchor, and aligned.  Each collection is then built up column by column: a
round inserts one symbol of every context, keeps the contexts in the order of
what has been inserted (the column of the collection's positional
Burrows-Wheeler transform) and updates how far neighbours agree.  Neighbours
that agree over LENGTH columns are repeats; there is no hashing in this test.
Columns lie in a file that is written once and read in sequence.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, bit_filter, bits_to_numpy, prepare, filter_bits, in_bits, mix64, parted, raw_texts

LENGTH = 400
# Contexts that are sorted at once.
COLLECTION = 1 << 14
# An anchor of more contexts than this is split by the bytes beside it, and so on until its parts are smaller.
LARGE_BUCKET = 1 << 16
_BLOCK = 1 << 19  # bytes whose anchors are sought at once
_LOW = np.uint64((1 << 20) - 1)
_ODD = 0x9E3779B97F4A7C15
_GAP = 256  # the symbol beyond a document's ends; it equals nothing


class Anchors:
    """Winnowing: the rightmost least hash of k bytes in each string of `length` bytes."""

    def __init__(self, length: int):
        self.k = length // 2
        self.window = length - self.k + 1
        p = np.full(_BLOCK + 2 * length + 1, _ODD, dtype=np.uint64)
        q = np.full(_BLOCK + 2 * length + 1, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
        p[0] = q[0] = 1
        with np.errstate(over="ignore"):
            self.up, self.down = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)

    def of(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the anchors of a text."""
        span = self.k + self.window - 1
        if len(raw) < span:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, hashes = [], []
        for at in range(0, len(raw) - span + 1, _BLOCK):
            s, h = self._block(raw[at : at + _BLOCK + span - 1])
            starts.append(s + at)
            hashes.append(h)
        if len(starts) == 1:
            return starts[0], hashes[0]
        found, first = np.unique(np.concatenate(starts), return_index=True)  # blocks overlap
        return found, np.concatenate(hashes)[first]

    def _block(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, w, n = self.k, self.window, len(raw)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
            h = mix64((total[k:] - total[:-k]) * self.down[: n - k + 1])
        m = len(h)
        key = (h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64))  # of equal hashes the last is least
        blocks = -(-m // w)
        padded = np.full(blocks * w, np.uint64(2**64 - 1))
        padded[:m] = key
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: m - w + 1], ahead[w - 1 : m])
        place = (_LOW - (least & _LOW)).astype(np.int64)
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        return place, h[place].astype(np.int64)


def _each(batch: pa.RecordBatch, seen: set[bytes]) -> Iterator[tuple[int, np.ndarray, bytes, bool]]:
    """(row, bytes, SHA-256, whether this task meets the text first)."""
    raw, offsets = raw_texts(batch)
    for i in range(batch.num_rows):
        part = raw[offsets[i] : offsets[i + 1]]
        sha = hashlib.sha256(part).digest()
        yield i, part, sha, sha not in seen
        seen.add(sha)


def _beside(part: np.ndarray, start: int, side: int, length: int) -> tuple[int, bytes]:
    """(bytes before the anchor, the context): what lies round the anchor at `start`."""
    low = max(0, start - side)
    return start - low, part[low : start + length].tobytes()


def _ends(part: np.ndarray, at: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, anchor, n): of each anchor's places in a text the first, with the number of its different contexts, and the last, with 0."""
    if not len(h):
        return at, h, h
    side = length - length // 2
    found, first, n = np.unique(h, return_index=True, return_counts=True)
    for k in np.flatnonzero(n > 2):
        n[k] = len({_beside(part, int(start), side, length) for start in at[h == found[k]]})
    last = len(h) - 1 - np.unique(h[::-1], return_index=True)[1]
    more = last != first
    return np.concatenate([at[first], at[last[more]]]), np.concatenate([found, found[more]]), np.concatenate([n, np.zeros(more.sum(), n.dtype)])


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, seen = Anchors(length), set()
        for batch in batches:
            sizes, shas, places, hashes, counts = [], [], [], [], []
            for _, part, sha, new in _each(batch, seen):
                at, h, n = _ends(part, *anchors.of(part), length) if new else [np.zeros(0, np.int64)] * 3
                sizes.append(len(part))
                shas.append(sha)
                places.append(at)
                hashes.append(h)
                counts.append(n)
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (places, hashes, counts)]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "sha", "places", "anchors", "counts"])

    return run


_CONTEXT = "anchor long, sha binary, starts array<long>, before int, context binary"


def _contexts(shared, length: int):
    """The bytes round each anchor that may stand in several places.

    Of a text's places with one anchor and equal bytes round it, as periodic
    text has many, there is one row with all their starts.
    """

    def rows(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["anchor", "sha", "starts", "before", "context"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, seen = Anchors(length), set()
        side = length - anchors.k
        for batch in batches:
            out: list[tuple] = []
            for _, part, sha, new in _each(batch, seen):
                if not new or len(part) < length:
                    continue
                at, h = anchors.of(part)
                same: dict[tuple[int, int, bytes], list[int]] = {}
                for i in np.flatnonzero(in_bits(shared.value, h)):
                    same.setdefault((int(h[i]), *_beside(part, int(at[i]), side, length)), []).append(int(at[i]))
                for (anchor, before, context), starts in same.items():
                    out.append((anchor, sha, starts, before, context))
                    if len(out) >= 4096:
                        yield rows(out)
                        out = []
            if out:
                yield rows(out)

    return run


def column_matches(symbols: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the first and last column at which a repeat of `length` symbols begins, or (-1, -1).

    `symbols` has one row a column; contexts of one bucket stand side by side.
    `order` holds the contexts by what has been inserted, read backwards from
    the last symbol; `agree` the column from which a context agrees with the
    one before it in that order.
    """
    columns, n = symbols.shape
    first, last = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    order = np.arange(n)
    apart = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    agree = np.where(apart, columns + 1, 0).astype(np.int32)
    base = bucket.astype(np.int64) * (_GAP + 1)
    for c in range(columns):
        symbol = np.asarray(symbols[c])[order]
        key = base + symbol  # buckets keep their places, so base needs no reordering
        turn = np.argsort(key, kind="stable")
        sorted_key = key[turn]
        same = np.concatenate([[False], sorted_key[1:] == sorted_key[:-1]])
        fresh = np.full(n, columns + 1, dtype=np.int32)
        close = same & np.concatenate([[False], turn[1:] == turn[:-1] + 1])
        fresh[close] = agree[turn[close]]
        far = np.flatnonzero(same & ~close)
        if len(far):  # the latest column on the way from one to the other
            bounds = np.empty(2 * len(far), dtype=np.int64)
            bounds[::2], bounds[1::2] = turn[far - 1] + 1, turn[far] + 1
            fresh[far] = np.maximum.reduceat(np.append(agree, 0), bounds)[::2]
        starts_here = ~same
        fresh[starts_here] = c + 1
        symbol = symbol[turn]
        fresh[symbol == _GAP] = c + 1
        order, agree = order[turn], fresh
        if c + 1 >= length:
            hit = np.flatnonzero(same & (agree <= c + 1 - length))
            rows = np.concatenate([order[hit], order[hit - 1]])
            last[rows] = c + 1 - length
            first[rows[first[rows] < 0]] = c + 1 - length
    return first, last


def _turns(rows: pa.Table) -> np.ndarray:
    """Whether each row but the first has another key than the one before it."""
    key = rows.column("key").combine_chunks()
    return pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)


def _collections(length: int):
    """(sha, from, to): covered spans, from contexts sorted by key."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        k = length // 2
        side, width = length - k, 2 * length - k
        rows = table.combine_chunks()
        before, bucket = rows.column("before").to_numpy(), np.concatenate([[0], np.cumsum(_turns(rows))])
        raw, offsets = raw_texts(pa.RecordBatch.from_arrays([rows.column("context").combine_chunks().cast(pa.large_binary())], ["text"]))
        sizes = np.diff(offsets)
        with tempfile.TemporaryFile() as file:
            symbols = np.memmap(file, dtype=np.uint16, mode="w+", shape=(width, len(before)))
            for at in range(0, len(before), 1024):
                part = np.full((min(1024, len(before) - at), width), _GAP, dtype=np.uint16)
                for i in range(len(part)):
                    left = side - before[at + i]
                    part[i, left : left + sizes[at + i]] = raw[offsets[at + i] : offsets[at + i + 1]]
                symbols[:, at : at + 1024] = part.T
            first, last = column_matches(symbols, bucket, length)
            del symbols
        several = (pc.list_value_length(rows.column("starts")).to_numpy() > 1) & (sizes >= length)  # whatever lies in it repeats
        first = np.where(several, side - before, first)
        last = np.where(several, side - before + sizes - length, last)
        hit = np.flatnonzero(first >= 0)
        found = rows.select(["sha", "starts"]).take(pa.array(hit))
        out: list[tuple[bytes, int, int]] = []
        for i, sha, starts in zip(hit, found.column("sha").to_pylist(), found.column("starts").to_pylist(), strict=True):
            begin = end = -1
            for start in starts:  # in order, so neighbours can be joined
                a, b = start - side + int(first[i]), start - side + int(last[i]) + length
                if a > end >= 0:
                    out.append((sha, begin, end))
                    begin = a
                begin, end = (a if begin < 0 else begin), b
            out.append((sha, begin, end))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["sha", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows < COLLECTION:
                continue
            turns = np.flatnonzero(_turns(rest)) + 1
            if len(turns):  # whole buckets only
                yield spans(rest.slice(0, int(turns[-1])))
                rest = rest.slice(int(turns[-1]))
        if rest is not None and rest.num_rows:
            yield spans(rest)

    return run


def _digest(side: int, low: int, high: int) -> Column:
    """A digest of columns `low` to `high` (without it) of contexts that have them all, else null."""
    there = (F.col("before") >= side - low) & (F.octet_length("context") >= F.col("before") + (high - side))
    return F.when(there, F.sha2(F.concat(F.lit(f"{low} {high} ").cast("binary"), F.expr(f"substring(context, before + {low - side + 1}, {high - low})")), 256))


def _split(scratch: Scratch, contexts: DataFrame, length: int, large: int) -> DataFrame:
    """Contexts of large anchors, keyed so that every repeat lies within a key of about `large` rows at most.

    All repeats that begin in columns `low` to `high` have the columns from
    `high` to `low + length`, so contexts are keyed by those.  Of a key that is
    still large, contexts that agree from `low` to `high + length` need no more
    than one another there, in parts of bounded size that all hold one of them;
    one of each such class goes on to either half of the columns.  With one
    column left the two ranges are the same, and nothing goes on.
    """
    side, ready = length - length // 2, []
    waiting = [(0, side, contexts)]
    while waiting:
        later = []
        for low, high, rows in waiting:
            name = f"{low}-{high}"
            keyed = rows.withColumn("key", _digest(side, high, low + length)).where("key is not null").withColumn("whole", _digest(side, low, high + length))
            keyed = scratch.table(keyed, f"keyed-{name}")
            sizes = scratch.table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("key"), f"large-{name}")
            if sizes.isEmpty():
                ready.append(keyed.drop("whole"))
                continue
            ready.append(keyed.join(F.broadcast(sizes), "key", "left_anti").drop("whole"))  # at most a key for each `large` contexts
            many = keyed.join(F.broadcast(sizes), "key", "left_semi").drop("key")
            ones = many.where("whole is not null").groupBy("whole").agg(F.min(F.struct(contexts.columns)).alias("one"), F.count(F.lit(1)).alias("n"))
            ones = scratch.table(ones.select("whole", "n", "one.*"), f"ones-{name}")
            parts = F.ceil(F.col("n") / large)
            classes = F.broadcast(ones.where(F.col("n") > large).select("whole", parts.alias("parts")))  # as few
            dealt = many.where("whole is not null").join(classes, "whole", "left").withColumn("part", F.pmod(F.xxhash64("sha", "starts"), F.coalesce("parts", F.lit(1))))
            beside = ones.where(F.col("n") > large).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
            both = dealt.select(*contexts.columns, "whole", "part").unionByName(beside.select(*contexts.columns, "whole", "part"))
            both = both.dropDuplicates(["whole", "part", "sha", "starts", "before"])  # the one is in its own part already
            ready.append(both.select(*contexts.columns, F.concat_ws(" ", "whole", "part").alias("key")))
            if low < high:
                left = ones.select(contexts.columns).unionByName(many.where("whole is null").select(contexts.columns))
                middle = (low + high) // 2
                later += [(low, middle, left), (middle + 1, high, left)]
        waiting = later
    out = ready[0]
    for part in ready[1:]:
        out = out.unionByName(part)
    return out


def repeated_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, sha (of the text), spans.

    `spans` are the maximal runs of bytes covered by a string of `length` bytes
    that also starts anywhere else, in this text or another, as (from, to) in
    order.  Texts are UTF-8; null is empty; texts shorter than `length` have no
    spans; a text that occurs twice, as repeated rows too, is covered whole.
    A null id is kept.  Other columns are not read; an empty table gives an
    empty result.
    """
    prepare(spark)
    scratch = Scratch(spark, "repeats")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scanned = scratch.table(rows.mapInArrow(_scan(length), f"doc_id {id_type}, n_bytes long, sha binary, places array<long>, anchors array<long>, counts array<long>"), "scanned")

    pairs = scanned.where(F.size("anchors") > 0).select("sha", F.inline(F.arrays_zip("places", "anchors", "counts"))).toDF("sha", "place", "anchor", "n")
    where = F.xxhash64("sha", "place")
    met = pairs.groupBy("anchor").agg(F.min(where).alias("a"), F.max(where).alias("b"), F.sum("n").alias("n")).where("a <> b").select("anchor", "n")
    met = scratch.table(met, "met")
    bits = filter_bits(met.count())
    shared = spark.sparkContext.broadcast(bits_to_numpy(bit_filter(met, F.col("anchor"), bits), bits))
    contexts = rows.select("text").mapInArrow(_contexts(shared, length), _CONTEXT)
    large = scratch.table(met.where(F.col("n") > large_bucket).select("anchor"), "large")
    keyed = contexts.withColumn("key", F.col("anchor").cast("string"))
    if not large.isEmpty():  # at most one anchor for each `large_bucket` contexts
        contexts = scratch.table(contexts, "contexts")
        usual = contexts.join(F.broadcast(large), "anchor", "left_anti").withColumn("key", F.col("anchor").cast("string"))
        keyed = usual.unionByName(_split(scratch, contexts.join(F.broadcast(large), "anchor", "left_semi"), length, large_bucket))
    dealt = keyed.repartition("key").sortWithinPartitions("key", "sha")
    spans = dealt.mapInArrow(_collections(length), "sha binary, from long, to long")
    merged = spans.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("found"))  # a text's own
    merged = scratch.table(merged.mapInArrow(_merge, f"sha binary, spans {_SPANS}"), "merged")
    copies = scratch.table(scanned.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "copies")
    out = scanned.select("doc_id", "n_bytes", "sha").join(merged, "sha", "left").join(copies, "sha", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("to")))
    spans = F.when(F.col("rows").isNotNull(), whole).otherwise(F.coalesce("spans", F.array().cast(_SPANS)))
    return out.select("doc_id", "n_bytes", "sha", spans.alias("spans"))


_SPANS = "array<struct<from: bigint, to: bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for found in batch.column("found").to_pylist():
            merged: list[dict] = []
            for span in found:
                if merged and span["from"] <= merged[-1]["to"]:
                    merged[-1]["to"] = max(merged[-1]["to"], span["to"])
                else:
                    merged.append(span)
            out.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column("sha"), pa.array(out, _SPAN_TYPE)], ["sha", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = raw_texts(batch)
        kept = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            at, parts = int(offsets[i]), []
            for span in spans:
                parts.append(raw[at : offsets[i] + span["from"]])
                at = int(offsets[i]) + span["to"]
            parts.append(raw[at : offsets[i + 1]])
            kept.append(b"".join(p.tobytes() for p in parts))
        columns = [batch.column("doc_id"), pa.array(kept, pa.binary()), batch.column("n_bytes"), batch.column("spans")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "n_bytes", "spans"])


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """One row for each row of `docs`: doc_id, kept (the bytes left), n_bytes (before), spans (removed).

    See `repeated_spans` for what goes.  Only texts that lose bytes, and few
    others, go through a shuffle.
    """
    scratch = Scratch(spark, "removed")
    found = repeated_spans(spark, docs, id_col, text_col, length, large_bucket).where(F.size("spans") > 0)
    found = scratch.table(found.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "spans").dropDuplicates(["_id", "_sha"]), "found")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    maybe, clean = parted(rows, F.xxhash64("doc_id"), found, F.xxhash64("_id"))
    none = F.array().cast(_SPANS)
    on = maybe["doc_id"].eqNullSafe(found["_id"]) & (F.unhex(F.sha2("text", 256)) == found["_sha"])
    cut = maybe.join(found, on, "left").select("doc_id", "text", "n_bytes", F.coalesce("spans", none).alias("spans"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    cut = cut.mapInArrow(_cut, f"doc_id {id_type}, kept binary, n_bytes long, spans {_SPANS}")
    return cut.union(clean.select("doc_id", F.col("text").cast("binary").alias("kept"), "n_bytes", none.alias("spans")))
