"""Near-duplicate detection with SetSketch registers.

A register holds the truncated logarithm, to base 1.1, of the least of many
exponential variates, one of each shingle; registers of a union are the maxima
of both, so sketches merge.  Equal registers are likelier the more two sets
overlap: documents meet in buckets of four equal registers.  Pairs that meet
are estimated jointly, by the likelihood of the numbers of larger, smaller and
equal registers given both set sizes, and dropped only if no similarity from
the threshold up explains them.  The rest is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, bit_filter, prepare, filter_bits, mix64, parted, passing, raw_texts
from quern.llm.components import components

REGISTERS = 128
BAND = 4  # registers a band: at 0.8 a pair misses all 32 bands with probability 5e-8
BASE, RATE = 1.1, 20.0  # of the registers' scale
TOP = 255  # the largest register
# A pair is dropped if similarities below the threshold are e**MARGIN times likelier than any from it up;
# that happens to about six pairs in 100,000,000 that just reach it.
MARGIN = 14.0
# A bucket is compared in squares of so many members.
BLOCK = 1024
# Bytes of text that are looked at at once.
CHUNK = 1 << 19

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def split_words(raw: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case; both work on ASCII alone here, and these are the contract's blanks."""
    return raw.lower().split()


class Words:
    """The words of some texts that lie side by side: a hash and an exact number of each, and their bytes.

    A word's hash adds up mixed values of its bytes and their places, so it has
    no algebra by which words could be made to clash; where words of a hash
    differ all the same, their numbers do.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        inside = ~_BLANK[raw]
        fresh = np.zeros(len(raw) + 1, dtype=bool)  # where a text begins or all end
        fresh[bounds] = True
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (fresh[:-1] | ~before))
        self.lengths = np.flatnonzero(inside & (fresh[1:] | ~after)) + 1 - starts
        self.cut = np.searchsorted(starts, bounds)  # the first word of each text
        self.chars = _LOWER[raw[inside]]
        self.at = np.cumsum(self.lengths) - self.lengths  # of each word in `chars`
        place = np.arange(len(self.chars)) - np.repeat(self.at, self.lengths)
        with np.errstate(over="ignore"):
            mixed = mix64(((place.astype(np.uint64) << np.uint64(8)) | self.chars) * np.uint64(_ODD) + np.uint64(_ODD))
            sums = np.add.reduceat(mixed, self.at) if len(starts) else np.zeros(0, np.uint64)
            self.hashes = mix64(sums + self.lengths.astype(np.uint64))
        _, first, self.numbers = np.unique(self.hashes, return_index=True, return_inverse=True)
        one = first[self.numbers]
        alike = (self.lengths[one] == self.lengths).all() and (self.chars == self.chars[np.repeat(self.at[one], self.lengths) + place]).all()
        if not alike:
            seen: dict[bytes, int] = {}
            self.numbers = np.asarray([seen.setdefault(w, len(seen)) for w in self.spelt(np.arange(len(starts))).split(b" ")[:-1]], dtype=np.int64)

    def spelt(self, words: np.ndarray) -> bytes:
        """These words, each with a blank after it."""
        sizes = self.lengths[words]
        total = int(sizes.sum())
        out = np.full(total + len(words), 0x20, dtype=np.uint8)
        number = np.repeat(np.arange(len(words)), sizes)
        inner = np.arange(total)
        out[inner + number] = self.chars[inner + (self.at[words] - (np.cumsum(sizes) - sizes))[number]]
        return out.tobytes()


class LongWords:
    """The same for one text that is longer than a block, looked at block by block; blocks end at a blank."""

    def __init__(self, raw: np.ndarray):
        hashes, numbers, self.seen, at = [], [], {}, 0
        while at < len(raw):
            end = min(len(raw), at + CHUNK)
            while end < len(raw):
                blank = np.flatnonzero(_BLANK[raw[at:end]])
                if len(blank):
                    end = at + int(blank[-1]) + 1
                    break
                end += CHUNK  # one word longer than a block
            part = raw[at:end]
            hashes.append(Words(part, np.asarray([0, len(part)])).hashes)
            numbers.append(np.asarray([self.seen.setdefault(w, len(self.seen)) for w in split_words(part.tobytes())], dtype=np.int64))
            at = end
        self.hashes, self.numbers = np.concatenate(hashes), np.concatenate(numbers)
        self.cut, self.known = np.asarray([0, len(self.hashes)]), list(self.seen)

    def spelt(self, words: np.ndarray) -> bytes:
        return b"".join([self.known[n] + b" " for n in self.numbers[words].tolist()])


class ShingleSet(NamedTuple):
    hashes: np.ndarray  # distinct, sorted, 64 bits each
    size: int  # of the set of shingles itself
    sha: bytes  # SHA-256 of all its shingles, word by word, or empty


def _shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int, signed: bool = False) -> Iterator[ShingleSet]:
    """The set of each text; of fewer words, the whole sequence as one shingle."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= CHUNK:
            j += 1
        part = raw[offsets[i] : offsets[j]]
        found = Words(part, offsets[i : j + 1] - offsets[i]) if len(part) <= CHUNK else LongWords(part)
        hashes = found.hashes
        with np.errstate(over="ignore"):
            long = hashes[: max(0, len(hashes) - words + 1)].copy()
            for k in range(1, words):
                long = mix64(long * np.uint64(_ODD) + hashes[k : k + len(long)])
            for a, b in zip(found.cut[:-1].tolist(), found.cut[1:].tolist(), strict=True):
                if b - a >= words:
                    yield _set_of(found, a, long[a : b - words + 1], words, signed)
                elif b > a:
                    short = np.full(1, b - a, dtype=np.uint64)
                    for h in hashes[a:b]:
                        short = mix64(short * np.uint64(_ODD_INVERSE) + h)
                    yield _set_of(found, a, short, b - a, signed)
                else:
                    yield ShingleSet(np.zeros(0, dtype=np.uint64), 0, b"")
        i = j


def _set_of(found: Words | LongWords, first: int, hashes: np.ndarray, words: int, signed: bool) -> ShingleSet:
    """The set of the shingles that begin at word `first` and after; shingles count as one only if their words are the same."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    again = np.flatnonzero(~fresh)
    here, before, numbers = order[again] + first, order[again - 1] + first, found.numbers
    if len(again) and any((numbers[here + k] != numbers[before + k]).any() for k in range(words)):  # two shingles of one hash
        exact = sorted({found.spelt(np.arange(i, i + words)) for i in range(first, first + len(hashes))})
        return ShingleSet(ranked[fresh], len(exact), hashlib.sha256(b"%d " % words + b"".join(exact)).digest() if signed else b"")
    firsts = order[fresh] + first
    if not signed:
        return ShingleSet(ranked[fresh], len(firsts), b"")
    sha = hashlib.sha256(b"%d " % words)
    for at in range(0, len(firsts), 1 << 14):
        sha.update(found.spelt((firsts[at : at + (1 << 14), None] + np.arange(words)).ravel()))
    return ShingleSet(ranked[fresh], len(firsts), sha.digest())


_MULTIPLIERS = (mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1))[None, :]


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, 2**64 - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            np.minimum(least, (shingles[at : at + 2048, None] * _MULTIPLIERS).min(axis=0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


_SKETCH = "doc_id {id}, n_shingles long, sha binary, registers binary"


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, sketch = [], [], []
            for found in _shingle_sets(*raw_texts(batch), words, signed=True):
                sizes.append(found.size)
                shas.append(found.sha)
                sketch.append(registers(found.hashes).tobytes() if found.size else b"")
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "sha", "registers"])

    return run


_GRID = np.linspace(0.0, 1.0, 201)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def plausible(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether similarities from the threshold up may explain the register counts of pairs.

    `more` and `less` count registers where a's is larger or smaller.  The joint
    likelihood is taken over a grid of similarities that the sizes allow.
    """
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    p_more, p_less = np.maximum(_p(u - v * j), 1e-9), np.maximum(_p(v - u * j), 1e-9)
    equal = REGISTERS - more - less
    fit = more[:, None] * np.log(p_more) + less[:, None] * np.log(p_less) + equal[:, None] * np.log(np.maximum(1 - p_more - p_less, 1e-9))
    near = _GRID >= similarity - 1e-9
    return fit[:, near].max(axis=1) >= fit.max(axis=1) - MARGIN


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS)


def _screen(similarity: float):
    """Keeps the pairs (a, b, n_a, n_b, r_a, r_b) that may reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r_a, r_b = _matrix(batch.column("r_a")), _matrix(batch.column("r_b"))
            n_a, n_b = (np.asarray(batch.column(c), float) for c in ("n_a", "n_b"))
            keep = plausible((r_a > r_b).sum(1), (r_a < r_b).sum(1), n_a, n_b, similarity)
            keep &= np.minimum(n_a, n_b) >= (similarity - 1e-9) * np.maximum(n_a, n_b)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _hash_sets(words: int):
    """(rep, hashes): the set of a text as sorted 32-bit hashes; they only serve to rule pairs out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((s.hashes >> np.uint64(32)).astype(np.uint32)).tobytes() for s in _shingle_sets(*raw_texts(batch), words)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "hashes"])

    return run


def _candidates(group: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): of a square the pairs across components that neither sizes nor registers rule out."""
    label, n, regs, block = (group[k] for k in ("label", "n_shingles", "registers", "block"))
    same = group["row"][0] == group["col"][0]
    band, bands = int(group["key"][0] >> 32), np.ascontiguousarray(regs).view(np.uint32)
    for i in np.flatnonzero(block == group["row"][0]):
        right = np.arange(i + 1, len(n)) if same else np.flatnonzero(block == group["col"][0])
        right = right[label[right] != label[i]]
        right = right[np.minimum(n[right], n[i]) >= (similarity - 1e-9) * np.maximum(n[right], n[i])]
        # a pair counts in the first band that it shares
        right = right[~(bands[i, :band] == bands[right, :band]).any(axis=1)]
        if not len(right):
            continue
        more, less = (regs[i] > regs[right]).sum(1), (regs[i] < regs[right]).sum(1)
        right = right[plausible(more, less, np.full(len(right), float(n[i])), n[right].astype(float), similarity)]
        if len(right):
            yield i, right


def _possible(percent: int):
    """The members of squares that have a candidate there: rows sorted by (key, row, col, rep) in and out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, squares in _squares(batches):
            keep = np.zeros(table.num_rows, dtype=bool)
            for at, group in squares:
                for i, others in _candidates(group, percent / 100):
                    keep[at + i] = keep[at + others] = True
            yield from table.filter(pa.array(keep)).to_batches()

    return run


def _compare(percent: int):
    """Pairs across components within squares of a bucket: rows sorted by (key, row, col, rep) in, (a, b) out.

    The hashed sets rule out all but the links and the few pairs that short
    hashes make look alike.
    """

    def square(group: dict[str, np.ndarray]) -> np.ndarray:
        ids, n, hashes = (group[k] for k in ("rep", "n_shingles", "hashes"))
        out = []
        for i, right in _candidates(group, percent / 100):
            sets = [np.frombuffer(hashes[k], dtype=np.uint32) for k in right]
            own, all_ = np.frombuffer(hashes[i], dtype=np.uint32), np.concatenate(sets)
            met = own[np.minimum(np.searchsorted(own, all_), len(own) - 1)] == all_
            shared = np.add.reduceat(met.astype(np.int64), np.cumsum([0, *map(len, sets[:-1])])) + (n[i] - len(own))  # and those whose short hashes coincide
            right = right[100 * shared >= percent * (n[i] + n[right] - shared)]
            out.append(np.stack([np.minimum(ids[i], ids[right]), np.maximum(ids[i], ids[right])], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, squares in _squares(batches):
            for _, group in squares:
                pairs = square(group)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Iterator[tuple[int, dict[str, np.ndarray]]]]]:
    """(rows, their squares by first row and columns) of rows that come sorted; no square is cut."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        keys = np.stack([np.asarray(rest.column(c)) for c in ("key", "row", "col")], axis=1)
        turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if len(turns):
            whole = rest.slice(0, int(turns[-1]))
            yield whole, _cut(whole, turns[:-1])
            rest = rest.slice(int(turns[-1]))
    if rest is not None and rest.num_rows:
        yield rest, _cut(rest, np.zeros(0, np.int64))


def _cut(table: pa.Table, turns: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    columns = {c: np.asarray(table.column(c)) for c in ("key", "row", "col", "block", "rep", "label", "n_shingles")}
    columns["registers"] = _matrix(table.column("registers").combine_chunks())
    if "hashes" in table.column_names:
        columns["hashes"] = np.array([*table.column("hashes").to_pylist(), None], dtype=object)[:-1]
    bounds = [0, *turns.tolist(), table.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield a, {k: v[a:b] for k, v in columns.items()}


def shingles(text: str, words: int = 2) -> frozenset:
    """The full set of shingles of a text, as tuples of words in bytes."""
    found = split_words((text or "").encode("utf-8", "surrogatepass"))
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(zip(*(found[i:] for i in range(words)), strict=False))


def _confirm(words: int, percent: int):
    """Keeps the pairs (a, b, t_a, t_b) whose full sets reach the similarity; rows come sorted by a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, frozenset] = (None, frozenset())
        for batch in batches:
            keep = []
            for a, t_a, t_b in zip(batch.column("a").to_pylist(), batch.column("t_a"), batch.column("t_b"), strict=True):
                if last[0] != a:
                    last = (a, shingles(t_a.as_py(), words))
                one, two = last[1], shingles(t_b.as_py(), words)
                both = len(one & two)
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents whose sets of `words`-word shingles have 100 * intersection >=
    `percent` * union are linked; component_id is the smallest id reachable.
    A text of fewer words is one shingle; null and empty texts have none and
    are linked with nothing.  Ids are integers, and rows that share one are taken
    for repeated rows with one text; a row with a null id is linked with nothing
    and keeps a null component.  Other columns are not read; an empty table
    gives an empty result.
    """
    prepare(spark)
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = scratch.table(texts.mapInArrow(_sketches(words), _SKETCH.format(id="long")), "sketched")

    # one representative of each distinct set: equal ones have the same words, by a digest of all of them that has no known collision
    sets = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("sha", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"))
    reps = scratch.table(sets, "sets")
    nodes = reps.dropDuplicates(["rep"])

    links = _links(scratch, texts, nodes, words, percent)
    labels = components(scratch, scratch.table(links.distinct(), "links"), "labels").withColumnRenamed("node", "rep")

    named = reps.join(labels, "rep", "left").select("sha", F.coalesce("label", "rep").alias("label"))
    out = sketched.join(named, "sha", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("label")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _band_key(position: Column, four: Column) -> Column:
    return F.shiftleft(position.cast("long"), 32) + F.conv(F.hex(four), 16, 10).cast("long")


def _links(scratch: Scratch, texts: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) with a < b: enough confirmed links for all components between different sets."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: _band_key(i, F.substring(F.col("registers"), i * BAND + 1, F.lit(BAND))))
    keyed = nodes.select("rep", F.explode(bands).alias("key"))
    keyed = scratch.table(keyed, "keyed")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("centre")).where("members > 1")
    met = scratch.table(met, "met")
    members = scratch.table(keyed.join(met, "key"), "members")
    scratch.drop("keyed")

    # first, every member of a bucket against its smallest
    tried = _plausible_pairs(members.where("rep <> centre").select("centre", "rep"), nodes, percent)
    tried = scratch.table(tried, "tried-0")
    links = scratch.table(_confirmed(texts, tried, words, percent), "links-0")

    # then, in buckets that hold several components, against a member that chance picks in each
    several = members.where("members > 2").select("key", "rep", "members")
    mixed = _mixed(scratch, several, components(scratch, links, "labels-0"), "mixed-1")
    chance = F.xxhash64("key", "rep")
    centre = mixed.groupBy("key").agg(F.min(F.struct(chance.alias("by"), "rep", "label")).alias("centre"))
    star = mixed.join(centre, "key").where("label <> centre.label").select("centre.rep", F.col("rep").alias("other"))
    star = _plausible_pairs(star.toDF("centre", "rep"), nodes, percent).join(tried, ["a", "b"], "left_anti")
    star = scratch.table(star, "tried-1")
    links = links.union(scratch.table(_confirmed(texts, star, words, percent), "links-1"))

    # last, in buckets that still do, all pairs across components: by registers, then by the hashed sets of those that these leave a partner
    mixed = _mixed(scratch, mixed.select("key", "rep", "members"), components(scratch, links, "labels-1"), "mixed-2")
    rows = mixed.join(nodes.select("rep", "n_shingles", "registers"), "rep").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "block", "rep", "label", "n_shingles", "registers")
    possible = scratch.table(_dealt(rows).mapInArrow(_possible(percent), rows.schema), "possible")
    if possible.isEmpty():
        return links
    asked = _texts_of(texts, possible.select(F.col("rep").alias("doc_id")).distinct()).select(F.col("doc_id").alias("rep"), "text")
    sets = asked.mapInArrow(_hash_sets(words), "rep long, hashes binary")
    across = _dealt(possible.join(sets, "rep")).mapInArrow(_compare(percent), "a long, b long").distinct().join(tried.union(star), ["a", "b"], "left_anti")
    across = scratch.table(across, "tried-2")
    if across.isEmpty():
        return links
    return links.union(scratch.table(_confirmed(texts, across, words, percent), "links-2"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by squares, whole ones to a task."""
    return rows.repartition("key", "row", "col").sortWithinPartitions("key", "row", "col", "rep")


def _mixed(scratch: Scratch, members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """(key, rep, members, label): the members of buckets that hold several components."""
    labelled = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = scratch.table(labelled, f"{name}-labelled")
    keys = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    return scratch.table(labelled.join(keys, "key"), name)


def _plausible_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b: the distinct pairs (centre, rep) that may reach the similarity."""
    pairs = pairs.select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()
    left = nodes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
    right = nodes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(_screen(percent / 100), "a long, b long")


def _confirmed(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity.

    The text of b travels to a, whose text is there once.
    """
    asked = _texts_of(texts, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    right = pairs.join(asked.select(F.col("doc_id").alias("b"), F.col("text").alias("t_b")), "b")
    both = right.join(asked.select(F.col("doc_id").alias("a"), F.col("text").alias("t_a")), "a")
    return both.select("a", "b", "t_a", "t_b").mapInArrow(_confirm(words, percent), "a long, b long")


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of (at least) these documents, once each; only those that pass a bit filter go through a shuffle."""
    bits, word = filter_bits(ids.count()), F.xxhash64("doc_id")
    return passing(texts, word, bits, bit_filter(ids, word, bits)).dropDuplicates(["doc_id"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each group the smallest id.

    Rows with a null id, and null and empty texts, stay; rows that share the id
    that stays all stay.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "near-gone")
    found = near_duplicates(spark, docs, id_col, text_col, words, percent)
    gone = scratch.table(found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("quern_gone")).distinct(), "gone")
    maybe, stays = parted(docs, F.xxhash64(F.col(id_col).cast("long")), gone, F.xxhash64("quern_gone"))
    return stays.unionByName(maybe.join(gone, maybe[id_col].cast("long") == gone["quern_gone"], "left_anti"))
