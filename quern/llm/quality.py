"""A quality classifier by co-training of two views of a document.

One view sees the text, the other the metadata.  Each starts from the labelled
rows, then over several rounds labels all unlabelled rows of which it is certain
for the other.  Both are calibrated on labelled rows that neither has seen, and
the calibrated views are combined into one score.

Unlabelled rows stay on the executors, however many: their features are written
once, each Newton step is a pass that brings back sums, and which rows a view
has labelled follows from the models of the rounds before.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, prepare, texts
from quern.llm.linear import Logistic, sigmoid

# Labelled rows that the classifier is fitted on at most, chosen by the hash of their ids; unlabelled rows all count.
MAX_LABELLED = 20_000
ROUNDS, CONFIDENT = 4, 0.97
LEAST_STEP = 1e-4  # of a weight, in a Newton step over all rows
CATEGORIES, NUMBERS = ("source", "lang"), ("n_chars",)
_BUCKETS = 64  # that the values of a category are hashed into

# Classes of bytes: small, capital, digit, space, line end, sentence mark, other mark, beyond ASCII.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[0x80:] = 7
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:?'\"-")):
    _CLASS[list(_chars)] = _k
_STEP = 1 << 22  # bytes that are looked at at once


def text_features(text: str) -> np.ndarray:
    """Shares of byte classes and of their transitions, repetition of words, lengths."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    moves, last = np.zeros(64), None
    for at in range(0, len(raw), _STEP):
        part = _CLASS[raw[at : at + _STEP]]
        if last is not None:
            moves[last * 8 + part[0]] += 1
        moves += np.bincount(part[:-1] * 8 + part[1:], minlength=64)
        last = part[-1]
    words = text.split()
    n, m = max(1, len(raw)), max(1, len(words))
    shares = moves.reshape(8, 8).sum(axis=1) / n
    more = [np.log1p(n), np.log1p(m), n / m / 10, len(set(words)) / m, len(set(words)) / m**0.75]
    return np.concatenate([np.sqrt(moves / n), shares, more]).astype(np.float32)


def metadata_features(categories: list[object], numbers: list[object]) -> np.ndarray:
    """Hashed categories; for each number its logarithm, its size class and whether it is missing."""
    out = []
    for value in categories:
        one = np.zeros(_BUCKETS, dtype=np.float32)
        one[zlib.crc32(repr(value).encode()) % _BUCKETS] = 1
        out.append(one)
    for value in numbers:
        size = np.zeros(18, dtype=np.float32)
        if value is None:
            size[0] = 1
        else:
            size[1] = np.log1p(abs(float(value)))
            size[2 + min(15, int(size[1]))] = 1
        out.append(size)
    return np.concatenate(out) if out else np.zeros(1, np.float32)


def _views(batch: pa.RecordBatch, categories: int, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    columns = [batch.column(f"c{i}").to_pylist() for i in range(categories)] + [batch.column(f"v{i}").to_pylist() for i in range(numbers)]
    meta = [metadata_features(list(row[:categories]), list(row[categories:])) for row in (zip(*columns, strict=True) if columns else [()] * batch.num_rows)]
    return np.stack([text_features(t) for t in texts(batch)]), np.stack(meta)


def _features(categories: int, numbers: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta = _views(batch, categories, numbers)
                packed = [pa.array([r.tobytes() for r in view], pa.binary()) for view in (text, meta)]
                yield pa.RecordBatch.from_arrays([batch.column(key), *packed], [key, "text_view", "meta_view"])

    return run


def _unpacked(column: pa.Array) -> np.ndarray:
    """The features in a column, one row each: a view of the column's bytes, since all rows have one width."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]].view(np.float32).reshape(len(column), -1)


Views = tuple[np.ndarray, np.ndarray]
# What a pass over the rows dealt to a view sums up: moments round a centre, a model's slope and curvature, or nothing.
Ask = np.ndarray | Logistic | None
# (models of each round, what to sum for each view) -> the sums over all unlabelled rows
Pool = Callable[[list[list[Logistic]], list[Ask]], list[np.ndarray]]


def _dealt(views: Views, past: list[list[Logistic]]) -> list[np.ndarray]:
    """For each view the labels that the other has given unlabelled rows, -1 for none; a row is dealt in one round only."""
    given, waiting = [np.full(len(views[0]), -1.0) for _ in views], np.ones(len(views[0]), dtype=bool)
    for models in past:
        p = [m.predict(v) for m, v in zip(models, views, strict=True)]
        sure = [np.where(q >= CONFIDENT, 1.0, np.where(q <= 1 - CONFIDENT, 0.0, -1.0)) for q in p]
        for k in (0, 1):
            given[1 - k] = np.where(waiting & (sure[k] >= 0), sure[k], given[1 - k])
        waiting &= (sure[0] < 0) & (sure[1] < 0)
    return given


def _asked(x: np.ndarray, y: np.ndarray, ask: Ask) -> np.ndarray:
    if ask is None:
        return np.zeros(0)
    if isinstance(ask, Logistic):
        return ask.sums(x, y)
    z = x - ask
    return np.concatenate([[len(x)], z.sum(axis=0), (z * z).sum(axis=0)])


def _sum_free(views: Views, past: list[list[Logistic]], asks: list[Ask]) -> list[np.ndarray]:
    return [_asked(v[g >= 0], g[g >= 0], ask) for v, g, ask in zip(views, _dealt(views, past), asks, strict=True)]


def _pool(free: DataFrame) -> Pool:
    """Sums over a table of features, made on the executors; a few rows of fixed size come back."""

    def ask_all(past: list[list[Logistic]], asks: list[Ask]) -> list[np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray] = []
            for batch in batches:
                if batch.num_rows:
                    found = _sum_free((_unpacked(batch.column("text_view")), _unpacked(batch.column("meta_view"))), past, asks)
                    total = [a + b for a, b in zip(total, found, strict=True)] if total else found
            yield packed(total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield packed(added(r for batch in batches for r in batch.to_pylist()))

        def packed(total: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()] if total else [], pa.binary()) for x in total or [np.zeros(0)] * 2], ["text_sums", "meta_sums"])

        def added(rows) -> list[np.ndarray]:
            total: list[np.ndarray] = []
            for row in rows:
                found = [np.frombuffer(row[c]) for c in ("text_sums", "meta_sums")]
                total = [a + b for a, b in zip(total, found, strict=True)] if total else found
            return total

        form = "text_sums binary, meta_sums binary"
        sums = added(free.mapInArrow(part, form).repartition(4).mapInArrow(add, form).collect())
        return sums or [np.zeros(1)] * 2  # no rows at all

    return ask_all


def _refitted(own: list[np.ndarray], y: np.ndarray, past: list[list[Logistic]], pool: Pool, centres: list[np.ndarray], found: list[np.ndarray]) -> list[Logistic]:
    """Both models on the labelled rows and on all that has been dealt to them; `found` has the moments of the latter."""
    models = []
    for x, centre, moments in zip(own, centres, found, strict=True):
        n, first, second = np.split(moments + _asked(x, y, centre), [1, 1 + len(centre)])
        models.append(Logistic().start(centre + first / n, np.sqrt(np.maximum(second / n - (first / n) ** 2, 0))))
    asks: list[Ask] = list(models)
    for _ in range(models[0].steps):
        sums = pool(past, asks)
        for k in (0, 1):
            if asks[k] is not None and models[k].step(sums[k] + _asked(own[k], y, models[k])) < LEAST_STEP:
                asks[k] = None
        if asks == [None, None]:
            break
    return models


class CoTrained:
    """Two views and their combination, fitted on labelled and unlabelled rows."""

    def fit(self, text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, pool: Pool | None = None) -> CoTrained:
        """`label` is 0, 1 or -1 for unlabelled; labelled rows are dealt to training and calibration in turn.

        `pool` sums over unlabelled rows that are elsewhere; without it they are those of label -1.
        """
        known = np.flatnonzero(label >= 0)
        held = known[3::4] if len(known) >= 40 else known  # for calibration
        own = np.setdiff1d(known, held) if len(known) >= 40 else known
        views, y = (text, meta), label[own].astype(float)
        if pool is None:
            rest = (text[label < 0], meta[label < 0])
            pool = lambda past, asks: _sum_free(rest, past, asks)
        self.models = [Logistic().fit(v[own], y) for v in views]
        self.dealt, past = [0, 0], []
        for _ in range(rounds):
            past.append(self.models)
            centres = [v[own].mean(axis=0) for v in views]
            found = pool(past, centres)
            dealt = [int(s[0]) for s in found]
            if dealt == self.dealt:
                break
            self.dealt = dealt
            self.models = _refitted([v[own] for v in views], y, past, pool, centres, found)
        views_held = [v[held] for v in views]
        raw = [m.decision(v)[:, None] for m, v in zip(self.models, views_held, strict=True)]
        self.scales = [Logistic().fit(x, label[held].astype(float)) for x in raw]
        both = np.column_stack([s.decision(x) for s, x in zip(self.scales, raw, strict=True)])
        self.join = Logistic().fit(both, label[held].astype(float))
        return self

    def predict(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, calibrated text view, calibrated metadata view)."""
        views = [s.decision(m.decision(v)[:, None]) for s, m, v in zip(self.scales, self.models, (text, meta), strict=True)]
        return self.join.predict(np.column_stack(views)), sigmoid(views[0]), sigmoid(views[1])


class Constant:
    """What stands in for the classifier where no label, or only one value, is known."""

    def __init__(self, value: float):
        self.value = value

    def predict(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        all_ = np.full(len(text), self.value)
        return all_, all_, all_


def _predict(shared, categories: int, numbers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = shared.value.predict(*_views(part, categories, numbers))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *map(pa.array, found)], ["doc_id", "text_key", "score", "text_score", "metadata_score"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, categories: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    meta = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categories)] + [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(numbers)]
    key = F.xxhash64(*[F.col(c).cast("string") for c in (text_col, *categories, *numbers)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("text_key"), *meta)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: tuple[str, ...], numbers: tuple[str, ...], training: Column, label_col: str = "quality") -> CoTrained | Constant:
    """Fit on all unlabelled rows and at most MAX_LABELLED labelled ones, the first by the hash of their ids.

    The labelled sample is broadcast and comes to the driver; features of
    unlabelled rows go to a scratch table.  An id with several labels counts
    with the largest; rows with a null id are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & training).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    all_ = _rows(docs, id_col, text_col, categories, numbers).drop("text_key")
    rows = all_.join(F.broadcast(known), "doc_id").drop("doc_id")
    found = rows.mapInArrow(_features(len(categories), len(numbers), "label"), "label int, text_view binary, meta_view binary").toArrow()
    label = found.column("label").to_numpy()
    if len({*label.tolist()}) < 2:
        return Constant(float(label.max()) if len(label) else 1.0)
    views = [_unpacked(found.column(c).combine_chunks()) for c in ("text_view", "meta_view")]  # of 32 bits, some 900 bytes a row
    order = np.lexsort((views[0][:, 0], [zlib.crc32(r) for r in views[0]]))  # whatever order the rows arrived in
    views = [view[order] for view in views]
    del found
    id_type = all_.schema["doc_id"].dataType.simpleString()
    free = all_.where(F.col("doc_id").isNotNull() & training).mapInArrow(_features(len(categories), len(numbers), "doc_id"), f"doc_id {id_type}, text_view binary, meta_view binary")
    scratch = Scratch(docs.sparkSession, "quality")
    free = scratch.table(free.join(labels.select("doc_id"), "doc_id", "left_anti").drop("doc_id"), "free")
    model = CoTrained().fit(*views, label[order], pool=_pool(free))
    scratch.close()
    return model


def score(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = CATEGORIES,
    numbers: tuple[str, ...] = NUMBERS,
    training: Column | None = None,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_key, score, text_score, metadata_score (each 0 to 1).

    `labels` has doc_id and quality (1 good, 0 bad); `training` says of which
    doc_id labels may be learned from, all by default.  A null text is empty;
    a null in metadata is a value of its own; without labels everything scores
    1, with labels of one kind everything scores that.  `text_key` tells apart
    rows that share an id.  Other columns are not read; an empty table gives an
    empty result.
    """
    prepare(spark)
    training = F.lit(True) if training is None else training
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, categories, numbers, training))
    rows = _rows(docs, id_col, text_col, categories, numbers)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared, len(categories), len(numbers)), f"doc_id {id_type}, text_key long, score double, text_score double, metadata_score double")


def _keep(shared, columns: list[str], text: int, categories: list[int], numbers: list[int], threshold: float):
    """Filters whole rows by their score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen = [part.column(text), *(part.column(i).cast(pa.string()) for i in categories), *(part.column(i).cast(pa.float64()) for i in numbers)]
                names = ["text", *(f"c{i}" for i in range(len(categories))), *(f"v{i}" for i in range(len(numbers)))]
                found = shared.value.predict(*_views(pa.RecordBatch.from_arrays(seen, names), len(categories), len(numbers)))[0]
                yield part.filter(pa.array(found >= threshold))

    return run


def keep_good(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = CATEGORIES,
    numbers: tuple[str, ...] = NUMBERS,
) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns, in one pass without a shuffle.

    Null and empty texts, nulls in metadata and null ids are scored like any
    other row, repeated rows alike; without labels every row stays.  An empty
    table gives an empty result.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, categories, numbers, F.lit(True)))
    at = docs.columns.index
    return docs.mapInArrow(_keep(shared, docs.columns, at(text_col), [at(c) for c in categories], [at(c) for c in numbers], threshold), docs.schema)
