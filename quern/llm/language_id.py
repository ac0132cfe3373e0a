"""Language identification by rank-order n-gram profiles.

A language's profile lists its most frequent n-grams of one to three letters,
counted over all its training texts.  A document's own most frequent n-grams
are compared with each profile by the out-of-place distance: how far each
n-gram stands from its rank in the profile, the most for one that is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import prepare, texts

PROFILE = 400  # n-grams of a profile and of a document
UNKNOWN = "und"
# Characters counted at once, and distinct n-grams of a language that a task holds before it hands them on.
_CHUNK, _HELD = 1 << 20, 1 << 18

_BITS = np.int64(21)  # of a code point


def _is_letter() -> np.ndarray:
    """For each code point, its lower case if it is a letter and 0 if not."""
    table = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low[0])
    return table


class Grams:
    """n-grams of texts as integers: code points of letters in 21 bits each, 0 for a word's edge.

    Pairs have the highest value bit set and triples are negative, so that the orders don't mix.
    """

    def __init__(self) -> None:
        self.letters = _is_letter()

    def of(self, text: str) -> Iterator[np.ndarray]:
        """All n-grams of the text, in blocks that end between words, or in a word longer than a block."""
        at = 0
        while at < len(text) or not at:
            end = at + _CHUNK
            while at < end < len(text) and text[end].isalpha():
                end -= 1
            end = end if end > at else at + _CHUNK
            yield self._grams(self.codes(text[at:end]))
            at = end

    def codes(self, text: str) -> np.ndarray:
        """Letters as code points in lower case, with one 0 before, between and after words."""
        letters = self.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        letters = np.concatenate([[0], letters, [0]])
        gap = letters == 0
        return letters[~(gap & np.concatenate([[False], gap[:-1]]))]

    @staticmethod
    def _grams(codes: np.ndarray) -> np.ndarray:
        two = (codes[:-1] << _BITS) | codes[1:]
        three = (codes[:-2] << 2 * _BITS) | (codes[1:-1] << _BITS) | codes[2:]
        return np.concatenate([codes[codes > 0], two[two > 0] | (np.int64(1) << np.int64(62)), ~three[codes[1:-1] > 0]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): counts of a task's rows, handed on whenever a language holds many n-grams."""
    grams = Grams()
    waiting: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def settle(lang: str) -> None:
        found, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        size[lang] = 0
        if lang in held:
            old, m = held[lang]
            merged, at = np.unique(np.concatenate([old, found]), return_inverse=True)
            found, n = merged, np.bincount(at, weights=np.concatenate([m, n])).astype(np.int64)
        held[lang] = (found, n.astype(np.int64))

    def hand_on(lang: str) -> pa.RecordBatch:
        found, n = held.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            for block in grams.of(text):
                waiting.setdefault(lang, []).append(block)
                size[lang] = size.get(lang, 0) + len(block)
                if size[lang] > 4 * _CHUNK:
                    settle(lang)
                    if len(held[lang][0]) > _HELD:
                        yield hand_on(lang)
    for lang in list(waiting):
        settle(lang)
    for lang in list(held):
        yield hand_on(lang)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language: its most frequent n-grams in order, ties by n-gram.

    Rows with a null language are left out.  Counts cover all rows; only the
    profiles, `size` n-grams a language, come to the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).where(F.col("place") <= size).toPandas()
    return {lang: part.sort_values("place")["gram"].to_numpy() for lang, part in best.groupby("lang")}


class Profiles:
    """Language profiles and the out-of-place distance to them; they take some 12 bytes an n-gram of each."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        grams = np.concatenate([np.zeros(0, np.int64), *(profiles[n] for n in self.names)])
        order = np.argsort(grams, kind="stable")
        sizes = [len(profiles[n]) for n in self.names]
        # the n-grams of all profiles in order, and for each its languages and ranks from `first` on
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams)).astype(np.int64)
        self.lang = np.repeat(np.arange(len(sizes)), sizes)[order].astype(np.int32)
        self.rank = np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])[order].astype(np.int32)

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        """(language, score) of a document's n-grams; the score is 1 less the distance's share of the greatest."""
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        found, n = np.unique(grams, return_counts=True)
        top = np.lexsort((found, -n))[: self.size] if len(found) <= self.size else _first(found, n, self.size)
        own = found[top]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == own)
        low, n = self.first[at[place]], self.first[at[place] + 1] - self.first[at[place]]
        entry = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        nearer = self.size - np.abs(self.rank[entry] - np.repeat(place, n))  # than an n-gram that is missing
        away = self.size * len(own) - np.bincount(self.lang[entry], weights=nearer, minlength=len(self.names))
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def _first(found: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent, ties by n-gram, without sorting the rest."""
    least = np.partition(n, len(n) - size)[len(n) - size]
    some = np.flatnonzero(n >= least)
    return some[np.lexsort((found[some], -n[some]))[:size]]


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, grams = shared.value, Grams()
        for batch in batches:
            found = [profiles.predict(_all_grams(grams, text)) for text in texts(batch)]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _all_grams(grams: Grams, text: str) -> np.ndarray:
    blocks = list(grams.of(text))
    return np.concatenate(blocks) if len(blocks) > 1 else blocks[0]


def identify(
    spark: SparkSession,
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, lang_pred, score.

    Profiles are learned from the rows for which `training` holds and the
    language is known; predictions see the text alone.  A text that is null,
    empty or without letters is `und` with score 0, as is everything if there
    is nothing to learn from.  Of languages at one distance the first by name
    is taken.  A null `training` counts as held out.  Repeated rows get equal
    results; other columns are not read; an empty table gives an empty result.
    """
    prepare(spark)
    train_on = F.coalesce(training, F.lit(False))
    shared = spark.sparkContext.broadcast(Profiles(train(docs.where(train_on), lang_col, text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (~train_on).alias("held_out"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
