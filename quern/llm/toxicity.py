"""Toxicity scores after noisy-channel deobfuscation.

What a text shows may be a disguise of what was meant: letters written as
digits or signs, set apart by blanks or dots, or repeated.  Each suspicious
token spans a lattice of the letters that it may stand for, and a Viterbi
search under a character language model of the corpus finds the likeliest
reading.  The restored words are scored by a lexicon learned from labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import prepare, texts
from quern.llm.linear import Logistic

# Labelled rows that lexicon and score are fitted on at most, the first by the hash of their ids.
MAX_LABELLED = 40_000
# A word enters the lexicon with so many toxic rows and so large a G statistic at least.
LEAST_ROWS, LEAST_G = 3, 12.0

# The letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "€": "e", "£": "l",
}
# Costs in the channel, as negative logarithms: a sign read as a letter, a sign left out, one that looks like a letter
# left out, a run of a letter read as two and not as one.
SIGN_COST, STOP_COST, DROP_COST, RUN_COST = 1.0, 0.1, 9.0, 0.7

_LETTERS = 28  # a to z, any other letter, a word's edge
_EDGE, _OTHER = 0, 27
_CODES = {chr(97 + i): i + 1 for i in range(26)}
_APART = re.compile(r"(?<!\S)\S(?:[ \t.\-_]{1,3}\S){2,}(?![^\s.,;:!?])")
_GAP = re.compile(r"[ \t.\-_]{1,3}")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_SIGN = re.compile("[" + re.escape("".join(LOOKALIKES)) + ".\\-_~^#%&]")
_LOOKALIKE = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
_ENDS = ".,;:?'\"`)]}>([{<!-_~^#%&*$@|+/\\=…«»“”’"


def _code(letter: str) -> int:
    return _CODES.get(letter, _OTHER)


_TABLE = np.full(0x110000, _EDGE, dtype=np.int64)


def _letter_table() -> np.ndarray:
    if not _TABLE.any():
        for c in range(0x110000):
            if chr(c).isalpha():
                _TABLE[c] = _code(chr(c).lower())
    return _TABLE


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, n): how often each three letters follow each other in a task's texts."""
    table, total = _letter_table(), np.zeros(_LETTERS**3, dtype=np.int64)
    for batch in batches:
        for text in texts(batch):
            codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            codes = np.concatenate([[_EDGE, _EDGE], codes, [_EDGE]])
            total += np.bincount(codes[:-2] * _LETTERS**2 + codes[1:-1] * _LETTERS + codes[2:], minlength=_LETTERS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of three letters over all texts: a table of 28 x 28 x 28, whatever the size of the corpus."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_letters, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found, out = rows.toPandas(), np.zeros(_LETTERS**3)
    out[found["at"].to_numpy(dtype=np.int64)] = found["n"]
    return out.reshape(_LETTERS, _LETTERS, _LETTERS)


class LetterModel:
    """log p(letter | two before), with less context mixed in."""

    def __init__(self, counts: np.ndarray):
        counts = counts.copy()
        counts[_EDGE, _EDGE, _EDGE] = 0  # gaps
        two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
        p1 = (one + 1) / (one + 1).sum()
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (counts + 5 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()

    def restore(self, token: str) -> str:
        """The likeliest reading of a token: letters only, the best path through its lattice."""
        return self._path(self._lattice(token))

    def restore_apart(self, chunks: list[str]) -> list[str]:
        """The likeliest words of characters that stand apart: each gap is dropped, or is a word's edge."""
        lattice = self._lattice(chunks[0])
        for chunk in chunks[1:]:
            lattice += [[("", STOP_COST), (" ", 0.0)], *self._lattice(chunk)]
        return self._path(lattice).split()

    def _lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each sign or run of one sign, the letters that it may stand for, with their costs."""
        lattice: list[list[tuple[str, float]]] = []
        at = 0
        while at < len(token):
            c = token[at]
            run = 1
            while at + run < len(token) and token[at + run] == c:
                run += 1
            read = [(c, 0.0)] if c.isalpha() else [(x, SIGN_COST) for x in LOOKALIKES.get(c, "")]
            if run >= 3:
                steps = [(x, cost) for x, cost in read] + [(x + x, cost + RUN_COST) for x, cost in read]
            else:
                steps = [(x * run, cost * run) for x, cost in read]
            if not c.isalpha():
                steps.append(("", DROP_COST if c in LOOKALIKES else STOP_COST))
            lattice.append(steps)
            at += run
        return lattice

    def _path(self, lattice: list[list[tuple[str, float]]]) -> str:
        best: dict[tuple[int, int], tuple[float, str]] = {(_EDGE, _EDGE): (0.0, "")}
        for steps in lattice:
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (sum_, word) in best.items():
                for letters, cost in steps:
                    x, y, s = a, b, sum_ - cost
                    for letter in letters:
                        z = _EDGE if letter == " " else _code(letter)
                        s += self.log[x][y][z]
                        x, y = (y, z) if z else (_EDGE, _EDGE)
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, word + letters)
            best = after
        return max(((s + self.log[a][b][_EDGE] if word else s - 30.0, word) for (a, b), (s, word) in best.items()))[1]

    def readable(self, word: str) -> bool:
        """Whether the letters follow each other as in words: likelier than letters by chance."""
        a = b = _EDGE
        total = 0.0
        for z in [*map(_code, word), _EDGE]:
            total += self.log[a][b][z]
            a, b = b, z
        return bool(word) and total > -(len(word) + 1) * np.log(_LETTERS)


class _Words(dict):
    """Words meant by a token; looked up once and forgotten when there are too many."""

    def __init__(self, model: LetterModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[str, ...]:
        plain = token.strip(_ENDS)
        if plain.isalpha() and not _RUN.search(plain) and (len(plain) == len(token) or not _LOOKALIKE.search(token)):
            out: tuple[str, ...] = (plain,)  # nothing of it may be a disguise
        else:
            out = self._suspicious(token, plain)
        if len(token) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[token] = out
        return out

    def _suspicious(self, token: str, plain: str) -> tuple[str, ...]:
        words = {plain}
        letters = any(map(str.isalpha, token))
        if letters and (_RUN.search(token) or _SIGN.search(plain) or (token != plain and _LOOKALIKE.search(token))):
            words.update(map(self.model.restore, {token, plain}))
            words.update(w for w in re.split(r"[^\w]+", plain) if len(w) > 1)
        elif not letters and len(_LOOKALIKE.findall(token)) > 1:
            words.update(filter(self.model.readable, map(self.model.restore, {token, plain})))
        return tuple(sorted(w for w in words if w))


class Reader:
    """The distinct words that a text may mean."""

    def __init__(self, model: LetterModel):
        self.model, self.words = model, _Words(model)

    def read(self, text: str) -> set[str]:
        low = text.lower()
        out = set(chain.from_iterable(map(self.words.__getitem__, set(low.split()))))
        for match in _APART.finditer(low):
            chunks = [c for c in _GAP.split(match[0]) if c]
            out.update([self.model.restore("".join(chunks)), *self.model.restore_apart(chunks)] if chunks else [])
        return out


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            read = [sorted(reader.read(t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(read, pa.list_(pa.string()))], ["label", "words"])

    return run


def _meant(sample: DataFrame, letters) -> DataFrame:
    """(label, words) of the rows of a sample."""
    return sample.select("label", "text").mapInArrow(_read(letters), "label int, words array<string>")


def _lexicon(sample: DataFrame, letters) -> dict[str, float]:
    """Log-odds of words that tell toxic rows from others, from the rows of fold 0, which are read once."""
    fold = sample.where("fold = 0")
    n = fold.groupBy("label").count().toPandas().set_index("label")["count"]
    toxic, clean = float(n.get(1, 0)), float(n.get(0, 0))
    if not toxic or not clean:
        return {}
    words = _meant(fold, letters).select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("k"), F.count(F.lit(1)).alias("m")).where(F.col("k") >= LEAST_ROWS)
    expect = F.col("m") * (toxic / (toxic + clean))
    other, other_expect = F.col("m") - F.col("k"), F.col("m") - expect
    g = 2 * (F.col("k") * F.log(F.col("k") / expect) + F.when(other > 0, other * F.log(other / other_expect)).otherwise(0.0))
    odds = F.log((F.col("k") + 0.5) / (toxic + 1)) - F.log((other + 0.5) / (clean + 1))
    best = words.select("word", odds.alias("odds"), g.alias("g")).where((F.col("g") >= LEAST_G) & (F.col("odds") > 0))
    return dict(best.select("word", "odds").toPandas().itertuples(index=False))  # of a sample of MAX_LABELLED rows


def features(odds: list[float], n_words: int) -> list[float]:
    top = sorted(odds, reverse=True)[:3]
    return [top[0] if top else -1.0, sum(top), float(min(5, len(odds))), float(sum(1 for x in odds if x > 2.0) > 0), float(np.log1p(n_words))]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon, weights = shared.value
        reader = Reader(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for text in texts(batch):
                words = reader.read(text)
                rows.append(features([lexicon[w] for w in words if w in lexicon], len(words)))
            p = weights.predict(np.asarray(rows)) if weights is not None else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    return run


def score(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score (0 to 1, higher: likelier toxic).

    The letter model counts over all texts.  `labels` has doc_id and the label;
    rows with `held_out` (a column over doc_id) aren't learned from.  Half of
    the labelled sample makes the lexicon, the other half the score, so that
    the score knows how the lexicon does on texts it hasn't seen.  A null text
    is empty; an empty text gets the score of a text without any word of the
    lexicon; a null held_out counts as held out; without labels of both kinds
    everything scores 0.  Repeated rows get equal results; other columns are
    not read; an empty table gives an empty result.
    """
    prepare(spark)
    held_out = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(True))
    model = LetterModel(letter_counts(docs, text_col))
    letters = spark.sparkContext.broadcast(model)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(2)).cast("int"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = rows.join(F.broadcast(known), "doc_id").drop("doc_id")  # at most MAX_LABELLED ids
    lexicon = _lexicon(sample, letters)
    weights = _fit(sample, letters, lexicon, spark) if lexicon else None
    shared = spark.sparkContext.broadcast((model, lexicon, weights))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.withColumn("held_out", held_out).mapInArrow(_score(shared), f"doc_id {id_type}, held_out boolean, score double")


def _fit(sample: DataFrame, letters, lexicon: dict[str, float], spark: SparkSession) -> Logistic | None:
    """The score of the lexicon's findings, from the rows of fold 1, which are read once."""
    shared = spark.sparkContext.broadcast(lexicon)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features([shared.value[w] for w in words if w in shared.value], len(words)) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

    found = _meant(sample.where("fold = 1"), letters).mapInArrow(look, "label int, x array<double>").toPandas()
    label = found["label"].to_numpy()
    if len({*label.tolist()}) < 2:
        return None
    return Logistic().fit(np.asarray(found["x"].tolist()), label.astype(float))
