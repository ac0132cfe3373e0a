"""Secret scans: candidate strings, and a random forest that removes false findings.

A scanner cuts candidates: quoted values and values after an assignment,
passwords in addresses, and long runs of the characters that keys are made of.
The forest sees their length, how their characters follow each other, how much
of them a dictionary covers, the path, the words beside them and how they
begin.  What words and beginnings mean is learned from labelled findings;
dictionary and letter transitions are counted over the whole corpus.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import prepare, texts
from quern.llm.findings import labelled_lines
from quern.llm.forest import Forest
from quern.llm.toxicity import LetterModel, letter_counts

_ADDRESS = re.compile(r"""://[^\s/:@"']{1,64}:([^\s/@"']{4,})@""")  # user:password@host
_VALUE = re.compile(
    r"""[=:]\s?(["'])(?P<quoted>[^\s"']{6,})\1"""  # = "value"
    r"""|=(?P<assigned>[^\s"'&;,<>()=]{8,}={0,2})(?![^\s"'&;,)])"""  # =value
)
_RUN = re.compile(r"""[A-Za-z0-9_+/.\-]{12,}(?:={1,2}(?![A-Za-z0-9_+/=]|["'][^\s"',;)}\]]))?""")  # of signs that keys are made of, perhaps padded
_LONG = 16  # a shorter run needs a digit
BESIDE = 40  # characters on either side that are looked at
# A word is in the dictionary if it makes up so large a share of all words of 3 to 8 letters: at most 100,000 do.
DICTIONARY_SHARE = 1e-5
# Labelled findings that the forest is fitted on at most.
MAX_FINDINGS = 20_000
_HELD = 300_000


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate, in order; they don't overlap."""
    found = [m.span(1) for m in _ADDRESS.finditer(text)]
    found = sorted(found + _beside(found, [m.span(m.lastgroup) for m in _VALUE.finditer(text)]))
    runs = []
    for match in _RUN.finditer(text):
        start, end = match.start(), match.start() + len(match[0].rstrip(".-/"))
        if end - start >= _LONG or (end - start >= 12 and not text[start:end].isalpha() and any(c.isdigit() for c in text[start:end])):
            runs.append((start, end))
    return sorted(found + _beside(found, runs)) if found else runs


def _beside(taken: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of the taken ones, which are in order."""
    ends = [end for _, end in taken]
    return [s for s in spans if (k := bisect_right(ends, s[0])) == len(taken) or taken[k][0] >= s[1]]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def hand_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in texts(batch):
            counts.update(w for w in text.lower().split() if 3 <= len(w) <= 8 and w.isalpha())
            if len(counts) > _HELD:
                yield hand_on()
    yield hand_on()


def dictionary(docs: DataFrame, text_col: str = "text", share: float = DICTIONARY_SHARE) -> frozenset[str]:
    """The words of 3 to 8 letters that make up a share of all of them, counted over all texts."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return frozenset(r["word"] for r in counts.join(F.broadcast(total)).where(F.col("n") >= F.col("total") * share).select("word").collect())


_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _parts(text: str) -> list[str]:
    """The words of a name, a path or a line, in lower case."""
    return [p.lower() for p in _PART.findall(text)]


class Cues:
    """Log-odds of words before and after a candidate, in its path and of how it begins, from labelled findings."""

    def __init__(self, rows: Iterable[tuple[str, str, str, str, int]]):
        counts: dict[tuple[str, str], list[int]] = {}
        total = [0, 0]
        for text, before, after, path, label in rows:
            total[label] += 1
            for cue in set(self.of(text, before, after, path)):
                counts.setdefault(cue, [0, 0])[label] += 1
        self.odds = {cue: math.log((k + 0.5) / (total[1] + 1)) - math.log((n + 0.5) / (total[0] + 1)) for cue, (n, k) in counts.items() if n + k >= 3}

    @staticmethod
    def of(text: str, before: str, after: str, path: str) -> Iterator[tuple[str, str]]:
        words = _parts(before)
        yield from (("before", w) for w in words[-6:-1])
        yield ("next", words[-1] if words else "")
        yield from (("after", w) for w in _parts(after)[:2])
        yield from (("path", w) for w in _parts(path))
        yield ("head", text[:4])
        yield ("sign", before.rstrip("\"'")[-2:])

    def features(self, text: str, before: str, after: str, path: str) -> list[float]:
        found: dict[str, list[float]] = {}
        for kind, cue in self.of(text, before, after, path):
            found.setdefault(kind, []).append(self.odds.get((kind, cue), 0.0))
        beside = [*found.get("before", [0.0]), *found["next"]]
        return [max(beside), min(beside), sum(beside), found["next"][0], sum(found.get("after", [])), sum(found.get("path", [])), found["head"][0], found["sign"][0]]


class Judge:
    """Features of a candidate, given the corpus's dictionary and letters, and what labelled findings tell."""

    def __init__(self, words: frozenset[str], letters: LetterModel, cues: Cues):
        self.words, self.letters, self.cues = words, letters, cues

    def covered(self, low: str) -> int:
        """Letters of the longest dictionary words, taken from the left."""
        at = total = 0
        while at < len(low) - 2:
            for size in range(min(8, len(low) - at), 2, -1):
                if low[at : at + size] in self.words:
                    at, total = at + size, total + size
                    break
            else:
                at += 1
        return total

    def features(self, text: str, before: str, after: str, path: str) -> list[float]:
        n, low = len(text), text.lower()
        kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in text]
        letters = sum(k < 2 for k in kinds)
        entropy = -sum(k / n * math.log2(k / n) for k in Counter(text).values())
        codes = bytes(ord(c) - 96 if "a" <= c <= "z" else 0 for c in low)
        steps, total = 0, 0.0
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            if c:
                steps, total = steps + 1, total + self.letters.log[a][b][c]
        return [
            math.log(n),
            entropy,
            entropy / math.log2(n) if n > 1 else 0.0,
            kinds.count(2) / n,
            kinds.count(1) / n,
            kinds.count(3) / n,
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
            total / steps if steps else -4.0,
            self.covered(low) / max(1, letters),
            float(all(c in "0123456789abcdef-" for c in low)),
            float(text.count(".") + text.count("/") + text.count("-") + text.count("_")),
            *self.cues.features(text, before, after, path),
        ]


Finding = tuple[str, str, str, str, int]  # text, before, after, path, label


def sample_findings() -> list[Finding]:
    """The candidates that the scanner cuts from the labelled lines: 1 for those that are the marked secret, else 0.

    A candidate that only overlaps a secret is left out.
    """
    out = []
    for line in labelled_lines():
        for start, end in candidates(line.text):
            exact = (start, end) == (line.start, line.end)
            if line.label and not exact and start < line.end and line.start < end:
                continue
            out.append((line.text[start:end], line.text[max(0, start - BESIDE) : start], line.text[end : end + BESIDE], line.path, int(exact and line.label)))
    return out


def fit(labelled: list[Finding], words: frozenset[str], letters: LetterModel) -> tuple[Judge, Forest]:
    """Cues from one half of the findings and the forest from the other, so that the forest knows how far cues can be trusted."""
    labelled = [row for row in labelled if row[0]]
    judge = Judge(words, letters, Cues(labelled[::2]))
    rest = labelled[1::2] or labelled
    return judge, Forest(depth=10).fit(np.asarray([judge.features(*row[:4]) for row in rest]), np.asarray([row[4] for row in rest], dtype=float))


def _findings(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value[0]
        for batch in batches:
            paths = batch.column("path").to_pylist()
            out, rows = [], []
            for i, text in enumerate(texts(batch)):
                for start, end in candidates(text):
                    before, after = text[max(0, start - BESIDE) : start], text[end : end + BESIDE]
                    out.append((i, start, end))
                    rows.append(judge.features(text[start:end], before, after, paths[i] or ""))
                    if len(rows) >= 8192:
                        yield found(batch, out, rows)
                        out, rows = [], []
            if rows:
                yield found(batch, out, rows)

    def found(batch: pa.RecordBatch, out: list[tuple[int, int, int]], rows: list[list[float]]) -> pa.RecordBatch:
        p = shared.value[1].predict(np.asarray(rows))
        keep = np.flatnonzero(p >= threshold)
        at = np.asarray(out, dtype=np.int64)[keep]
        columns = [batch.column("doc_id").take(pa.array(at[:, 0])), pa.array(at[:, 1]), pa.array(at[:, 2]), pa.array(p[keep])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "probability"])

    return run


def scan(
    spark: SparkSession,
    docs: DataFrame,
    findings: DataFrame | None = None,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
) -> DataFrame:
    """The findings that stay: doc_id, start, end (in characters), probability; one row each.

    `findings` are labelled ones: text, before, after, path, label (1 a secret);
    MAX_FINDINGS of them, the first by hash, are learned from.  Without any the
    forest learns from `sample_findings`, whose lines are made up.  A null text, id or path counts as
    empty, is kept, or is an empty path; texts without candidates give no row;
    repeated rows give their findings each.  Other columns are not read; an
    empty table gives an empty result.
    """
    prepare(spark)
    words, letters = dictionary(docs, text_col), LetterModel(letter_counts(docs, text_col))
    if findings is None:
        labelled = sample_findings()
    else:
        names = ["text", "before", "after", "path", "label"]
        known = findings.select(*names).where("text is not null and label is not null").orderBy(F.xxhash64(*names), *names).limit(MAX_FINDINGS)
        labelled = [(r["text"], r["before"] or "", r["after"] or "", r["path"] or "", int(r["label"])) for r in known.collect()]
    shared = spark.sparkContext.broadcast(fit(labelled, words, letters))
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_findings(shared, threshold), f"doc_id {id_type}, start long, end long, probability double")


def mask(text: str, spans: list[tuple[int, int]], sign: str = "*") -> str:
    """The text with each finding replaced by as many signs."""
    out, at = [], 0
    for start, end in sorted(spans):
        out += [text[at : max(at, start)], sign * max(0, end - max(at, start))]
        at = max(at, end)
    return "".join([*out, text[at:]])
