"""Exact deduplication with a log-structured merge index of digests.

Each task is a memtable: it flushes the digests of the rows it read as one
sorted run.  Compaction merges all runs into one level by a sort aggregation,
and keeps, for each digest, the number of rows and the identifier that stays.
A bit filter over the digests of several rows is what lookups probe; those
that pass are only hits, and their normalised texts are compared byte by byte
before rows count as equal.  A whole table is one batch, so there are two
levels; the files' own bloom filters serve later lookups of single digests.

Everything is DataFrame work: no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, bit_filter, filter_bits, flagged, parted, passing

BLOOM = {"parquet.bloom.filter.enabled#digest": "true"}
# A group of more rows than this is dealt out over PARTS tasks.
LARGE_GROUP, PARTS = 512, 256


def normalised(text: Column) -> Column:
    r"""The text without any character of [\x20\x09-\x0D]; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _rank() -> Column:
    """Smallest first: most code points, then the smallest id; a null id comes last."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))


class DigestIndex:
    """Runs of (digest, points, doc_id, rows), flushed at level 0 and merged at level 1."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.runs = scratch, []

    def flush(self, entries: DataFrame) -> DataFrame:
        """One sorted run for each task of `entries`."""
        run = self.scratch.table(entries.sortWithinPartitions("digest"), f"level0-{len(self.runs)}", BLOOM)
        self.runs.append(run)
        return run

    def compact(self) -> DataFrame:
        """(digest, rows, keep_id): all runs merged; the smallest identifier stays."""
        merged = self.runs[0]
        for run in self.runs[1:]:
            merged = merged.unionByName(run)
        best = merged.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min(_rank()).alias("best"))
        out = best.select("digest", "rows", F.col("best.doc_id").alias("keep_id")).sortWithinPartitions("digest")
        return self.scratch.table(out, "level1", BLOOM)


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting blanks (see `normalised`).
    Of equal texts the row with the most code points in the original stays,
    then the smallest id.  A null text is empty, and all empty texts are equal;
    a null id stays only where no other id is there; rows that share id and
    text stay or go together.  Other columns are not read; an empty table
    gives an empty result.
    """
    scratch = Scratch(spark, "exact")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("points"), normalised(F.col("text")).alias("norm"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("norm", 256)))

    index = DigestIndex(scratch)
    run = index.flush(keyed.select("digest", "points", "doc_id"))
    merged = index.compact()
    wrong = _several_texts(scratch, keyed, merged)

    found = run.join(merged, "digest")
    if not wrong.isEmpty():  # two texts with one SHA-256
        found = found.join(wrong, "digest", "left_anti").select("digest", "doc_id", "rows", "keep_id").union(_by_text(keyed, wrong))
    return found.select(
        "doc_id",
        "keep_id",
        F.col("rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _several_texts(scratch: Scratch, keyed: DataFrame, merged: DataFrame) -> DataFrame:
    """The digests whose rows don't all have one text, found by comparing bytes.

    Only rows that pass a bit filter over the digests of several rows carry
    their text through a shuffle, once.  Each row is compared with the one
    before it under its digest; a large group is dealt out over PARTS tasks,
    and then the first row of each part is compared with that of the next.
    """
    hits = merged.where("rows > 1")
    word, bits = F.xxhash64("digest"), filter_bits(hits.count())
    rows = passing(keyed, word, bits, bit_filter(hits, word, bits))
    rows = flagged(rows, "large", word, bits, bit_filter(merged.where(F.col("rows") > LARGE_GROUP), word, bits))
    rows = rows.withColumn("part", F.when(F.col("large"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).otherwise(0))
    before = F.lag("norm").over(Window.partitionBy("digest", "part").orderBy("doc_id"))
    seen = rows.select("digest", "norm", "large", before.alias("before")).withColumn("differs", F.col("before") != F.col("norm"))
    seen = seen.where(F.col("differs") | (F.col("large") & F.col("before").isNull())).select("digest", "norm", "before", "differs")
    seen = scratch.table(seen, "compared")
    before = F.lag("norm").over(Window.partitionBy("digest").orderBy("norm"))
    heads = seen.where("before is null").select("digest", "norm", before.alias("before")).where("before <> norm")
    return scratch.table(seen.where("differs").select("digest").union(heads.select("digest")).distinct(), "several")


def _by_text(keyed: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, doc_id, rows, keep_id) of the rows with these digests, grouped by their whole text."""
    rows = keyed.join(digests, "digest").select("digest", "norm", "points", "doc_id")
    own = rows.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"), F.min(_rank()).alias("best"))
    return rows.join(own, ["digest", "norm"]).select("digest", "doc_id", "rows", F.col("best.doc_id").alias("keep_id"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    The verdict is joined on the id and the digest of the text, so that rows
    that merely share an id are judged apart; repeated rows stay or go
    together.  Null and empty texts are equal to each other, so one of them
    stays; a null id stays only where its text has no other.  An empty table
    gives an empty result.
    """
    scratch = Scratch(spark, "copies")
    verdict = exact_dedup(spark, docs, id_col, text_col)
    gone = scratch.table(verdict.where("not kept").select(F.col("doc_id").alias("quern_id"), F.col("text_sha256").alias("quern_sha")).distinct(), "gone")
    maybe, stays = parted(docs, F.xxhash64(F.col(id_col)), gone, F.xxhash64("quern_id"))
    maybe = maybe.withColumn("quern_digest", F.sha2(normalised(F.col(text_col)), 256))
    on = maybe[id_col].eqNullSafe(gone["quern_id"]) & (maybe["quern_digest"] == gone["quern_sha"])
    return stays.unionByName(maybe.join(gone, on, "left_anti").drop("quern_digest"))
