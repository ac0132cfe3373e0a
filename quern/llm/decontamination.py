"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A document is read once.  Its words are tested against the set of anchor words,
one of each benchmark window; only the words round an anchor go on to be
compared with the windows, word by word.  Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, bit_filter, filter_bits, parted, passing

WINDOW = 10
# The normalisation that the contract states.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of a benchmark's distinct anchors and of its windows up to which they are broadcast; beyond that windows are
# joined by shuffle, and only words that pass a bit filter over the anchors travel.
MAX_ANCHOR_BYTES, MAX_WINDOW_BYTES = 1 << 20, 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, size, anchor, off, items): the distinct windows of all items.

    The anchor is the longest word of the window, the first of equal ones by
    spelling; `off` is where it stands first.  A null id is the item "null".
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    parts = items.where(F.size("words") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window))).alias("part"))
    longest = F.array_max(F.transform("part", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    parts = parts.select("item", _phrase(F.col("part")).alias("phrase"), F.size("part").alias("size"), longest.alias("anchor"), (F.array_position("part", longest) - 1).cast("int").alias("off"))
    return parts.groupBy("phrase", "size", "anchor", "off").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_key, n_words, hits, items.

    `hits` are the positions of words inside an occurrence of a window, sorted;
    `items` the ids of the items with occurring windows, sorted as strings.
    Null and empty texts have no words and no hits; items without words have no
    windows.  Rows that share an id are told apart by `text_key`; rows that
    share both are repeated rows and get equal results.  Other columns are not
    read.  An empty table on either side gives no hits.
    """
    scratch = Scratch(spark, "decontaminate")
    windows = scratch.table(benchmark_windows(benchmark, item_col, "text", window), "windows")
    anchors = windows.select("anchor").distinct()
    weight = F.octet_length("phrase") + F.octet_length("anchor") + F.octet_length(F.array_join("items", " ")) + 64
    window_bytes = windows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    n_anchors, anchor_bytes = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("anchor") + 16), F.lit(0))).first()
    small = window_bytes <= MAX_WINDOW_BYTES and anchor_bytes <= MAX_ANCHOR_BYTES

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    everywhere = F.sequence(F.lit(0), F.size("words") - 1)
    if small:
        known = [r["anchor"] for r in anchors.collect()]  # at most MAX_ANCHOR_BYTES
        found = F.filter(everywhere, lambda i: F.get("words", i).isin(known)) if known else F.array().cast("array<int>")
    else:
        rows = scratch.table(rows, "words")  # else each word would split its text again
        found = everywhere
    around = F.transform(
        F.when(F.size("words") > 0, found).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            i.alias("at"),
            F.least(i, F.lit(window - 1)).alias("before"),
            F.get("words", i).alias("anchor"),
            F.slice("words", F.greatest(i - (window - 1), F.lit(0)) + 1, 2 * window - 1).alias("near"),
        ),
    )
    scanned = rows.select("doc_id", "text_key", F.size("words").alias("n_words"), around.alias("around"))
    if small:
        scanned = scratch.table(scanned, "scanned")
        near = scanned.where(F.size("around") > 0).select("doc_id", "text_key", F.inline("around"))
    else:
        word, bits = F.xxhash64("anchor"), filter_bits(n_anchors)
        near = passing(scanned.select("doc_id", "text_key", F.inline("around")), word, bits, bit_filter(anchors, word, bits))
    met = near.join(F.broadcast(windows) if small else windows, "anchor")
    met = met.where((F.col("before") >= F.col("off")) & (_phrase(F.slice("near", F.col("before") - F.col("off") + 1, F.col("size"))) == F.col("phrase")))
    met = met.select("doc_id", "text_key", F.sequence(F.col("at") - F.col("off"), F.col("at") - F.col("off") + F.col("size") - 1).alias("covered"), "items")
    hit = met.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    out, hit = scanned.select("doc_id", "text_key", "n_words"), hit.withColumnsRenamed({"doc_id": "quern_id", "text_key": "quern_key"})
    out = out.join(hit, out["doc_id"].eqNullSafe(hit["quern_id"]) & (out["text_key"] == hit["quern_key"]), "left")
    none = F.array()
    return out.select("doc_id", "text_key", "n_words", F.coalesce("hits", none.cast("array<int>")).alias("hits"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def decontaminate(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
) -> DataFrame:
    """`docs` without benchmark passages, with all its columns; null and empty texts, null ids and repeated rows without hits stay.

    `remove="documents"` drops every document with a hit; `remove="spans"` keeps
    it and takes the hit words and the separators after them out of its text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    scratch = Scratch(spark, "hits")
    hit = contamination(spark, docs, benchmark, id_col, text_col, item_col, window).where(F.size("hits") > 0)
    hit = hit.select(F.col("doc_id").alias("quern_id"), F.col("text_key").alias("quern_key"), F.col("hits").alias("quern_hits")).dropDuplicates(["quern_id", "quern_key"])
    hit = scratch.table(hit, "hit")
    maybe, clean = parted(docs, F.xxhash64(F.col(id_col)), hit, F.xxhash64("quern_id"))
    keyed = maybe.withColumn("quern_text_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    on = keyed[id_col].eqNullSafe(hit["quern_id"]) & (keyed["quern_text_key"] == hit["quern_key"])
    if remove == "documents":
        return clean.unionByName(keyed.join(hit, on, "left_anti").drop("quern_text_key"))
    words = F.regexp_extract_all(text_col, F.lit(RAW_WORD), F.lit(0))
    gaps = F.split(text_col, RAW_WORD)
    left = F.concat(
        F.get(gaps, F.lit(0)),
        F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(words) - 1), F.col("quern_hits")),
                lambda i: F.concat(F.get(words, i), F.get(gaps, i + 1)),
            ),
            "",
        ),
    )
    joined = keyed.join(hit, on, "left")
    return clean.unionByName(joined.withColumn(text_col, F.when(F.col("quern_hits").isNull(), F.col(text_col)).otherwise(left)).select(docs.columns))
