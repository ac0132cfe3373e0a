"""Exact dedup and decontamination against SQL and brute force."""

import hashlib
import re

import pytest

pytest.importorskip("quern.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from quern.llm import decontamination, exact_dedup  # noqa: E402

BLANK = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, _part int, rows int"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


CASES = [
    (1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " "), (7, "é è"), (8, "éè "), (None, "ab"), (2, "ab"), (9, "x" * 200_000), (10, "x " * 200_000),
]


def brute_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(BLANK.sub("", text or ""), []).append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=str)


def found_exact(spark, rows):
    return sorted(map(tuple, exact_dedup.exact_dedup(spark, table(spark, rows)).collect()), key=str)


def test_exact_cases(spark):
    assert found_exact(spark, CASES) == brute_exact(CASES)
    assert found_exact(spark, []) == []


def test_exact_hot_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE_GROUP", 5)
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(300)]
    assert found_exact(spark, rows) == brute_exact(rows)


def test_exact_digests_that_collide(spark, monkeypatch):
    """With a digest that says little, whole texts decide."""
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(F.substring(c, 1, 1), n))
    for large in (512, 1):
        monkeypatch.setattr(exact_dedup, "LARGE_GROUP", large)
        rows = [(i, f"a{i % 3}") for i in range(12)] + [(20, "b")]
        found = [r[:4] for r in found_exact(spark, rows)]
        assert found == [r[:4] for r in brute_exact(rows)]


def test_drop_exact_copies_keeps_columns(spark):
    rows = [(1, "ab", "en", "s", 1, "q", 1, 2), (2, "a b c", None, None, None, None, None, None), (3, "abc", "en", "s", 1, "q", 1, 2), (4, None, "x", "s", 0, "", 0, 0)]
    kept = exact_dedup.drop_exact_copies(spark, table(spark, rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "digest", "_part", "rows"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hits, found = words(text), set(), set()
        for window, names in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hits.update(range(i, i + len(window)))
                    found |= names
        out.append((doc_id, len(w), sorted(hits), sorted(found)))
    return sorted(out, key=str)


ITEM = "One two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, ITEM), (12, "short item"), (3, None), (4, "!!"), (5, "ten eleven twelve a b c d e f g"), (2, "short item")]
DOCS = [
    (1, "zero " + ITEM.upper() + " end"), (2, "a SHORT, item. short item"), (3, None), (4, ""), (5, "short; items"), (6, ITEM[:-7]), (7, "one two three"),
    (8, "é" + ITEM), (9, ITEM + " a b c d e f g " + ITEM), (2, "a SHORT, item. short item"), (None, "short item"), (2, "nothing here"), (10, "w " * 30_000 + "short item"),
]


@pytest.mark.parametrize("limit", [50_000, 0])
def test_hits(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "MAX_ANCHOR_BYTES", limit)
    found = decontamination.contamination(spark, table(spark, DOCS), table(spark, ITEMS, "item_id long, text string"))
    got = sorted(((r["doc_id"], r["n_words"], r["hits"], r["items"]) for r in found.collect()), key=str)
    assert got == brute_hits(DOCS, ITEMS)


def test_no_benchmark_and_no_documents(spark):
    none = table(spark, [], "item_id long, text string")
    found = decontamination.contamination(spark, table(spark, DOCS), none)
    assert found.count() == len(DOCS) and found.where("size(hits) > 0").isEmpty()
    assert decontamination.contamination(spark, table(spark, []), table(spark, ITEMS, "item_id long, text string")).isEmpty()


def test_removal(spark):
    rows = [(1, "Keep. A short, item! Go", "en", "s", 1, "q", 1, 2), (2, "clean", None, None, None, None, None, None), (3, None, "", "", 0, "", 0, 0)]
    docs, items = table(spark, rows, SCHEMA), table(spark, ITEMS, "item_id long, text string")
    gone = decontamination.decontaminate(spark, docs, items)
    assert gone.columns == docs.columns and sorted(r["doc_id"] for r in gone.collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(spark, docs, items, remove="spans").collect()}
    assert cut == {1: "Keep. A Go", 2: "clean", 3: None}
    with pytest.raises(ValueError):
        decontamination.decontaminate(spark, docs, items, remove="all")
