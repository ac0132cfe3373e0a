"""Repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("quern.llm.queries")

from quern.llm import queries, suffix_dedup  # noqa: E402


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = {}
    for _, b in texts:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[False], gone, [False]]).astype(int))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((d, bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), spans))
    return sorted(out, key=str)


def found(spark, rows, length, large=1 << 16):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(spark, docs, length=length, large_bucket=large)
    return sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], [(s["from"], s["to"]) for s in r["spans"]]) for r in got.collect()), key=str)


def corpus(seed):
    chance = random.Random(seed)
    letters = "abé "
    passages = ["".join(chance.choices(letters, k=chance.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(50):
        parts = ["".join(chance.choices(letters, k=chance.randint(0, 40)))]
        for _ in range(chance.randint(0, 3)):
            parts += [chance.choice(passages), "".join(chance.choices(letters, k=chance.randint(0, 30)))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "length", "large"), [(1, 16, 1 << 16), (2, 21, 1 << 16), (2, 9, 12)])
def test_against_brute_force(spark, seed, length, large):
    rows = corpus(seed)
    assert found(spark, rows, length, large) == brute(rows, length)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "q" * 100), (5, "ab" * 40 + "c"), (6, "whole copy of a text"), (7, "whole copy of a text"), (7, "whole copy of a text"), (None, "xx whole copy of a text yy")]
    assert found(spark, rows, 12) == brute(rows, 12)
    assert found(spark, [], 12) == []


def test_one_passage_in_most_texts(spark):
    """A bucket far beyond its bound: a passage with different bytes on either side, other passages in some, a line over and over."""
    chance = random.Random(8)
    passage, line = "".join(chance.choices("abcd", k=30)), "".join(chance.choices("abcd", k=14))
    rows = [(i, "".join(chance.choices("xyz", k=chance.randint(0, 9))) + passage[chance.randint(0, 3) :] + "".join(chance.choices("xyz", k=chance.randint(0, 9)))) for i in range(90)]
    rows += [(100, line * 40 + "q"), (101, "z" + line * 40 + "".join(chance.choices("xyz", k=60)) + line * 30)]
    assert found(spark, rows, 20, 25) == brute(rows, 20)


def test_clashing_columns(spark):
    rows = corpus(4)[:20]
    docs = spark.createDataFrame([(d, t, b"s", 1, "k", 2, 3) for d, t in rows], "doc_id long, text string, sha binary, anchor int, key string, spans int, n_bytes int")
    got = suffix_dedup.remove_repeats(spark, docs, length=16)
    assert sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], [(s["from"], s["to"]) for s in r["spans"]]) for r in got.collect()), key=str) == brute(rows, 16)


def test_planted_passages(spark, tmp_path):
    """The query at its own length, on passages of over 50 words: they go from 400 bytes on and stay below, whatever `n_bytes` is."""
    chance = random.Random(14)

    def words(n, size):
        return " ".join("".join(chance.choices("abcdefgé", k=size)) for _ in range(n))

    def own():
        return words(chance.randint(5, 150), 6)

    long, short = words(55, 8), words(55, 5)
    assert len(long.encode()) >= 400 > len(short.encode()) + 20
    texts = [f"{own()} {long} {own()}" for _ in range(12)] + [f"{own()} {short} {own()}" for _ in range(12)] + [own() for _ in range(12)]
    texts += [f"{own()} {long} {own()} {short}", f"{own()} {short} {own()} {short} {own()}", None, "", long]
    rows = list(enumerate(texts))
    pq.write_table(pa.table({"doc_id": [d for d, _ in rows], "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_suffix_dedup"](spark, str(tmp_path)).collect()}
    for d, kept, n_bytes, spans in brute(rows, 400):
        removed, r = sum(z - a for a, z in spans), got.pop(d)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n_bytes, removed, len(spans), hashlib.sha256(kept).hexdigest())
        holds = long in (texts[d] or "")
        assert n_bytes == len((texts[d] or "").encode()) and (removed >= len(long.encode())) == holds and (removed > 0) == holds
    assert not got


def test_anchors_in_blocks(monkeypatch):
    chance = np.random.default_rng(3)
    raw = chance.integers(0, 3, 5000).astype(np.uint8)
    whole = suffix_dedup.Anchors(40).of(raw)
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 512)
    cut = suffix_dedup.Anchors(40).of(raw)
    assert set(whole[0].tolist()) <= set(cut[0].tolist()) or set(cut[0].tolist()) <= set(whole[0].tolist())
    starts = np.sort(cut[0])
    assert starts[0] <= 20 and (np.diff(starts) <= 21).all() and len(raw) - 20 - starts[-1] <= 21


def test_columns():
    """What a collection's columns say, against all pairs."""
    chance = np.random.default_rng(5)
    for _ in range(20):
        n, width, length = 12, 14, 5
        rows = chance.integers(0, 2, (n, width)).astype(np.uint16)
        rows[chance.random((n, width)) < 0.05] = 256
        bucket = np.sort(chance.integers(0, 3, n))
        first, last = suffix_dedup.column_matches(rows.T.copy(), bucket, length)
        for i in range(n):
            starts = [s for s in range(width - length + 1) if any(j != i and bucket[j] == bucket[i] and 256 not in rows[i, s : s + length] and (rows[j, s : s + length] == rows[i, s : s + length]).all() for j in range(n))]
            assert (first[i], last[i]) == ((starts[0], starts[-1]) if starts else (-1, -1))
