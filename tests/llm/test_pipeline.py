"""The pipeline: each stage held against brute force on its own input, and the whole run."""

import hashlib
import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quern.llm import minhash  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't there")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name: (rows in, rows out), each result written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["quality", "exact", "near", "benchmark", "packing"]
    assert all(stages[n][2] == COLUMNS for n in list(stages)[:-1])
    for name in list(stages)[:-1]:
        before, after, _ = stages[name]
        assert set(after) <= set(before)


def test_quality(spark):
    """On a table with labels enough to learn from."""
    folder = SF if "0.001" not in SF else SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, folder).select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_exact(stages):
    before, after, _ = stages["exact"]
    best = {}
    for r in before:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "").encode()).digest()
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"])) if key in best else (-len(r["text"] or ""), r["doc_id"])
    assert {r["doc_id"] for r in after} == {d for _, d in best.values()}


def test_near(stages):
    before, after, _ = stages["near"]
    sets = sorted((r["doc_id"], minhash.shingles(r["text"], 5)) for r in before)
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r["doc_id"] for r in after} == {d for d, _ in sets if root(d) == d}


def test_benchmark(stages, spark):
    from tests.llm.test_exact_and_decontamination import brute_hits

    before, after, _ = stages["benchmark"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _, hits, _ in brute_hits([(r["doc_id"], r["text"]) for r in before], items) if hits}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - hit


def test_packing(stages):
    before, after, _ = stages["packing"]
    total = {}
    for r in after:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert r["length"] <= r["doc_tokens"]
    assert set(total) == {r["doc_id"] for r in before}
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in after)


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in found.collect()) == sorted((r["doc_id"], r["start"], r["length"]) for r in stages["packing"][1])
