"""Near duplicates against brute force, and the parts that the method is made of."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quern.llm.queries")

from quern.llm import minhash  # noqa: E402


def brute(rows, words=2, percent=80):
    sets = [(d, minhash.shingles(t, words)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(s), root(d), d == root(d)) for d, s in sets)


def found(spark, rows, words=2, percent=80):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, minhash.near_duplicates(spark, docs, words=words, percent=percent).collect()))


def corpus(seed, n=60):
    chance = random.Random(seed)
    base = [[chance.choice("abcdefghij") * chance.randint(1, 3) for _ in range(chance.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(chance.choice(base))
        for _ in range(chance.randint(0, 3)):
            text[chance.randrange(len(text))] = chance.choice("xyz")
        rows.append((i, chance.choice([" ", "\n", "\t "]).join(text)))
    return rows


@pytest.mark.parametrize(("words", "seed"), [(2, 1), (2, 2), (5, 3)])
def test_against_brute_force(spark, words, seed):
    rows = corpus(seed)
    assert found(spark, rows, words) == brute(rows, words)


def test_edges(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (7, "One"), (2, "one"), (9, "one two"), (8, "ONE  two\n"), (6, "a b c d e f"), (1, "a b c d e g"), (0, "É é")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    repeated = [(1, "p q r s"), (1, "p q r s"), (2, "p q r s")]
    assert found(spark, repeated) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)]
    docs = spark.createDataFrame([(None, "p q r s"), (1, "p q r s")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark, docs, words=2).collect()} == {(None, None), (1, 1)}


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Blocks and squares: a bucket of more members than a block, with components that only pairs across blocks join."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    chance = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(80):
        text = list(base)
        for _ in range(chance.randint(2, 5)):
            text[chance.randrange(40)] = f"z{chance.randrange(5)}"
        rows.append((i, " ".join(text)))
    assert found(spark, rows) == brute(rows)


def test_hash_sets_are_made_where_registers_leave_a_partner(spark, monkeypatch):
    """Texts that share buckets by chance alone aren't read again, and those that may be alike are."""
    asked, texts_of = [], minhash._texts_of
    monkeypatch.setattr(minhash, "_texts_of", lambda texts, ids: asked.append(ids.count()) or texts_of(texts, ids))
    chance = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join(chance + [f"u{i}x{k}" for k in range(40)])) for i in range(60)]
    assert found(spark, rows) == brute(rows)
    assert not any(asked)
    rows += [(100 + i, " ".join([f"n{k}" for k in range(60)] + [f"m{i}x{k}" for k in range(12 + i % 3)])) for i in range(12)]  # just below 0.8
    assert found(spark, rows) == brute(rows)


def test_long_texts_and_words(monkeypatch):
    text = " ".join(["ab", "c" * 200, "D", "é"] * 30)
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None, "", "b", " a  b ", "x y z x y", text, "A\tb\n"]})
    whole = list(minhash._shingle_sets(*minhash.raw_texts(batch), 2, signed=True))
    assert [s.size for s in whole] == [1, 0, 0, 1, 1, 3, 4, 1] and whole[0].sha == whole[4].sha == whole[7].sha != whole[3].sha
    monkeypatch.setattr(minhash, "CHUNK", 64)
    cut = list(minhash._shingle_sets(*minhash.raw_texts(batch), 2, signed=True))
    assert [(s.hashes.tolist(), s.size, s.sha) for s in cut] == [(s.hashes.tolist(), s.size, s.sha) for s in whole]
    words = minhash.LongWords(np.frombuffer(text.encode(), np.uint8))
    assert words.spelt(np.arange(len(words.hashes))).split() == minhash.split_words(text.encode())


def test_words_that_a_polynomial_hash_confuses(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the multiplier."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"x {word} y {other}"), (4, f"x {other} y {word}"), (5, f"{word} {word} {other}")]
    assert found(spark, rows) == brute(rows)


def test_equal_hashes_are_told_apart(monkeypatch):
    """Where all shingles hash alike, sizes and digests are still those of the words."""
    monkeypatch.setattr(minhash, "mix64", lambda x: x * np.uint64(0))
    for words in (1, 2, 3):
        texts = ["a b c d", "a b c a b c", "b c d a", "a b a b", "d c b a", "a b c a b c a"]
        batch = pa.RecordBatch.from_pydict({"text": texts})
        sets = list(minhash._shingle_sets(*minhash.raw_texts(batch), words, signed=True))
        full = [minhash.shingles(t, words) for t in texts]
        assert [s.size for s in sets] == [len(f) for f in full]
        assert all((sets[i].sha == sets[j].sha) == (full[i] == full[j]) for i in range(len(full)) for j in range(i))


def test_clashing_columns(spark):
    rows = corpus(9, 20)
    docs = spark.createDataFrame([(d, t, 1, 2, b"x", "y") for d, t in rows], "doc_id long, text string, rep int, n_shingles int, sha binary, component_id string")
    assert sorted(map(tuple, minhash.near_duplicates(spark, docs, words=2).collect())) == brute(rows)
    kept = minhash.drop_near_copies(spark, docs.unionByName(docs.limit(0)), words=2)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _, _, stays in brute(rows) if stays}


def test_sketches_merge_and_estimate():
    chance = np.random.default_rng(1)
    a, b = chance.integers(0, 2**63, 500, dtype=np.uint64), chance.integers(0, 2**63, 300, dtype=np.uint64)
    assert (minhash.merge(minhash.registers(a), minhash.registers(b)) == minhash.registers(np.concatenate([a, b]))).all()
    kept = dropped = 0
    for _ in range(60):
        shared = chance.integers(0, 2**63, 400, dtype=np.uint64)
        near = [minhash.registers(np.concatenate([shared, chance.integers(0, 2**63, 50, dtype=np.uint64)])) for _ in range(2)]  # 0.8
        far = [minhash.registers(np.concatenate([shared[:200], chance.integers(0, 2**63, 250, dtype=np.uint64)])) for _ in range(2)]  # 0.29
        for pair, is_near in ((near, True), (far, False)):
            more, less = (np.asarray([c]) for c in ((pair[0] > pair[1]).sum(), (pair[0] < pair[1]).sum()))
            ok = minhash.plausible(more, less, np.asarray([450.0]), np.asarray([450.0]), 0.8)[0]
            kept += is_near and ok
            dropped += not is_near and not ok
    assert kept == 60 and dropped == 60


@pytest.mark.parametrize(("apart", "stays"), [(22, True), (23, True), (25, True), (30, False)])
def test_only_hopeless_pairs_are_dropped_unseen(apart, stays):
    """Sketches this far apart are rare, but not impossible, at a similarity of 0.8."""
    n, k = np.asarray([450.0]), np.asarray([apart])
    assert minhash.plausible(k, k, n, n, 0.8)[0] == stays
