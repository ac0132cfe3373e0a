"""Tokenizers' ids, shards on disk and packing: exact round trips."""

import random
import sys
import tracemalloc
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quern.llm.queries")
pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quern.llm import packing, token_files, tokens  # noqa: E402
from quern.llm.common import Scratch  # noqa: E402

BYTE, WORD = ("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")
TEXTS = [
    "", " ", "\n", "a\n b", "a  b", "a \nb", "a\n \nb", "x\n ", " lead", "tail ", "it 's don't", "Ωμεγα ñandú", "a\x85b", "a\x1cb", "a\xa0b", "<|endoftext|> x", "hello <|endoftext|> world", "a<|startoftext|>b <|STARTOFTEXT|> <|EndOfText|>", "<|endoftext", "İstanbul ß",
    "é café 日本語", "foo\tbar \t baz", "123 4567 a1b2", "x don't it's. ,, a,b foo.\n\nBar é,ñ! _a_ a_ ª º²", "w" * 5000, "é ́", "\x00 \x7f", "A-B, c.", "'s 't'", "a'", "word's.",
]


def library_ids(name, text):
    """What the library gives, asked just as the contract asks it."""
    if name not in _fresh:
        _fresh[name] = Tokenizer.from_file(tokens.public(name))
    return np.asarray(_fresh[name].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_fresh = {}


@pytest.fixture(scope="module", params=[BYTE, WORD], ids=["byte", "word"])
def encoder(request):
    return request.param[0], tokens.Encoder(tokens.public(request.param[0]), request.param[1])


def test_words_give_the_librarys_ids(encoder):
    name, encoder = encoder
    for text in TEXTS:
        assert list(encoder.encode([text])) == [library_ids(name, text)], text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aBé \n\t'.,-_s1²ñ!\xa0\x0bZ", "<|endoftext|>", "<|startoftext|>"]), max_size=30).map("".join))
def test_any_text(text):
    for name, kind in (BYTE, WORD):
        encoder = tokens.encoder(tokens.public(name), kind)
        assert list(encoder.encode([text])) == [library_ids(name, text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aBé \n\t'.²\xa0\x1cstmdrevl語", "'ll", "'re", "'ve", "  ", "\r\n", "<|endoftext|>"]), max_size=12).map("".join), max_size=8))
def test_many_texts_at_once(encoder, texts):
    name, encoder = encoder
    assert list(encoder.encode(texts)) == [library_ids(name, t) for t in texts]


def test_texts_are_cut_in_groups(monkeypatch):
    monkeypatch.setattr(tokens, "_CHARS_AT_ONCE", 20)
    encoder = tokens.Encoder(tokens.public(BYTE[0]), BYTE[1], 8)
    assert list(encoder.encode(iter(TEXTS * 2))) == [library_ids(BYTE[0], t) for t in TEXTS * 2] and len(encoder.pieces) <= 8


def test_new_words_of_known_pieces_cost_no_calls():
    """In the byte kind Python runs for each different piece, not for each different word or text."""
    encoder = tokens.Encoder(tokens.public(BYTE[0]), BYTE[1])
    words = [a * n + mark * m for a in "abcde" for n in range(1, 21) for mark in ".,!-" for m in range(1, 11)]
    text, calls = " ".join(words), []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        (ids,) = encoder.encode([text])
    finally:
        sys.setprofile(None)
    assert ids == library_ids(BYTE[0], text)
    assert len(set(words)) == 4000 and len(calls) < 1000, len(calls)


def test_caches_are_bounded():
    cache = tokens._Cache(str.encode, 10)
    assert [cache[str(i % 25)] for i in range(100)] == [str(i % 25).encode() for i in range(100)]
    assert len(cache) <= 10 and cache["x" * 100] == b"x" * 100 and "x" * 100 not in cache


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids binary, start long")


ROWS = [(3, "three words here", None, None), (1, None, b"x", 1), (2, "", None, 2), (7, "seven " * 3000, None, None), (5, "café <|endoftext|>", None, 0), (3, "three words here", None, None), (None, "no id", None, None)]


def test_files_round_trip(spark):
    end = np.asarray([2], "<u4").tobytes()
    found = token_files.token_files(spark, documents(spark, ROWS), tokens.public(BYTE[0]), kind="byte", end_id=2, sequence=64, shard_tokens=500).collect()
    found = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 1, 2, 3, 3, 5, 7]
    texts = {d: t for d, t, *_ in ROWS}
    at = 0
    for r in found:
        assert bytes(r["ids"]) == library_ids(BYTE[0], texts[r["doc_id"]] or "") + end and r["start"] == at
        at += len(r["ids"]) // 4
    assert token_files.token_files(spark, documents(spark, []), tokens.public(BYTE[0])).collect() == []


def test_the_list_of_shards_is_one_file(spark):
    """Each file that Spark makes in a local folder starts three processes beside an executor."""
    rows = [(i, f"text {i}", None, None) for i in range(100)]
    found = token_files.token_files(spark, documents(spark, rows), tokens.public(BYTE[0]), kind="byte", end_id=2)
    scratch = Scratch.open[-1].path.removeprefix("file://")
    assert len(list(Path(scratch, "files").glob("*.arrow"))) == 4 and len(list(Path(scratch, "shards").glob("*.parquet"))) == 1
    starts = [r["start"] for r in found.orderBy("doc_id").collect()]
    assert starts == np.cumsum([0, *(len(library_ids(BYTE[0], t)) // 4 + 1 for _, t, *_ in rows[:-1])]).tolist()


def test_a_shard_in_the_making_takes_few_bytes_a_token(tmp_path, monkeypatch):
    """Its ids twice and its mask, in 16 bits and 8; larger copies add up over the tasks of an executor."""
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": ["two words " * 5000] * 100})
    run = token_files._write(f"file://{tmp_path}", tokens.public(BYTE[0]), "byte", 2, 2048, 1 << 30)
    list(run(iter([batch.slice(0, 1)])))  # loads the tokenizer
    tracemalloc.start()
    (row,) = list(run(batch.slice(i, 1) for i in range(100)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = row.column("n_tokens")[0].as_py()
    assert n > 900_000 and peak < 8 * n, peak
    shard = token_files.Shard(row.column("uri")[0].as_py())
    end = np.asarray([2], "<u4").tobytes()
    assert shard.document(99).astype("<u4").tobytes() == library_ids(BYTE[0], "two words " * 5000) + end
    shard.close()


@pytest.mark.parametrize("width", [np.uint16, np.uint32])
def test_a_shards_rows_are_views(tmp_path, width):
    ids = np.arange(1000, dtype=width)
    uri = f"file://{tmp_path}/a/shard.arrow"
    token_files.write_shard(uri, ids, pa.array([4, 9, 11]), [300, 650, 50], sequence=16)
    shard = token_files.Shard(uri)
    assert shard.starts.tolist() == [0, 300, 950, 1000] and shard.document(1).tolist() == ids[300:950].tolist()
    row, mask = shard.row(62)
    assert row.tolist() == [*ids[992:].tolist(), *[0] * 8] and mask.to_pylist() == [True] * 8 + [False] * 8
    first = shard.row(3)[0]
    assert first.tolist() == ids[48:64].tolist() and not first.flags.owndata and not first.flags.writeable
    shard.close()


def check_packing(pieces, lengths, capacity):
    """Each token in exactly one piece, sequences gapless and not too long; gives the padding."""
    by_doc, by_sequence = {}, {}
    for row, start, length, sequence, offset in pieces:
        by_doc.setdefault(row, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for row, length in lengths.items():
        at = 0
        for start, size in sorted(by_doc[row]):
            assert start == at and size > 0
            at += size
        assert at == length
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("seed", range(4))
def test_packer(seed):
    chance = random.Random(seed)
    lengths = {i: chance.choice([1, chance.randint(1, 50), chance.randint(1, 3000), 2048, 4096]) for i in range(chance.choice([1, 40, 600]))}
    packer, pieces = packing.Packer(), []
    for row, length in lengths.items():
        pieces += [(p.row, p.start, p.length, s, o) for s, o, p in packer.add(row, length)]
    pieces += [(p.row, p.start, p.length, s, o) for s, o, p in packer.finish()]
    padding = check_packing(pieces, lengths, 2048)
    assert padding <= 0.005 * sum(lengths.values())


def test_packing_documents(spark):
    found = packing.pack(documents(spark, ROWS), tokens.public(WORD[0])).collect()
    texts = {d: t for d, t, *_ in ROWS}
    for r in found:
        whole = library_ids(WORD[0], texts[r["doc_id"]] or "") + np.asarray([1], "<u4").tobytes()
        assert r["doc_tokens"] == len(whole) // 4 and bytes(r["ids"]) == whole[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(bytes(r["ids"])) >= 0
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [0, *np.cumsum([size for _, size in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack(documents(spark, []), tokens.public(WORD[0])).collect() == []
    with pytest.raises(ValueError):
        packing.Packer(1000)
