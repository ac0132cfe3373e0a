"""Token ids of whole texts by a public tokenizer, with bounded caches of words.

The tokenizers here cut a text before they merge, and never across a blank
that stands alone.  In the word kind a text is cut at blanks, each new word is
cut by the tokenizer's own pattern, and each new piece goes to the library's
BPE model once; after that words are looked up.  In the byte kind many texts
are cut into pieces at once, by the kinds of their bytes, and each different
piece of them is looked up once.  Texts with characters or blanks for which
the cut isn't safe, or with a string that is a token of its own, are encoded
whole by the library.
"""

from __future__ import annotations

import codecs
import re
import string
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa

# Entries that the caches of words and of pieces hold unless told otherwise, and characters of the longest of them.
CACHED, CACHED_CHARS = 120_000, 64

# Blanks in str that aren't in the tokenizers, and the other way round.
_ODD_BLANKS = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")
# Beyond Latin letters, or with another lower case in str than in the tokenizers.
_ODD = re.compile("[^\x00-\xffĀ-įı-ɏ]")
# Texts of the byte kind that are cut at once: characters and number, at least one text.
_CHARS_AT_ONCE, _TEXTS_AT_ONCE = 1 << 21, 4096

# The patterns by which the two kinds of tokenizers cut a text.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE: printable ones for themselves, the rest from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_MARKS = string.punctuation
_LETTER, _DIGIT, _MARK, _BLANK, _OTHER = range(5)


@lru_cache(maxsize=1)
def _kinds_of_characters() -> np.ndarray:
    """The kind of each character of up to two bytes; _OTHER are those that aren't cut here."""
    import regex

    def kind(char: str) -> int:
        if _ODD.match(char) or char in _ODD_BLANKS:
            return _OTHER
        return next(k for k, p in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_BLANK, r"\s"), (_MARK, r"[^\s\p{L}\p{N}]")) if regex.match(p, char))

    return np.asarray([kind(chr(code)) for code in range(0x800)], np.uint8)


def kinds_of_bytes(raw: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the kind of its character; of one of three bytes or more, at least the first two are _OTHER."""
    of = _kinds_of_characters()
    kinds = np.concatenate([of[:0x80], np.full(0x80, _OTHER, np.uint8)])[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    found = of[(raw[lead] & 0x1F).astype(np.int64) << 6 | raw[lead + 1] & 0x3F]
    found[raw[lead] >= 0xE0] = _OTHER
    kinds[lead] = kinds[lead + 1] = found
    return kinds


def byte_pieces(raw: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where BYTE_PATTERN's pieces begin in texts that follow each other; text i lies from bounds[i] to bounds[i + 1]."""
    size = len(raw)
    edge = np.zeros(size + 3, dtype=bool)  # a text begins here, or none follows
    edge[bounds] = edge[size:] = True
    change = edge.copy()
    change[1:size] |= kinds[1:] != kinds[:-1]
    blank = kinds == _BLANK
    begin = change.copy()
    begin[1:size] &= blank[1:] | (raw[:-1] != 0x20) | edge[1:size]  # a space belongs to what follows it
    last = np.flatnonzero(blank & change[1 : size + 1] & ~edge[1 : size + 1])  # of several blanks the last one is cut off, but not at the end
    begin[last - (raw[last] >= 0x80)] = True
    quote = np.flatnonzero((raw == 0x27) & begin[:size])
    quote = quote[~edge[quote + 1]]
    one = quote[np.isin(raw[quote + 1], np.frombuffer(b"stmd", np.uint8))]
    quote = quote[~edge[quote + 2]]
    pair = raw[quote + 1].astype(np.uint16) << 8 | raw[quote + 2]
    two = quote[np.isin(pair, [int.from_bytes(p) for p in (b"re", b"ve", b"ll")])]
    begin[one + 1] = begin[two + 1] = False
    begin[one + 2] = begin[two + 3] = True
    return np.flatnonzero(begin[:size])


class _Cache(dict):
    """A dict that makes missing entries; when it is full, the older half goes."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.most:  # the older half goes
                for old in list(islice(self, self.most // 2)):
                    del self[old]
            self[key] = value
        return value


class Encoder:
    """A `tokenizers` file; `kind` is "byte" (a word keeps the space before it) or "word" (lower case, white space dropped).

    Ids come as bytes of little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str, kind: str, most: int = CACHED):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # Strings that the library takes for one token wherever they stand, the text's case aside in the word kind.
        added = {token.content for token in self.library.get_added_tokens_decoder().values()}
        self.added = tuple(sorted(added | {a.lower() for a in added}))
        self.vocabulary = self.library.get_vocab_size()
        self.byte = {"byte": True, "word": False}[kind]
        self.cut = regex.compile(WORD_PATTERN).findall
        self.letters = byte_letters()
        self.merge = self.library.model.tokenize
        self.table = "".join(self.letters[b] for b in range(256))
        self.pieces = _Cache(self._bytes if self.byte else self._piece, most)
        self.words = _Cache(self._word, most)

    def encode_whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece whose bytes stand as letters."""
        ids = array("I", [token.id for token in self.merge(piece)])
        return ids.tobytes() if sys.byteorder == "little" else np.asarray(ids, dtype="<u4").tobytes()

    def _bytes(self, piece: bytes) -> bytes:
        return self._piece(codecs.charmap_decode(piece, "strict", self.table)[0])

    def _word(self, word: str) -> bytes:
        """The ids of a word of the word kind."""
        word = word.lower()
        stem = word.rstrip(_MARKS)
        if stem.isalpha():  # letters, then marks: two pieces
            piece = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece]
            return ids + self.pieces[word[len(stem) :]] if len(stem) < len(word) else ids
        return b"".join([self.pieces[p.encode().decode("latin-1").translate(self.letters)] for p in self.cut(word)])

    def _plain(self, text: str) -> bool:
        """Whether the text may be cut at its blanks."""
        if not text.isascii() and _ODD.search(text):
            return False
        if any(a in text for a in self.added) or any(a in text.lower() for a in self.added):
            return False
        return not any(c in text for c in _ODD_BLANKS)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in the byte kind."""
        whole = "".join(texts)
        alone = {i for i, t in enumerate(texts) if any(a in t for a in self.added)} if any(a in whole for a in self.added) else set()
        raw, bounds = self._joined(texts, alone)
        kinds = kinds_of_bytes(raw)
        if len(other := np.flatnonzero(kinds == _OTHER)):
            alone |= set((np.unique(np.searchsorted(bounds, other, "right")) - 1).tolist())
            raw, bounds = self._joined(texts, alone)
            kinds = kinds_of_bytes(raw)
        begin = byte_pieces(raw, kinds, bounds)
        at = np.searchsorted(begin, bounds)
        offsets = np.append(begin, len(raw))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = pa.array(list(map(self.pieces.__getitem__, different)), pa.large_binary()).take(pieces.indices)
        ids = memoryview(found.buffers()[2] or b"")
        cuts = np.frombuffer(found.buffers()[1], np.int64)[at].tolist() if len(found) else [0] * len(at)
        for i, text in enumerate(texts):
            yield self.encode_whole(text) if i in alone else bytes(ids[cuts[i] : cuts[i + 1]])

    @staticmethod
    def _joined(texts: list[str], alone: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts but those `alone`, which are empty here, and where each begins."""
        encoded = [b"" if i in alone else t.encode() for i, t in enumerate(texts)]
        bounds = np.cumsum([0, *map(len, encoded)], dtype=np.int64)
        return np.frombuffer(b"".join(encoded), np.uint8), bounds

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        if self.byte:
            held, chars = [], 0
            for text in texts:
                held.append(text)
                chars += len(text)
                if chars >= _CHARS_AT_ONCE or len(held) >= _TEXTS_AT_ONCE:
                    yield from self._together(held)
                    held, chars = [], 0
            yield from self._together(held)
            return
        look = self.words.__getitem__
        for text in texts:
            yield b"".join(map(look, text.split())) if self._plain(text) else self.encode_whole(text)


@lru_cache(maxsize=1)
def encoder(path: str, kind: str, most: int = CACHED) -> Encoder:
    """The encoder of this process: what one task has looked up serves the next."""
    return Encoder(path, kind, most)


def public(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
