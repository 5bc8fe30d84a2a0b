"""Token ids of whole texts by a public vocabulary, with each distinct word encoded once in a worker.

The 49k vocabulary lower-cases and drops white space, so a text's ids are its words' ids in order. Texts of Latin-1
characters alone are lower-cased whole, which leaves fewer distinct words; the library's model encodes each part of a
word, and the whole library call takes words outside plain Latin letters and signs.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa

from . import common

#: Letters, single digits and runs of signs, as the vocabulary's own split gives them for lower-case words of plain Latin text.
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xe0-\xf6\xf8-\xff\xdf]+|[0-9]|[^a-z\xe0-\xf6\xf8-\xff\xdf0-9]+")
_PLAIN = re.compile(rb"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_LETTERS = re.compile(rb"[a-z\xe0-\xf6\xf8-\xff\xdf]{1,200}")
_LOWER = bytes(ord(x) if ord(x := chr(b).lower()) < 256 else b for b in range(256))
#: Kinds of lower-case bytes, at which words are cut: white space, letters, digits, signs, and what keeps its word whole.
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_BLANK = b" \t\n\v\f\r"
_KINDS = bytes(_SPACE if b in _BLANK else _ODD if b == 0x27 or not _PLAIN.fullmatch(bytes([b])) else _DIGIT if 0x30 <= b <= 0x39 else _LETTER if _LETTERS.fullmatch(bytes([b])) else _SIGN for b in range(256))
_ID = attrgetter("id")
_CACHES: dict[str, "WordIds"] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordIds(common.Recent):
    """Lower-case Latin-1 word -> its ids as unsigned 32-bit integers. Words used of late are remembered, so memory is bounded."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__(self._ids, limit)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        letters = _byte_letters()
        self.shown = ["".join(letters[x] for x in chr(b).encode()) for b in range(256)]

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha() and len(word) <= 200:  # of bytes: letters a to z alone
            return self._part(word)
        if len(word) <= 200 and b"<|" not in word and _PLAIN.fullmatch(word):
            parts = _PARTS.findall(word)
            return b"".join([self[part] for part in parts]) if len(parts) > 1 else self._part(word)
        return self._library(word.decode("latin-1"))

    def _show(self, part: bytes) -> str:
        return part.decode() if part.isascii() else "".join([self.shown[b] for b in part])

    def _part(self, part: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(self._show(part))]).tobytes()

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        try:
            words = (text if text.isascii() else text.decode().encode("latin-1")).translate(_LOWER).split()
        except UnicodeEncodeError:
            # Words with other characters go to the library as they stand, the rest of the text as above.
            return b"".join([self._any(w) for w in text.split()])
        return b"".join(self.all(words))

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts, one text after the other, and their number in each; every different part is looked up once."""
        plain, other = [], {}
        for i, text in enumerate(texts):
            try:
                plain.append((text if text.isascii() else text.decode().encode("latin-1")).translate(_LOWER))
            except UnicodeEncodeError:
                plain.append(b"")
                other[i] = np.frombuffer(self.encode(text), dtype=np.uint32)
        joined = b" ".join([b"", *plain])  # each text after a space
        data, kind = np.frombuffer(joined, dtype=np.uint8), np.frombuffer(joined.translate(_KINDS), dtype=np.uint8)
        begins = np.ones(len(data), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == _DIGIT
        spaces = np.flatnonzero(kind == _SPACE)
        # Words with an apostrophe, the beginning of a special token or other characters stay whole.
        odd = np.flatnonzero(kind == _ODD)
        if b"<|" in joined:
            odd = np.concatenate((odd, np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))))
        edges = np.append(spaces, len(data))
        for word in np.unique(np.searchsorted(spaces, odd)).tolist():
            begins[edges[word - 1] + 2 : edges[word]] = False
        letters = joined.translate(None, _BLANK)
        ends = np.append(np.flatnonzero(begins[kind != _SPACE]), len(letters))
        parts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        found = pa.array(self._parts(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(parts.indices)
        after = np.cumsum([0, *(len(x) + 1 for x in plain)])
        after = np.searchsorted(ends, after - np.searchsorted(spaces, after))
        bounds = np.frombuffer(found.buffers()[1], dtype=np.int64)[after] // 4 if len(found) else 0 * after
        ids = np.frombuffer(found.buffers()[2] or b"", dtype=np.uint32)
        if not other:
            return ids[: bounds[-1]], np.diff(bounds)
        pieces = [other.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))]
        return np.concatenate(pieces), np.array(list(map(len, pieces)), dtype=np.int64)

    def _parts(self, keys: list[bytes]) -> list[bytes]:
        """The ids of different parts; unseen ones are encoded some at a time, so that little is held besides."""
        got = list(map(self.get, keys))
        unseen = [i for i, x in enumerate(got) if x is None]
        for at in range(0, len(unseen), 512):
            made, words = {}, []
            for i in unseen[at : at + 512]:
                key = keys[i]
                value = self.old.get(key)
                if value is not None:
                    made[key] = got[i] = value
                elif (key.isalpha() and len(key) <= 200) or _LETTERS.fullmatch(key):
                    words.append(i)
                else:
                    made[key] = got[i] = self._ids(key)
            tokens = [self.model.tokenize(self._show(keys[i])) for i in words]
            raw, end = array("I", list(map(_ID, chain.from_iterable(tokens)))).tobytes(), 0
            for i, own in zip(words, tokens):
                made[keys[i]] = got[i] = raw[end : (end := end + 4 * len(own))]
            self._remember(made)
        return got

    def _any(self, word: bytes) -> bytes:
        shown = word.decode()
        try:
            return self[shown.encode("latin-1").translate(_LOWER)]
        except UnicodeEncodeError:
            return self._library(shown)


def word_ids(path: str, limit: int = 400_000) -> WordIds:
    """One cache for each worker process and vocabulary, with the limit asked for last."""
    if path not in _CACHES:
        _CACHES[path] = WordIds(path, limit)
    _CACHES[path].half = max(1, limit // 2)
    return _CACHES[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
