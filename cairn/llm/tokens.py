"""Token ids of whole texts by a public word-level BPE vocabulary, one lookup for each distinct word.

The vocabulary lowers a text, cuts it into words and merges within words only. The cutting is
done here on bytes, a batch at a time, for texts of ASCII and Latin-1 letters; the tokenizer
itself sees each new word once, and any text with other characters whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cairn.llm import kernel as K

#: Words that a worker remembers before it forgets them all.
REMEMBERED = 400_000

_SPACE, _LETTER, _DIGIT, _OTHER, _FOREIGN = range(5)
_CLASS = np.full(256, _FOREIGN, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
#: Word endings that the vocabulary cuts off with their apostrophe (fixed values).
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes and the class of each; letters of U+00C0 to U+00FF have two bytes of one class."""
    low = K.ASCII_LOWER[data]
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    second = data[lead + 1]
    lead, second = lead[second >= 0x80], second[second >= 0x80]
    sign = (second == 0x97) | (second == 0xB7)
    for place in (lead, lead + 1):
        kind[place] = np.where(sign, _OTHER, _LETTER)
    upper = lead[(second <= 0x9E) & ~sign] + 1
    low[upper] += 0x20
    return low, kind


def _words(low: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    n = len(low)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start |= first
    space = kind == _SPACE
    for i in np.flatnonzero((low == 39) & start):
        stop = int(offsets[np.searchsorted(offsets, i, "right")])
        rest = low[i + 1 : min(i + 3, stop)].tobytes()
        for ending in _ENDINGS:
            if rest.startswith(ending):
                start[i + 1 : i + 1 + len(ending)] = False
                if i + 1 + len(ending) < stop:
                    start[i + 1 + len(ending)] = True
                break
    bound = np.flatnonzero(start | space)
    word = ~space[bound]
    return bound[word], np.append(bound[1:], n)[word]


class WordTokenizer:
    """Ids of texts; the same as the tokenizer in the file gives, without special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids = np.asarray(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word has been cut")
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.concatenate([[0], ends[:-1]])
        self.used += len(ids)
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        self.keys = both[order]
        self.at = np.concatenate([self.at, at])[order]
        self.length = np.concatenate([self.length, np.diff(np.concatenate([[0], ends]))])[order]

    def _fast(self, data: np.ndarray, offsets: np.ndarray, low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's start (one more at the end)."""
        starts, ends = _words(low, kind, offsets)
        unique, first, inverse = np.unique(K.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != unique[inside]
        if new.any():
            raw = low.tobytes()
            self._learn(unique[new], [raw[starts[i] : ends[i]] for i in first[new]])
            place = np.searchsorted(self.keys, unique)
        word = place[inverse]
        length = self.length[word]
        total = np.zeros(len(word) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = self.pool[np.repeat(self.at[word] - total[:-1], length) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text; a null is empty."""
        out: list[np.ndarray] = []
        odd = pc.fill_null(pc.match_substring(column, self.special[0]), False) if self.special else None
        for s in self.special[1:]:
            odd = pc.or_(odd, pc.fill_null(pc.match_substring(column, s), False))
        odd = np.zeros(len(column), bool) if odd is None else odd.to_numpy(zero_copy_only=False)
        for a, b, data, offsets in K.text_pieces(column):
            low, kind = _classes(data)
            whole = odd[a:b] | (K.sums_by_text(kind == _FOREIGN, offsets) > 0)
            if whole.any():
                kind[np.repeat(whole, np.diff(offsets))] = _SPACE
            ids, at = self._fast(data, offsets, low, kind)
            for i in range(b - a):
                if whole[i]:
                    out.append(np.asarray(self.tokenizer.encode(column[a + i].as_py(), add_special_tokens=False).ids, np.uint32))
                else:
                    out.append(ids[at[i] : at[i + 1]])
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each process, so that its words serve all tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
