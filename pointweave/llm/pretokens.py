"""Encoding of whole texts through bounded caches of words and pre-tokens.

A byte-level BPE tokenizer first cuts a text by a pattern and encodes each
match by itself.  Words recur, so each distinct word between two spaces is
cut and encoded once and looked up afterwards; the result is what encoding
the whole text gives.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: All characters that count as white space for Python or in a pattern's \s.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_AFTER_SPACE = tuple(" " + c for c in WHITE)
#: The same, and a space at the end, for Arrow.
_UNSURE = " (?:[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + r"]|\z)"


class _Cache(dict):
    """A dict that fills itself and holds at most twice ``most`` keys.

    When it is full it becomes the older generation and starts anew; keys that
    are asked for again move over, so frequent ones stay.
    """

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def words(text: str) -> list[str]:
    """``text`` cut before spaces, each but the first without its space.

    No match of the pattern crosses a cut: a match holds a space before other
    characters only at its start, and a run of white space is matched but for
    its last character when more text follows.  So a cut before a space is
    right if a character that is not white space stands before or after the
    space; other spaces stay inside a word.
    """
    parts = text.split(" ")
    if not (text.endswith(" ") or any(x in text for x in _AFTER_SPACE)):
        return parts
    out, now = [], parts[0]
    for p in parts[1:]:
        if (now and not now[-1].isspace()) or (p and not p[0].isspace()):
            out.append(now)
            now = p
        else:
            now += " " + p
    return [*out, now]


#: Characters that are neither letters, digits, white space nor an apostrophe.
_MARKS = ".,;:!?%&#$*|()"


class PretokenEncoder:
    """Encodes texts to little-endian unsigned 16-bit ids.

    ``encode_pretoken`` gives the ids of one match of ``pattern`` as such
    bytes.  ``most`` bounds the keys of a cache's generation, and so the memory.
    """

    def __init__(self, pattern: str, encode_pretoken: Callable[[str], bytes], most: int):
        self.find = regex.compile(pattern).findall
        self.encode_pretoken = encode_pretoken
        self.bare = _Cache(encode_pretoken, most // 4)
        self.word = _Cache(self._word, most)

    def _word(self, w: str) -> bytes:
        """The ids of a space and ``w``."""
        if w.isalpha():
            return self.encode_pretoken(" " + w)
        stem = w.rstrip(_MARKS)
        if len(stem) < len(w) and stem.isalpha():
            return self.word[stem] + self.bare[w[len(stem) :]]
        return self._cut(" " + w)

    def _cut(self, text: str) -> bytes:
        parts = self.find(text)
        if len(parts) == 1:
            return self.encode_pretoken(text)
        return b"".join([self.word[x[1:]] if x[0] == " " else self.bare[x] for x in parts])

    def encode(self, text: str) -> bytes:
        first, *rest = words(text)
        found = list(map(self.word.get, rest))
        if None in found:
            found = [self.word[w] if x is None else x for w, x in zip(rest, found, strict=True)]
        return self._cut(first) + b"".join(found)

    def encode_all(self, texts: pa.Array, apart: dict[int, bytes]) -> list[np.ndarray]:
        """The ids of each of ``texts``, which holds no nulls; those in ``apart``, by place, are given.

        Arrow cuts the texts and numbers their distinct words, so that a word
        is looked up once however often it occurs; the ids are then put
        together by these numbers.  Texts in which not every space is a cut
        (see ``words``) are encoded one by one.
        """
        if not len(texts):
            return []
        unsure = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False)
        apart = {i: self.encode(texts[i].as_py()) for i in np.flatnonzero(unsure).tolist() if i not in apart} | apart
        unsure[list(apart)] = True
        cut = pc.split_pattern(pc.if_else(pa.array(unsure), "", texts), " ")
        found = cut.flatten().dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = np.cumsum([0, *pc.list_value_length(cut).to_numpy()[:-1]])
        # what a text begins with has no space before it and so a number of its own
        begin = pc.list_element(cut, 0).to_pylist()
        number = found.indices.to_numpy().copy()
        number[firsts] = len(words) + np.arange(len(begin))

        own = list(map(self._word_with_marks, words))
        own += [apart[i] if i in apart else self._cut(t) for i, t in enumerate(begin)]
        n = np.fromiter(map(len, own), np.int64, len(own)) // 2
        size = n[number]
        before = np.cumsum(size) - size
        at = np.repeat((np.cumsum(n) - n)[number] - before, size)
        at += np.arange(len(at))
        return np.split(np.frombuffer(b"".join(own), "<u2")[at], before[firsts[1:]])

    def _word_with_marks(self, w: str) -> bytes:
        """As ``word``, but a word with marks after it is not kept itself: letters and marks are never one match."""
        stem = w.rstrip(_MARKS)
        if len(stem) < len(w) and stem[-1:].isalpha():
            return self.word[stem] + self.bare[w[len(stem) :]]
        return self.word[w]
