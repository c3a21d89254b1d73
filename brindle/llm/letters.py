"""Letters folded to 32 classes, and the words, spellings and letter n-grams of a batch of texts."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa

from .textkit import U64, hash_ranges, mix64, utf8_of

ORDER = 4
BITS = 5
CLASSES = 1 << BITS

#: Sets the hash of a word with running capitals apart.
LOUD = U64(0x9E6C63D0876A9A47)

SPACE, OTHER_LETTER, DIGIT, POINT, SYMBOL, CAPITAL = 0, 27, 28, 29, 30, 31


#: Scripts of thousands of letters: Han, Yi, Hangul and all beyond the first plane. Their letters are spelled with three classes.
MANY_LETTERS = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48c\uac00-\ud7a3\uf900-\ufaff\U00010000-\U0010ffff]")
LETTERS = 26
#: Below this, letters that don't fold to a-z are of one class.
OTHER_SCRIPTS = 0x370


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point: letters a-z without case and accents, and a few kinds of others.

    The letters and vowel signs of other scripts share the classes of a-z, those next to each other in an alphabet
    having different ones.
    """
    table = np.full(0x110000, SYMBOL, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            base = unicodedata.normalize("NFKD", chr(c))[0].lower()
            if len(base) == 1 and "a" <= base <= "z":
                table[c] = ord(base) - 96
            else:
                table[c] = OTHER_LETTER if c < OTHER_SCRIPTS else 1 + ord(base[0]) % LETTERS
        elif kind[0] == "N":
            table[c] = DIGIT
        elif kind[0] in "ZC":
            table[c] = SPACE
        elif kind[0] == "M":
            spacing = c >= OTHER_SCRIPTS and not unicodedata.name(chr(c), "COMBINING").startswith(("COMBINING", "VARIATION"))
            table[c] = 1 + c % LETTERS if spacing else OTHER_LETTER
    for c in ".,;:'\"-()?’“”":
        table[ord(c)] = POINT
    return table


class _Spelling(dict):
    """A word of three letters a-z for each letter of a script of thousands, made when first met."""

    def __missing__(self, c: int) -> str | int:
        got = c
        if unicodedata.category(chr(c))[0] == "L" and MANY_LETTERS.match(chr(c)):
            base = ord(unicodedata.normalize("NFC", chr(c))[0])
            plain = unicodedata.normalize("NFKD", chr(c))[0].lower()
            if not "a" <= plain <= "z":
                got = f" {''.join(chr(97 + base // LETTERS**k % LETTERS) for k in (2, 1, 0))} "
        self[c] = got
        return got


_SPELLING = _Spelling()


def spelled(texts: pa.Array) -> pa.Array:
    """The texts with each letter of a large script spelled out as a word of its own."""
    listed = texts.to_pylist()
    met = [i for i, t in enumerate(listed) if t and MANY_LETTERS.search(t)]
    if not met:
        return texts
    for i in met:
        listed[i] = listed[i].translate(_SPELLING)
    return pa.array(listed, pa.string())


def kinds_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of every code point, whether it is a capital after a capital, and for n rows the n + 1 points at which rows begin."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    rows = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    kinds = table[points]
    run = (points - 65 < 26) | ((points >= 0xC0) & (points < 0xDF))
    run[1:] &= run[:-1].copy()
    if len(run):
        run[0] = False
    run[rows[:-1][np.diff(rows) > 0]] = False
    return kinds, run, rows


class Words:
    """The words of a batch of texts, each text that has any being followed by an empty one, its end.

    ``rows``: for n texts the n + 1 words at which they begin. Words are told apart by
    their classes: runs of letters and digits, and other signs one by one. A word with
    running capitals is another than that without, and is spelled with a sign before it.
    ``ended`` says for a part of one text whether an end follows, words or none.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray, ended: bool | None = None):
        kinds, run, rows = kinds_of(*utf8_of(spelled(texts)), table)
        solid = kinds != SPACE
        joins = solid & (kinds != POINT) & (kinds != SYMBOL)
        joins = joins[1:] & joins[:-1]
        joins[rows[(rows > 0) & (rows < len(kinds))] - 1] = False
        start, stop = solid.copy(), solid.copy()
        start[1:] &= ~joins
        stop[:-1] &= ~joins
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        first = np.searchsorted(starts, rows)
        some = np.diff(first) > 0 if ended is None else np.full(len(rows) - 1, ended)
        after, last = first[1:][some], rows[1:][some]
        self.kinds = kinds
        runs = np.concatenate([[0], np.cumsum(run)])
        self.starts, self.ends = np.insert(starts, after, last), np.insert(ends, after, last)
        self.loud = runs[self.ends] > runs[self.starts]
        self.rows = first + np.concatenate([[0], np.cumsum(some)])

    def hashes(self, salts: np.ndarray) -> np.ndarray:
        """64 bits for each word and its text's salt."""
        return mix64(hash_ranges(self.kinds, self.starts, self.ends) + np.repeat(salts, np.diff(self.rows)) + self.loud * LOUD)

    def spellings(self) -> tuple[np.ndarray, np.ndarray]:
        return spellings(self.kinds, self.starts, self.ends, self.loud)


def spellings(kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, loud: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letter n-grams of each word on its own, its end's included, and the n + 1 n-grams at which words begin."""
    sizes = ends - starts + loud + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
    letters = np.zeros(begin[-1], dtype=np.uint32)
    inner = np.ones(begin[-1], dtype=bool)
    inner[begin[1:] - 1] = False
    letters[inner] = CAPITAL
    own = inner & (place >= np.repeat(loud, sizes))
    letters[own] = kinds[(np.repeat(starts - loud, sizes) + place)[own]]
    codes = letters.copy()
    for back in range(1, ORDER):
        at = np.flatnonzero(place >= back)
        codes[at] |= letters[at - back] << np.uint32(BITS * back)
    return codes, begin


def turned(x: np.ndarray) -> np.ndarray:
    """Words as contexts: their hashes turned by 21 bits."""
    return (x << U64(21)) | (x >> U64(43))
