"""Word shingles of texts as numbers, for whole batches at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from areal_exposure.llm.common import utf8

WORDS = 5
_CUT = 1 << 21
_DOCS = 4096  # fit in the bits above a shingle's 52
_MASK = np.uint64((1 << 52) - 1)

#: Blocks of scripts written without blanks between words; each letter counts as a word.
_UNSPACED = (
    (0x0E00, 0x0EFF),  # Thai, Lao
    (0x1000, 0x109F),  # Myanmar
    (0x1780, 0x17FF),  # Khmer
    (0x3005, 0x3007),  # ideographic signs
    (0x3041, 0x30FF),  # Hiragana, Katakana
    (0x3400, 0x4DBF),  # ideographs
    (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF),
    (0x20000, 0x323AF),
)
_APART = np.ones(256, dtype=bool)  # all of ASCII but letters and digits; see plain_words for what is beyond ASCII
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False
_rng = np.random.Generator(np.random.PCG64(7))
_PLACE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TURN = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


@cache
def _kinds() -> np.ndarray:
    """For each code point: 0 apart from words, 1 part of a word, 2 a mark, 3 a word of its own."""
    major = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    held = np.frombuffer(major.encode(), np.uint8)
    kinds = np.select([held == ord("M"), (held == ord("L")) | (held == ord("N"))], [2, 1], 0).astype(np.uint8)
    for low, high in _UNSPACED:
        own = kinds[low : high + 1]
        own[own == 1] = 3
    return kinds


def _plain(text: str) -> str:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[code]
    code = np.where((kind == 0) & (code > 127), 32, code)
    if (kind == 3).any():
        own = np.maximum.accumulate(np.where(kind != 2, np.arange(len(kind)), 0))  # a mark belongs to what it follows
        after = np.concatenate([[False], kind[own[:-1]] == 3]) & (kind != 2)
        code = np.insert(code, np.flatnonzero((kind == 3) | after), 32)
    return code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def plain_words(texts: pa.Array) -> pa.Array:
    """The texts with blanks for what is beyond ASCII and no letter, mark or number, and around unspaced characters."""
    data, at = utf8(texts)
    beyond = np.concatenate([[0], np.cumsum(data > 127)])
    odd = np.flatnonzero(np.diff(beyond[at])) if len(texts) else np.zeros(0, np.int64)
    if not len(odd):
        return texts
    # One pass over all such texts, with a mark between them that stays as it is.
    joined = "\x00".join(t.replace("\x00", " ") for t in texts.take(pa.array(odd)).to_pylist())
    out = texts.to_pylist()
    for k, text in zip(odd.tolist(), _plain(joined).split("\x00"), strict=True):
        out[k] = text
    return pa.array(out, pa.large_string())


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(apart: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``_CUT`` bytes that don't cut a word."""
    a = 0
    while a < len(apart):
        b = min(len(apart), a + _CUT)
        while b < len(apart) and not apart[b - 1]:
            more = np.flatnonzero(apart[b : b + _CUT])
            b = b + int(more[0]) + 1 if len(more) else min(len(apart), b + _CUT)
        yield a, b
        a = b


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the (lower-cased) texts in turn, and the text each stands in."""
    data, at = utf8(plain_words(texts))
    firsts = np.zeros(len(data) + 1, dtype=bool)
    firsts[at] = True
    numbers, homes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _slices(_APART[data]):
        held = data[a:b]
        apart = _APART[held]
        new = ~apart & np.concatenate([[True], apart[:-1]]) | ~apart & firsts[a:b]
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        sizes = np.diff(np.append(starts, b - a))
        place = np.arange(starts[0], b - a) - np.repeat(starts, sizes)
        value = (held[starts[0] :].astype(np.uint64) + np.uint64(1)) * _PLACE[place & 255]
        value[apart[starts[0] :]] = 0
        numbers.append(mixed(np.add.reduceat(value, starts - starts[0])))
        homes.append(np.searchsorted(at, starts + a, "right") - 1)
    return np.concatenate(numbers), np.concatenate(homes)


def shingles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the first text's place, and text (from it), shingle and count of each distinct shingle.

    A shingle is five words in a row; a text of fewer words has one of them all, a text without words none.
    """
    number, home = words(texts)
    many = np.bincount(home, minlength=len(texts))
    ends = np.cumsum(many)
    # Runs of at most _DOCS texts and about a million words.
    i = 0
    while i < len(texts):
        before = ends[i] - many[i]
        j = int(np.searchsorted(ends, before + (1 << 20), "right"))
        j = min(max(j, i + 1), i + _DOCS, len(texts))
        w, h, n = number[before : ends[j - 1]], home[before : ends[j - 1]] - i, many[i:j]
        total = np.zeros(len(w), np.uint64)
        for k in range(WORDS):
            inside = np.zeros(len(w), dtype=bool)
            inside[: len(w) - k] = h[k:] == h[: len(h) - k] if k else True
            total[: len(w) - k] += np.where(inside[: len(w) - k], w[k:] * _TURN[k], 0).astype(np.uint64)
        starts = np.cumsum(n) - n
        nth = np.arange(len(w)) - starts[h]
        full = nth < np.maximum(1, n[h] - WORDS + 1)
        key = np.sort(h[full].astype(np.uint64) << np.uint64(52) | mixed(total[full]) & _MASK)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        yield i, (key[first] >> np.uint64(52)).astype(np.int64), key[first] & _MASK, np.diff(np.append(first, len(key)))
        i = j


def sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    for first, home, shingle, _ in shingles(texts):
        present, at = np.unique(home, return_index=True)
        for k, own in zip(present, np.split(shingle, at[1:]), strict=True) if len(present) else ():
            out[first + k] = own
    return out


def jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Share of common distinct shingles of each pair of texts; 0 where neither has words."""
    out = np.zeros(len(left))
    for k, (a, b) in enumerate(zip(sets(left), sets(right), strict=True)):
        common = len(np.intersect1d(a, b, assume_unique=True))
        out[k] = common / max(1, len(a) + len(b) - common)
    return out
