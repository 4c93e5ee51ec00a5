"""Whole batches of texts as arrays of folded characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

from talentweave.functions.hanzi import FOLD


#: Characters that are worked on at a time.
AT_ONCE = 1 << 19


def pieces(texts: list[str], most: int = AT_ONCE) -> Iterator[tuple[int, list[str]]]:
    """(number of the first text, texts) in pieces of about ``most`` characters; a longer text is
    a piece of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, texts[start:k]
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


@cache
def folding() -> np.ndarray:
    """For each character below U+10000 its folded form: half width, lower case, simplified; 0 for
    everything that is no letter or digit."""
    table = np.zeros(0x10000, np.uint32)
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        text = unicodedata.normalize("NFKC", chr(code)).lower()
        if text and text[0].isalnum():
            table[code] = ord(str(FOLD.get(ord(text[0]), text[0])))
    return table


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts one behind the other, and where each text ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), sizes.cumsum()


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters and digits of the texts, and where each text ends."""
    raw, ends = codes(texts)
    table = folding()
    plain = np.where(raw < 0x10000, table[np.minimum(raw, 0xFFFF)], raw)
    kept = plain != 0
    before = np.concatenate([[0], kept.cumsum()])
    return plain[kept], before[ends]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer of a hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(chars: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every run of ``size`` characters that lies within one text."""
    if len(chars) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(chars) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + chars[k : k + n].astype(np.uint64)
    keep = np.ones(n, bool)
    for back in range(1, size):
        at = ends[:-1] - back
        keep[at[(at >= 0) & (at < n)]] = False
    places = np.flatnonzero(keep)
    return mixed(h[places]), places
