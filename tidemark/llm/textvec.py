"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from tidemark.llm.common import SPACES

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 2 << 20
_STEP = tuple(np.uint64(x) for x in (
    0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ahead, back = (np.full(n + 1, x % 2**64, np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64)))
    ahead[0] = back[0] = 1
    return np.cumprod(ahead), np.cumprod(back)


@functools.lru_cache(4)
def _letters(breaks: str) -> np.ndarray:
    """Which bytes belong to words."""
    table = np.ones(256, bool)
    table[np.frombuffer(breaks.encode(), np.uint8)] = False
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: np.ndarray, breaks: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a run of bytes.

    A word's hash is the difference of two prefix sums of byte times power, shifted back to power zero.
    """
    inside = _letters(breaks)[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    start, end = edge[::2], edge[1::2]
    n = 1 << max(21, int(len(data)).bit_length())
    ahead, back = _powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ahead[: len(data)])))
    return mix((sums[end] - sums[start]) * back[start]), start


def _pieces(data: bytes, breaks: str) -> Iterator[bytes]:
    """A long text in runs that end at a break, so that no word is cut."""
    at, stops = 0, _letters(breaks)
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            rest = np.frombuffer(data, np.uint8, offset=end)
            for low in range(0, len(rest), _PIECE):
                gap = np.flatnonzero(~stops[rest[low: low + _PIECE]])
                if len(gap):
                    end += low + int(gap[0])
                    break
            else:
                end = len(data)
        yield data[at:end]
        at = end


def word_hashes(texts: list[str | None], breaks: str = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and where each text's words begin (one more entry than texts).

    Words are runs of bytes that are not in ``breaks`` (ASCII characters). Null texts have no words.
    """
    hashes, counts, held, size = [], np.zeros(len(texts), np.int64), [], 0
    gap = breaks[0].encode()

    def take(first: int) -> None:
        data = np.frombuffer(gap.join(held), np.uint8)
        found, start = _hash_words(data, breaks)
        stops = np.cumsum([len(x) + 1 for x in held])
        counts[first: first + len(held)] += np.diff(np.concatenate(([0], np.searchsorted(start, stops))))
        hashes.append(found)

    first = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > _PIECE:
            take(first)
            held, size = [], 0
        if len(data) > _PIECE:
            for piece in _pieces(data, breaks):
                found, _ = _hash_words(np.frombuffer(piece, np.uint8), breaks)
                hashes.append(found)
                counts[i] += len(found)
            first = i + 1
            continue
        if not held:
            first = i
        held.append(data)
        size += len(data) + 1
    if held:
        take(first)
    words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return words, np.concatenate(([0], np.cumsum(counts)))


def grams(words: np.ndarray, starts: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word tuples (i, i + gaps[0], ...) inside each text, and where each text's tuples begin."""
    reach = gaps[-1] if gaps else 0
    counts = np.maximum(np.diff(starts) - reach, 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begin[-1]) + np.repeat(starts[:-1] - begin[:-1], counts)
    out = words[at] * _STEP[0]
    for k, gap in enumerate(gaps, 1):
        out = out + words[at + gap] * _STEP[k % len(_STEP)]
    return mix(out + np.uint64(len(gaps) * 31 + reach)), begin


def shingles(words: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words; a shorter text with words has one shingle, all of it."""
    counts = np.diff(starts)
    found, begin = grams(words, starts, tuple(range(1, size)))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return found, begin
    extra = np.array([_fold(words[starts[i]: starts[i + 1]]) for i in short], np.uint64)
    return np.insert(found, begin[short], extra), begin + np.concatenate(([0], np.cumsum((counts > 0) & (counts < size))))


def _fold(words: np.ndarray) -> np.uint64:
    folded = np.sum(words * np.array(_STEP[: len(words)], np.uint64), dtype=np.uint64, keepdims=True)
    return mix(folded + np.array([len(words)], np.uint64) * _STEP[4])[0]
