"""Periodic runs of words by a suffix automaton whose last occurrences are recoloured by link-cut access."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import released, small_batches
from tidemark.llm.textvec import grams, mix, word_hashes


@dataclass(frozen=True)
class RunRules:
    """A run is a longest stretch of words with smallest period q and at least max(``length``, ``power`` * q) words.
    ``power`` is 2 or more. ``narrowings``: how often stretches are narrowed before the automaton reads them."""

    length: int = 6
    power: int = 4
    narrowings: int = 8

    @property
    def gram(self) -> int:
        """The most words of which every tuple inside a run is found twice in it.

        A run of n words with period q has n - k + 1 tuples of k words in q classes of equal ones, so 2q tuples are enough.
        """
        return min(max(self.length, self.power * q) - 2 * q + 1 for q in range(1, self.length + 2))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split takes for white space and the word pattern does not.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of every state, and the state of every prefix. State 0 is the empty word."""
    follow: list[dict[int, int]] = [{}]
    link, length, prefix, last = [-1], [0], [], 0
    for word in words:
        state = len(length)
        length.append(length[last] + 1)
        follow.append({})
        link.append(0)
        at = last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = state
            at = link[at]
        if at >= 0:
            next_ = follow[at][word]
            if length[next_] == length[at] + 1:
                link[state] = next_
            else:
                copy = len(length)
                length.append(length[at] + 1)
                follow.append(follow[next_].copy())
                link.append(link[next_])
                while at >= 0 and follow[at].get(word) == next_:
                    follow[at][word] = copy
                    at = link[at]
                link[next_] = link[state] = copy
        prefix.append(state)
        last = state
    return link, length, prefix


class LastEnds:
    """The tree of suffix links in preferred paths, each a splay tree ordered by depth.

    All states of a path were last reached from the same prefix, whose end is kept at the root of the path's splay tree.
    """

    def __init__(self, link: list[int]):
        self.up = list(link)
        self.low = [-1] * len(link)
        self.high = [-1] * len(link)
        self.end = [-1] * len(link)

    def _splay(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        while True:
            p = up[x]
            if p < 0 or (low[p] != x and high[p] != x):
                return
            g = up[p]
            inner = g >= 0 and (low[g] == p or high[g] == p)
            if inner:
                if (low[g] == p) == (low[p] == x):
                    self._turn(p)
                else:
                    self._turn(x)
                self._turn(x)
            else:
                self._turn(x)

    def _turn(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        p = up[x]
        g = up[p]
        if low[p] == x:
            child = low[p] = high[x]
            high[x] = p
        else:
            child = high[p] = low[x]
            low[x] = p
        if child >= 0:
            up[child] = p
        if g >= 0:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x
        up[p], up[x] = x, g
        self.end[x] = self.end[p]

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``state`` to the root with ``end``; yields (deepest state, previous end) of each segment."""
        up, high, ends = self.up, self.high, self.end
        below, x = -1, state
        while x >= 0:
            self._splay(x)
            was, cut = ends[x], high[x]
            if was >= 0:
                yield x, was
            if cut >= 0:
                ends[cut] = was
            high[x] = below
            below, x = x, up[x]
        self._splay(state)
        ends[state] = end


def repetitions(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of every longest stretch that holds its smallest period at least twice.

    Where a segment's previous end lies within its length, the suffix and its previous occurrence touch: together they
    are a stretch whose smallest period is their distance, since no nearer occurrence exists. It is as long to the left
    as it can be, and is reported at its last word.
    """
    link, length, prefix = suffix_automaton(words)
    tree, count = LastEnds(link), len(words)
    for i, state in enumerate(prefix):
        for deepest, end in tree.access(state, i):
            period = i - end
            if period <= length[deepest] and (i + 1 == count or words[i + 1] != words[i + 1 - period]):
                yield end - length[deepest] + 1, length[deepest] + period, period


def stretches(hashes: np.ndarray, starts: np.ndarray, rules: RunRules) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (in ``hashes``) of the stretches that can hold runs.

    Every tuple of ``rules.gram`` words in a run recurs in that run, so a run lies where such tuples follow one another
    that all recur in their text, then in their stretch, and so on. Equal words have equal hashes: no run is missed.
    """
    found, begin = grams(hashes, starts, tuple(range(1, rules.gram)))
    counts = np.diff(begin)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(found)) + np.repeat(starts[:-1] - begin[:-1], counts)
    for _ in range(rules.narrowings):
        if not len(at):
            break
        key = mix(found + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | ~again[:-1]
        whole = again.all()
        owner = np.cumsum(new)[again]
        at, found = at[again], found[again]
        if whole:
            break
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1] + rules.gram - 1
    long = last - first + 1 >= rules.length
    return first[long], last[long]


def runs_of(words: list[str], low: int, rules: RunRules) -> list[tuple[int, int, int]]:
    """The runs of a stretch whose first word is number ``low``."""
    numbers: dict[str, int] = {}
    coded = [numbers.setdefault(w, len(numbers)) for w in words]
    return [(low + s, n, q) for s, n, q in repetitions(coded) if n >= max(rules.length, rules.power * q)]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame, rules: RunRules = RunRules(),
         order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row.

    docs: doc_id, text; other columns are not read. Words are runs of other characters than ASCII white space; the
    collapsed text joins the words that no run contains after its first period by one space. ``order`` may give, for an
    id and a number of words, which word stands at each place instead. Null, empty and blank texts have no words, no runs
    and an empty text; repeated rows each give theirs; null ids stay null. Whole texts are read; no shuffle. A task holds
    a batch of texts, and an automaton of at most two states a word for the stretch it reads.
    """
    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            hashes, starts = word_hashes(texts)
            counts, moved = np.diff(starts), {}
            if order:
                hashes = hashes.copy()
                for i, doc_id in enumerate(ids):
                    places = order(doc_id, int(counts[i]))
                    if places is not None:
                        moved[i] = places
                        hashes[starts[i]: starts[i + 1]] = hashes[starts[i]: starts[i + 1]][places]
            first, last = stretches(hashes, starts, rules)
            of = np.searchsorted(starts, first, side="right") - 1
            found, out = [[] for _ in ids], []
            bounds = np.searchsorted(of, np.arange(len(ids) + 1))
            for i, text in enumerate(texts):
                words = words_of(text)
                if i in moved:
                    words = [words[k] for k in moved[i]]
                for k in range(bounds[i], bounds[i + 1]):
                    low, high = int(first[k] - starts[i]), int(last[k] - starts[i])
                    found[i].extend(runs_of(words[low: high + 1], low, rules))
                found[i].sort(key=lambda x: (x[0], x[2]))
                out.append(" ".join(collapsed(words, found[i])))
            flat = np.array([x for runs in found for x in runs], np.int64).reshape(-1, 3)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            runs = pa.ListArray.from_arrays(
                pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), runs, pa.array(out, pa.string())],
                ["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        released(run), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
