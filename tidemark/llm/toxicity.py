"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACES, released, small_batches, training_rows
from tidemark.llm.textvec import grams, word_hashes

#: White space and ASCII punctuation part words.
BREAKS = SPACES + "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Ftrl:
    """``rows`` and ``slots``: learned from are the labelled rows with the smallest hashes of their ids, at most so many of
    them, and those before the first with which their texts would have more distinct slots together (4 bytes each)."""

    rows: int = 20000
    slots: int = 1 << 26
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    passes: int = 4
    seed: int = 11


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each text's words, word pairs and pairs with one word between; where each text's slots begin."""
    words, starts = word_hashes([t and t.lower() for t in texts], BREAKS)
    kinds = [grams(words, starts, gaps) for gaps in ((), (1,), (2,))]
    shift = np.uint64(64 - bits)
    counts = [np.diff(begin) for _, begin in kinds]
    total = np.concatenate(([0], np.cumsum(sum(counts))))
    out, before = np.empty(total[-1], np.int64), total[:-1].copy()
    for (found, begin), count in zip(kinds, counts):
        out[np.arange(len(found)) + np.repeat(before - begin[:-1], count)] = (found >> shift).astype(np.int64)
        before += count
    return out, total


@dataclass(frozen=True)
class Weights:
    """The slots with a weight, and the bias."""

    slots: np.ndarray
    values: np.ndarray
    bias: float
    bits: int

    def score(self, texts: list[str | None]) -> np.ndarray:
        table = _dense(self.slots.tobytes(), self.values.tobytes(), self.bits)
        slots, begin = features(texts, self.bits)
        worth = table[slots]
        hit = np.flatnonzero(worth)
        text = np.searchsorted(begin, hit, side="right") - 1
        # a text's slot counts once, however often it occurs
        once = np.unique(np.stack((text, slots[hit])), axis=1) if len(hit) else np.empty((2, 0), np.int64)
        total = np.bincount(once[0], table[once[1]], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


@functools.lru_cache(2)
def _dense(slots: bytes, values: bytes, bits: int) -> np.ndarray:
    table = np.zeros(1 << bits)
    table[np.frombuffer(slots, np.int64)] = np.frombuffer(values, np.float64)
    return table


def distinct_slots(texts: list[str | None], bits: int) -> list[np.ndarray]:
    slots, begin = features(texts, bits)
    return [np.unique(slots[begin[i]: begin[i + 1]]).astype(np.int32) for i in range(len(texts))]


def fit(slots: np.ndarray, begin: np.ndarray, labels: np.ndarray, plan: Ftrl = Ftrl()) -> Weights:
    """One weight per slot: each has its own rate, from the squares of its gradients, and is zero until the sum of its
    gradients outweighs ``l1``. slots: the distinct slots of all texts one after another, text i's from begin[i] on. The
    bias is a weight without a penalty that every text has."""
    z, n = np.zeros(1 << plan.bits), np.zeros(1 << plan.bits)
    bias_z = bias_n = 0.0

    def weight(z, n, free):
        w = -(z - np.sign(z) * free) / ((plan.beta + np.sqrt(n)) / plan.alpha + plan.l2)
        return np.where(np.abs(z) <= free, 0.0, w)

    for turn in range(plan.passes):
        for i in np.random.default_rng([plan.seed, turn]).permutation(len(labels)):
            at = slots[begin[i]: begin[i + 1]]
            w, bias = weight(z[at], n[at], plan.l1), float(weight(bias_z, bias_n, 0.0))
            gap = float(1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[i])
            root, new = np.sqrt(n[at]), np.sqrt(n[at] + gap * gap)
            z[at] += gap - (new - root) / plan.alpha * w
            n[at] += gap * gap
            bias_z += gap - (np.sqrt(bias_n + gap * gap) - np.sqrt(bias_n)) / plan.alpha * bias
            bias_n += gap * gap
    every = np.flatnonzero(np.abs(z) > plan.l1)
    return Weights(every, weight(z[every], n[every], plan.l1), float(weight(bias_z, bias_n, 0.0)), plan.bits)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, plan: Ftrl = Ftrl()) -> Weights:
    """Weights from the labelled documents that ``allowed`` admits; without any, all weights are zero. Whole texts are read;
    what a task holds is bounded by ``plan.slots``, and no text has more than 2**bits distinct slots."""
    rows = training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), "toxic", allowed, plan.rows)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [x.tobytes() for x in distinct_slots(batch.column("text").to_pylist(), plan.bits)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(slots, pa.binary())], ["doc_id", "label", "slots"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, labels, room = [], [], [], plan.slots
        for batch in batches:
            for doc_id, label, slots in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "slots"))):
                room -= len(slots) // 4
                if room >= 0:
                    ids.append(doc_id)
                    labels.append(label)
                    found.append(np.frombuffer(slots, np.int32))
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        begin = np.concatenate(([0], np.cumsum([len(found[i]) for i in order], dtype=np.int64)))
        every = np.concatenate([found[i] for i in order]) if found else np.empty(0, np.int32)
        weights = fit(every, begin, np.array(labels, float)[order], plan)
        yield pa.RecordBatch.from_pydict({"slots": [weights.slots.tobytes()], "values": [weights.values.tobytes()], "bias": [weights.bias]})

    # One task learns from the bounded sample; only the weights come to the driver.
    sample = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(released(run), "doc_id long, label double, slots binary")
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "slots")
    found = ordered.mapInArrow(released(train), "slots binary, values binary, bias double").first()
    if found is None:
        return Weights(np.empty(0, np.int64), np.empty(0), 0.0, plan.bits)
    return Weights(np.frombuffer(found["slots"], np.int64), np.frombuffer(found["values"], np.float64), found["bias"], plan.bits)


def score(docs: DataFrame, weights: Weights, threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= threshold).

    The whole text is read; null and empty texts have no words and score by the bias alone. Repeated rows score alike.
    All columns stay, but a column named score or predicted is replaced. No shuffle.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = weights.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                [*kept, "score", "predicted"])

    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*kept).mapInArrow(released(run), schema)
