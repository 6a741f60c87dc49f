"""The learned operators against plain loops, and the bounds of their samples."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import char_tagger, toxicity


def plain_ftrl(rows, labels, plan):
    """One coordinate at a time, sums in dictionaries; the bias is a coordinate without penalty."""
    z, n = {}, {}

    def weight(key):
        free = 0.0 if key == "bias" else plan.l1
        total = z.get(key, 0.0)
        if abs(total) <= free:
            return 0.0
        return -(total - math.copysign(free, total)) / ((plan.beta + math.sqrt(n.get(key, 0.0))) / plan.alpha + plan.l2)

    for turn in range(plan.passes):
        for i in np.random.default_rng([plan.seed, turn]).permutation(len(rows)):
            keys = [*rows[i], "bias"]
            held = {k: weight(k) for k in keys}
            gap = 1 / (1 + math.exp(-sum(held.values()))) - labels[i]
            for k in keys:
                rate = (math.sqrt(n.get(k, 0.0) + gap * gap) - math.sqrt(n.get(k, 0.0))) / plan.alpha
                z[k] = z.get(k, 0.0) + gap - rate * held[k]
                n[k] = n.get(k, 0.0) + gap * gap
    return {k: weight(k) for k in z if k != "bias" and abs(z[k]) > plan.l1}, weight("bias")


def test_ftrl_equals_a_plain_loop():
    draw, plan = random.Random(7), toxicity.Ftrl(bits=6, l1=0.8, passes=3)
    rows = [sorted(draw.sample(range(64), draw.randint(0, 12))) for _ in range(60)]
    labels = [float(7 in r or draw.random() < 0.1) for r in rows]
    begin = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    got = toxicity.fit(np.array(sum(rows, []), np.int32), begin, np.array(labels), plan)
    want, bias = plain_ftrl(rows, labels, plan)
    assert 0 < len(want) < 64 and set(got.slots.tolist()) == set(want)
    assert got.values.tolist() == pytest.approx([want[s] for s in got.slots.tolist()])
    assert got.bias == pytest.approx(bias)


def test_toxicity_sample_is_bounded_by_slots(spark):
    draw = random.Random(2)
    docs = [(i, " ".join(draw.choices("abcdefghij", k=draw.choice([0, 5, 40])))) for i in range(90)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i, _ in docs], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    order = [r.doc_id for r in frame.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    sizes = {i: len(toxicity.distinct_slots([t], 12)[0]) for i, t in docs}
    total = list(itertools.accumulate(sizes[i] for i in order))
    limit = total[40]
    first = set(order[: sum(t <= limit for t in total)])
    plan = {"bits": 12, "l1": 0.5}
    got = toxicity.learn(frame, labels, F.lit(True), toxicity.Ftrl(slots=limit, **plan))
    want = toxicity.learn(frame.filter(F.col("doc_id").isin(*first)), labels, F.lit(True), toxicity.Ftrl(**plan))
    whole = toxicity.learn(frame, labels, F.lit(True), toxicity.Ftrl(**plan))
    assert 40 < len(first) < 90 and len(want.slots)
    assert got.slots.tolist() == want.slots.tolist() and got.values.tolist() == want.values.tolist() and got.bias == want.bias
    assert got.values.tolist() != whole.values.tolist()
    none = toxicity.learn(frame, labels, F.lit(True), toxicity.Ftrl(slots=0, **plan))
    assert len(none.slots) == 0


def test_decoding_is_the_best_of_all_sequences():
    p = {k: v.astype(float) for k, v in char_tagger.start_parameters(3, char_tagger.Training(hidden=4, embedding=5)).items()}
    draw = np.random.default_rng(5)
    for name in ("first", "moves", "last"):
        p[name] = draw.standard_normal(p[name].shape)
    ids = draw.integers(0, 12, (8, 6))
    score = char_tagger.emissions(p, ids)
    for window, got in zip(score, char_tagger.decode(p, ids)):
        worth = {
            tags: p["first"][tags[0]] + p["last"][tags[-1]] + sum(window[t, k] for t, k in enumerate(tags))
            + sum(p["moves"][a, b] for a, b in itertools.pairwise(tags))
            for tags in itertools.product(range(window.shape[1]), repeat=6)
        }
        assert tuple(got.tolist()) == max(worth, key=worth.get)
