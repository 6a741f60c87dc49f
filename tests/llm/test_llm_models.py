"""WARC, joins, search and classifiers: edge cases and brute-force comparison."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import graph, ngram_join, one_bit_search, quality_trees, toxicity, warc
from tidemark.llm.textvec import grams, shingles, word_hashes
from pyspark.sql import functions as F


def test_word_hashes_and_shingles():
    texts = ["a b  a\n", "", None, "x a b c d e f", "é ü"]
    words, starts = word_hashes(texts)
    assert np.diff(starts).tolist() == [3, 0, 0, 7, 2] and words[0] == words[2] == words[4]
    found, begin = shingles(words, starts)
    assert np.diff(begin).tolist() == [1, 0, 0, 3, 1] and len(set(found.tolist())) == 5
    pairs, begin = grams(words, starts, (1,))
    assert np.diff(begin).tolist() == [2, 0, 0, 6, 1]


def plain_join(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    links = {s: {t for t in set(sets) if t and s and t != s and len(s & t) >= threshold * len(s | t)} for s in set(sets)}
    out = []
    for (i, _), s in zip(rows, sets):
        if s is None:
            out.append((i, i, i, 0))
            continue
        group, todo = {s}, [s]
        while todo:
            for t in links[todo.pop()] - group:
                group.add(t)
                todo.append(t)
        ids = lambda g: min((j for (j, _), t in zip(rows, sets) if t in g and j is not None), default=None)
        out.append((i, ids(group), ids({s}), len(links[s])))
    return sorted(out, key=str)


def near_copies(seed=0, groups=8):
    draw, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([3, 6, 40, 120]))]
        for _ in range(draw.randint(1, 12)):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = f"n{draw.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "  "), (903, rows[0][1]), (903, rows[0][1]), (None, rows[3][1] + " end")]


@pytest.mark.parametrize("block", [1024, 8])
def test_join_equals_brute_force(spark, block):
    rows = near_copies()
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_links int, key string")
    got = ngram_join.join(frame, ngram_join.JaccardJoin(block=block)).select("doc_id", "class_id", "copy_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == plain_join(rows)
    kept = ngram_join.one_of_each(frame).collect()
    classes = {c for i, c, _, _ in plain_join(rows)}
    assert sorted(r.doc_id for r in kept) == sorted(c for c in classes if c is not None)


def test_join_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = ngram_join.join(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {tuple(r) for r in alone} == {(1, 1, 1, 0), (2, 2, 2, 0)}


def test_pruning_keeps_true_pairs():
    plan, draw = ngram_join.JaccardJoin(), np.random.default_rng(1)
    sets = [draw.integers(0, 2**63, 400).astype(np.uint64) for _ in range(30)]
    sets += [np.concatenate((s[:380], draw.integers(0, 2**63, 20).astype(np.uint64))) for s in sets]
    begin = np.arange(61) * 400
    sign = ngram_join.signatures(np.concatenate(sets), begin, plan)
    likely = ngram_join.surviving(sign, sign, plan)
    assert all(likely[i, i + 30] for i in range(30)) and likely.sum() < 150
    common = ngram_join.overlaps([np.unique(s) for s in sets[:30]], [np.unique(s) for s in sets[30:]])
    assert np.allclose(np.diag(common), 380) and common.sum() == 30 * 380


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (7, 7), (60, 61)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(51)) and got[200] == got[100] == 100 and got[61] == 60
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_search_against_brute_force(spark):
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((700, 24)).astype(np.float32)
    vectors[50:90] = vectors[3]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(vectors)]
    odd = [(1000, None, "s"), (1050, [], "s"), (1100, [0.0] * 24, "s"), (1150, [float("nan")] + [1.0] * 23, "s"),
           (1200, [None] + [1.0] * 23, "s"), (1250, [1.0, 2.0], "s"), (None, [1.0] * 24, "s"), (650, vectors[650].tolist(), "s")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = one_bit_search.search(frame, frame.filter(F.col("vec_id") % 50 == 0), "vec_id", "embedding", one_bit_search.Search(chunk=100)).collect()
    wide = vectors.astype(float)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 700, 50):
        cos = unit @ unit[q]
        cos[q] = -9
        best = np.lexsort((np.arange(700), -np.round(cos, 12)))[:5].tolist()
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5]
        hit += len({i for _, i in mine} & set(best))
    assert hit >= 0.9 * 5 * 14
    assert not [r for r in got if r.query_id > 700]
    assert one_bit_search.search(frame.limit(0), frame.limit(0), "vec_id", "embedding").count() == 0


def test_fewer_candidates_than_asked(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<float>")
    got = one_bit_search.search(frame, frame.filter("vec_id = 0"), "vec_id", "embedding").collect()
    assert [(r.rank, r.vec_id) for r in sorted(got)] == [(1, 1), (2, 2)] and got[0].score == got[1].score


def test_warc_round_trip(spark):
    long, longer = "é" * 600, "<p>x</p>" * 400
    rows = [(1, "http://a/é b", long), (2, None, long), (2, None, long), (9, "u", longer), (4, "u", longer), (5, "u", "short"), (6, "u", "short"),
            (7, "u", None), (8, "u", ""), (None, "u", longer), (10, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    got = warc.deduplicate(pages).collect()
    assert len(got) == len(rows)
    text = {i: h or "" for i, _, h in rows}
    for r in got:
        payload = text[r.page_id].encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "revisit", 2), ("2", "revisit", 2), ("2", "response", None), ("9", "response", None), ("4", "revisit", 9),
                            ("5", "response", None), ("6", "response", None), ("7", "response", None), ("8", "response", None),
                            ("None", "revisit", 9), ("10", "response", None)])
    assert warc.deduplicate(pages.limit(0)).count() == 0


def labelled(spark, bad, good, label):
    draw, rows = random.Random(5), []
    for i in range(600):
        words = draw.choices(["the", "of", "and", "thing", "rest", "ering", "hand"], k=draw.randint(5, 60))
        flag = i % 4 == 0
        rows.append((i, (bad if flag else good)(words, draw), int(flag)))
    docs = spark.createDataFrame([(i, t, 3, "z") for i, t, _ in rows] + [(1000, None, 3, "z"), (1001, "", 3, "z"), (1001, "", 3, "z"), (None, "of the", 3, "z")],
                                 "doc_id long, text string, predicted int, stats string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], f"doc_id long, {label} int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_held_out(spark):
    docs, labels, truth = labelled(
        spark, lambda w, d: " ".join([*w[:3], "Vile,", *w[3:], "nasty"]), lambda w, d: " ".join(w), "toxic")
    weights = toxicity.learn(docs, labels, F.col("doc_id") % 3 != 1)
    out = toxicity.score(docs, weights).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.doc_id in truth and r.doc_id % 3 == 1]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len(weights.slots) < 2000
    nothing = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs, nothing).filter("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), weights).count() == 0


def test_quality_held_out(spark):
    docs, labels, truth = labelled(
        spark, lambda w, d: " ".join(w) + ".", lambda w, d: " ".join(x + d.choice(["###", "***"]) for x in w), "quality")
    trees = quality_trees.learn(docs, labels, F.col("doc_id") % 5 != 0)
    out = quality_trees.score(docs, trees).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.doc_id in truth and r.doc_id % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    nothing = quality_trees.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_trees.score(docs, nothing).select("score").distinct().collect()} == {0.5}
    assert quality_trees.score(docs.limit(0), trees).count() == 0


def test_flat_trees_equal_a_walk():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((500, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    trees = quality_trees.fit(x, y, quality_trees.Boosting(trees=30))
    got = trees.score(x)
    for row, want in zip(x[:40], got):
        raw = trees.start
        for t in range(30):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + (2 if row[trees.feature[t, node]] > trees.above[t, node] else 1)
            raw += trees.leaf[t, node - trees.feature.shape[1]]
        assert 1 / (1 + np.exp(-raw)) == pytest.approx(want)
    assert ((got > 0.5) == y).mean() > 0.97
