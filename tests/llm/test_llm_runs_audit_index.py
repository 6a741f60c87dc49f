"""Periodic runs, the filter audit and the multi-index: brute force, odd inputs, repeated rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidemark.llm import filter_audit, multi_index, periodic_runs, queries
from tidemark.llm.common import join_by_size

DOCS = "doc_id long, text string, lang string, runs string, n long, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 3, "y") for i, t, lang in rows], DOCS)


def plain_runs(words, length=6, power=4):
    """All longest stretches by comparing words q apart, each with its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in best.items() if m >= max(length, power * q))


def noisy(draw, letters, parts):
    out = []
    for _ in range(parts):
        block = [draw.choice(letters) for _ in range(draw.randint(1, 6))]
        out += block * draw.choice([1, 1, 2, 4, 5, 9]) + block[: draw.randint(0, len(block))]
    return out


def test_repetitions_are_all_squares_extended():
    draw = random.Random(3)
    for trial in range(300):
        words = [draw.randrange(draw.choice([1, 2, 3])) for _ in range(draw.randint(0, 40))]
        got = sorted(periodic_runs.repetitions(words))
        assert got == plain_runs(words, 2, 2), words


def test_gram_is_the_longest_that_must_recur():
    assert periodic_runs.RunRules().gram == 5
    assert periodic_runs.RunRules(length=2, power=2).gram == 1
    for length, power in itertools.product(range(2, 12), range(2, 6)):
        k = periodic_runs.RunRules(length, power).gram
        assert all(max(length, power * q) - k + 1 >= 2 * q for q in range(1, 50))


ODD = [(1, None, "a"), (2, "", None), (3, "b " * 7, "a"), (3, "b " * 7, "a"), (None, "x y x y x y", "b"), (5, "\n \t", None),
       (6, "long " * 9000, "b"), (7, "a b a b a b a b a b", "a"), (8, "a b c", "")]


def test_runs_match_plain_search(spark):
    draw = random.Random(8)
    rows = ODD[:6] + ODD[7:] + [(100 + i, " ".join(noisy(draw, "abcdefgh"[: draw.randint(1, 8)], draw.randint(1, 12))), "a") for i in range(150)]
    for rules in (periodic_runs.RunRules(), periodic_runs.RunRules(length=3, power=2), periodic_runs.RunRules(narrowings=0)):
        got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs.find(docs_of(spark, rows), rules).collect()), key=str)
        want = []
        for i, text, _ in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            runs = plain_runs(words, rules.length, rules.power)
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
        assert got == sorted(want, key=str)
    assert periodic_runs.find(docs_of(spark, [])).count() == 0


def test_long_text_of_one_word(spark):
    row = periodic_runs.find(docs_of(spark, [(1, "w " * 120_000, "a")])).first()
    assert [tuple(x) for x in row.runs] == [(0, 120_000, 1)] and row.text == "w"


def test_planted_runs_query(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"]) for _ in range(draw.randint(0, 60))), "a") for i in range(300)]
    rows += [(None, "a a a a a a a", "a"), (900, None, None)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        words = (text or "").split()
        order = queries.planted_order(i, len(words))
        words = words if order is None else [words[k] for k in order]
        runs = plain_runs(words)
        row = got[i]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert any(r.n_runs and queries.planted_order(r.doc_id, 9) is not None for r in got.values() if r.doc_id is not None)


def plain_audit(rows, labels):
    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [j for j, t, _ in rows if (t or "") == text and j is not None]
        return "".join(x for x, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            re.search(r"[#$%&*|]", text), i is not None and i > min(ids))) if bad)

    marks = {}
    for i, quality, toxic in labels:
        had = marks.get(i, (False, False))
        marks[i] = (had[0] or quality == 1, had[1] or toxic == 1)
    facts = [(lang or "", fails(i, t or ""), *(marks.get(i, (False, False)) if i is not None else (False, False))) for i, t, lang in rows]
    out = []
    for part in {x[0] for x in facts}:
        mine = [x for x in facts if x[0] == part]
        orders = ["".join(x) for x in itertools.permutations("ABCDE")]
        gone = {order: [next((s for s, f in enumerate(order) if f in x[1]), 9) for x in mine] for order in orders}
        shapley = {f: sum(sum(g == order.index(f) for g in gone[order]) for order in orders) for f in "ABCDE"}
        for order in orders:
            for step, f in enumerate(order):
                here = [x for x, g in zip(mine, gone[order]) if g == step]
                out.append((part, order, step + 1, sum(g > step for g in gone[order]), len(here),
                            sum(f in x[1] and g < step for x, g in zip(mine, gone[order])), sum(x[1] == f for x in mine),
                            sum(x[2] for x in here), sum(x[3] for x in here), shapley[f]))
    return sorted(out)


def test_audit_matches_plain_counts(spark):
    draw = random.Random(2)
    rows = ODD[:6] + ODD[7:] + [(4, "b " * 7, None), (None, "b " * 7, "a"), (1, "b " * 7, "b")]
    for i in range(60):
        words = [draw.choice(["w", "W", "Xy", "#", "z%"]) + str(draw.randrange(draw.choice([5, 5000]))) for _ in range(draw.choice([20, 130]))]
        rows += [(200 + i, " ".join(words), draw.choice(["a", "b", None, ""]))] * draw.choice([1, 1, 3])
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i, _, _ in rows if draw.random() < 0.7] + [(None, 1, 1), (3, 1, 0), (3, 0, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(docs_of(spark, rows), frame).collect())
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit(docs_of(spark, []), frame).count() == 0


def test_removal_ranks_are_the_first_failing_position():
    draw = np.random.default_rng(1)
    fails = draw.random((16, 4)) < 0.5
    orders = np.array(list(itertools.permutations(range(4))))
    got = filter_audit.removal_ranks(fails, orders)
    for m, o in itertools.product(range(16), range(24)):
        assert got[m, o] == next((s + 1 for s, f in enumerate(orders[o]) if fails[m, f]), 5)


VECTORS = "vec_id long, embedding array<float>, label int, key string, n int, cells int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], lab, "k", 1, 2) for i, v, lab in rows], VECTORS)


def good(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def plain_links(rows, threshold=0.93):
    part = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and good(v)]
    near = {k: set() for k in range(len(rows))}
    for a, b in itertools.combinations(part, 2):
        if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                near[a].add(b)
                near[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, wait = {k}, [k]
        while wait:
            for m in near[wait.pop()] - seen:
                seen.add(m)
                wait.append(m)
        least = min((rows[m][0] for m in seen), key=lambda x: (x is None, x))
        out.append((i, len(near[k]), least, least == i))
    return sorted(out, key=str)


def clustered(draw, count, dim, spread):
    out = []
    while len(out) < count:
        centre, label = draw.standard_normal(dim), int(draw.integers(3))
        for _ in range(int(draw.integers(1, 9))):
            out.append([float(x) for x in (centre + spread * draw.standard_normal(dim)).astype(np.float32)] if len(out) % 7 else [float(x) for x in centre.astype(np.float32)])
    return [(1000 + k, v, int(draw.integers(3)) if draw.random() < 0.1 else k // 40 % 3) for k, v in enumerate(out[:count])]


@pytest.mark.parametrize("recall", [1.0, 0.999])
def test_links_match_all_pairs(spark, recall):
    draw = np.random.default_rng(4)
    rows = clustered(draw, 500, 6, 0.2)
    rows += [rows[3], rows[3], (7, rows[3][1], rows[3][2]), (8, [2 * x for x in rows[3][1]], rows[3][2]), (None, rows[3][1], rows[3][2])]
    rows += [(1, None, 0), (2, [], 0), (3, [0.0] * 6, 0), (4, [1.0, None, 0, 0, 0, 0], 0), (5, [1.0, float("nan"), 0, 0, 0, 0], 0),
             (6, [float("inf"), 1.0, 0, 0, 0, 0], 0), (9, rows[5][1], None), (10, [1.0, 1.0], 0), (11, [2.0, 2.0], 0), (12, [3.0], 0), (13, [4.0], 0),
             (14, [1e30, 1e30], 0), (15, [-0.0, 1.0], 0), (16, [0.0, 1.0], 0)]
    plan = multi_index.MultiIndex(cell_rows=8, recall=recall, block=16, evidence=1, asked=200)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in multi_index.links(vectors_of(spark, rows), "vec_id", "label", "embedding", plan).collect()), key=str)
    want = plain_links(rows)
    if recall == 1:
        assert got == want
    else:
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(g[1] <= w[1] or g[0] == rows[3][0] for g, w in zip(got, want))
        assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)


def test_no_vectors(spark):
    assert multi_index.links(vectors_of(spark, []), "vec_id", "label", "embedding").count() == 0
    rows = [(1, None, 0), (2, [0.0], 1)]
    got = multi_index.links(vectors_of(spark, rows), "vec_id", "label", "embedding").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_cells_are_visited_by_ascending_distance():
    draw = np.random.default_rng(9)
    for _ in range(50):
        a, b = draw.random(6), draw.random(4)
        got = [(int(i), int(j)) for i, j in multi_index.nearest_cells(a, b, 0.9)]
        assert [a[i] + b[j] for i, j in got] == sorted(a[i] + b[j] for i, j in itertools.product(range(6), range(4)) if a[i] + b[j] <= 0.9)
        assert len(set(got)) == len(got)


def test_border_is_a_lower_bound():
    draw = np.random.default_rng(2)
    x = multi_index.unit(draw.standard_normal((300, 8)))
    grid = multi_index.Grid((multi_index.codewords(x[:, :4], 5), multi_index.codewords(x[:, 4:], 5)), 2.0)
    (u, a), (v, b) = grid.barriers(x)
    for i, j in itertools.product(range(0, 300, 7), range(300)):
        assert a[i, u[j]] + b[i, v[j]] <= ((x[i] - x[j]) ** 2).sum() + 1e-9


def test_join_by_size_keeps_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 1)], "k long, v long")
    sizes = rows.filter("k is not null").groupBy("k").count()
    got = join_by_size(rows, sizes, ["k"], "count", share=10)
    assert sorted(map(tuple, got.select("k", "v").collect())) == sorted(map(tuple, rows.filter("k is not null").select("k", "v").collect()))
