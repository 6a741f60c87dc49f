"""Repeated ids, missing ids and skewed ids."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common, line_rules, main_text, mixing, ngram_join, one_bit_search, private_data


def test_search_with_every_row_repeated(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((12, 512))
    vectors = np.array([base[i // 10] + 0.3 * (i % 10) * draw.standard_normal(512) for i in range(120)], np.float32)
    rows = [(i, vectors[i].tolist()) for i in range(120) for _ in range(6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = one_bit_search.search(frame, frame.filter(F.col("vec_id") % 10 == 0).dropDuplicates(["vec_id"]), "vec_id", "embedding").collect()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for q in range(0, 120, 10):
        cos = unit @ unit[q]
        cos[q] = -9
        mine = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert mine == np.lexsort((np.arange(120), -cos))[:5].tolist()


def test_line_rules_judge_each_row_without_id_alone(spark):
    words = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    shared = [" ".join(f"{chr(97 + i)}x{chr(97 + k)}" for k in range(20)) for i in range(6)]
    bad = "\n".join(shared[:5])
    rows = [(i if i < 7 else None, f"{bad}\n{shared[5]} {i}", "h") for i in range(14)]
    rows += [(None, words(i), "h") for i in range(5)] + [(500, words(5), "h"), (500, bad, "h"), (600, bad, "g"), (600, bad, "h"), (None, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rules = line_rules.LineRules(most_docs=5)
    got = line_rules.judge(docs, "source", rules)
    assert got.columns[0] == "doc_id" and not {"text_key", "no_host", "host"} & set(got.columns)
    kept = line_rules.clean(docs, "source", rules).collect()
    assert sorted(r.text for r in kept) == sorted([*[words(i) for i in range(6)], bad])
    assert got.filter("kept").count() == 7 and got.count() == len(rows)


def test_one_of_each_judges_rows_without_id_by_their_text(spark):
    base = [" ".join(f"{chr(97 + g)}{k}" for k in range(60)) for g in range(6)]
    rows = [(10, base[0]), (11, base[0] + " end"), (None, base[0]), (None, base[0] + " other")]
    rows += [(None, base[1]), (None, base[1]), (None, base[1] + " near"), (None, base[1] + " nearer"), (None, base[2])]
    rows += [(None, None), (None, None), (None, ""), (None, " \n"), (20, None), (20, None), (21, "")]
    rows += [(3, base[3]), (5, base[3] + " late"), (5, base[4]), (5, base[4]), (4, base[5]), (4, base[5] + " too")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    near = [t for i, t in got if t and t.startswith(base[1])]
    assert len(near) == 1 and (None, near[0]) in got
    four = [t for i, t in got if i == 4]
    assert len(four) == 1 and four[0] in (base[5], base[5] + " too")
    rest = [x for x in got if x[1] not in near + four]
    assert sorted(rest, key=str) == sorted(
        [(10, base[0]), (None, base[2]), (None, None), (None, None), (None, ""), (None, " \n"), (20, None), (21, ""), (3, base[3]),
         (5, base[4])], key=str)


def test_training_samples_hold_one_row_of_each_id(spark):
    rows = [(1, f"text {k}") for k in range(50)] + [(i, f"doc {i}") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, toxic int")
    got = common.training_rows(docs, labels, "toxic", F.lit(True), 20).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(i, float(i % 2)) for i in range(1, 12)]
    assert len(common.training_rows(docs, labels, "toxic", F.lit(True), 4).collect()) == 4


def test_training_windows_come_from_all_sampled_documents(spark):
    long = " ".join(f"number {k} " + "word " * 30 for k in range(400))
    rows = [(1, long), (1, long + " 7"), *[(i, f"call {i} now") for i in range(2, 202)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = private_data.training_windows(docs, private_data.Finder(windows=300)).collect()
    of_long = sum(r.doc_id == 1 for r in got)
    assert len(got) == 300 and 0 < of_long < 290 and len({(r.doc_id, r.place) for r in got}) == 300


def test_main_text_keeps_articles_inside_marked_wrappers():
    article = "<h1>Head</h1>" + "".join(f"<p>Words of part {k}, with commas, and more of them, again and again.</p>" for k in range(5))
    for wrapper in ("div class='content no-sidebar'", "div class=has-sidebar", "div id=with-sidebar", "div class=search-results",
                    "div class=social-science", "form id=aspnet"):
        page = f"<body><{wrapper}>{article}<div class=sidebar>Side, words</div></{wrapper.split()[0]}><div class=share>Share</div></body>"
        assert main_text.main_text(page).count("Words of part") == 5 and "Side" not in main_text.main_text(page), wrapper
    assert main_text.main_text("<form><p>All of it</p></form>") == "All of it"


def test_main_text_keeps_short_siblings():
    block = "<div><p>" + "Long, words, with, many, commas, in, one, block. " * 20 + "</p></div>"
    short = "<p>Short.</p><ul><li>Item</li></ul><table><tr><td>Cell</td></tr></table><pre>Code</pre><h4>Minor</h4><div>Leaf</div>"
    got = main_text.main_text(f"<body>{short}{block}<div><a href=1>Link one, link two</a></div></body>")
    assert all(x in got for x in ("Short.", "Item", "Cell", "Code", "Minor", "Leaf")) and "Link" not in got


def test_page_reader_is_linear():
    story = "A long story, with many words, that goes on and on, and is told in full. " * 4
    for page in ("<a " * 350_000, '<a href="' * 110_000, '<a href="' * 110_000 + ">", "<div>x " * 140_000, "<div>" * 100_000 + "</section>" * 100_000,
                 "<table><td><div>" + "<form>" * 60_000 + "<tr></tr>" * 60_000, "<!x" * 300_000, "<a b='\"" * 140_000 + ">", "<!--" * 250_000):
        started = time.perf_counter()
        main_text.main_text(f"<p>{story}</p>{page}")
        assert time.perf_counter() - started < 8, page[:20]


def test_word_of_a_compound_is_a_hint():
    story = "A long story, with many words, that goes on and on, and is told in full. " * 4
    for name in ("notice-of-meeting", "search-science"):
        assert main_text.main_text(f'<body><div class="{name}"><p>{story}</p></div><div>Short.</div></body>') == f"{story.strip()}\n\nShort."
    assert main_text.main_text(f'<article><p>{story}</p><div class="alert-box">{story}</div></article>') == f"{story.strip()}\n\n{story.strip()}"
    for name in ("comment-list", "ad-box", "sidebar left", "notice", "cookie-banner"):
        assert main_text.main_text(f'<article><p>{story}</p><div class="{name}">{story}</div></article>') == story.strip()
    assert main_text.main_text(f'<article><p>{story}</p><div class="alert-box">Beware.</div></article>') == story.strip()


def test_mixed_corpus_meets_its_targets_without_ids(spark):
    rows = [(None if i % 3 == 0 else i, " ".join(["w"] * (i % 40 + 1)), "ab"[i % 2], 7, i) for i in range(600)] + [(5, "x y", "a", 1, 1)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _time int")
    plan = mixing.Curriculum(slice_rows=50)
    want = {r.source: r.t for r in mixing.mix(docs, plan).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    mixed = mixing.apply_mix(docs, plan)
    assert mixed.columns == docs.columns
    got = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("t")).collect()}
    assert got == want
    most = mixed.groupBy(*docs.columns).count().filter("_id = 7").agg(F.max("count")).first()[0]
    assert most <= 2


def test_repeated_rows_are_one_document_for_lines(spark):
    draw = np.random.default_rng(3)
    words = lambda n: " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 6)) for _ in range(n))
    text = "\n".join(words(6) for _ in range(40))
    rows = [(1, text, "h")] * 101 + [(i, "a shared line that all documents hold\n" + "\n".join(words(6) for _ in range(12)), "h") for i in range(2, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.judge(docs)
    assert got.filter("doc_id = 1").select("kept").distinct().collect() == [(True,)] and got.count() == len(rows)
    found = line_rules.boilerplate(line_rules.text_facts(docs, "source"), line_rules.LineRules())
    assert found.select("line").distinct().count() == 1


def plain_spans(text):
    """The four patterns by plain searches, leftmost and without retries."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        odd = [int(d) for d in digits[::-1]]
        if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_equal_plain_searches():
    draw = random.Random(6)
    parts = ["a.b", "@", "x-y.zz", "1", "255", "256", ".", " ", "-", "+", "4111111111111111", "4111 1111 1111 1111", "(0)", "12", "\n", "é", "%"]
    for _ in range(30_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert sorted(private_data.base_spans(text)[0]) == sorted(plain_spans(text)), text


def test_additions_pass_their_checks():
    fits = lambda kind, text: private_data._fits(text, (kind, 0, len(text)))
    assert fits(2, "4111 1111 1111 1111") and fits(2, "378282246310005")
    assert not fits(2, "2123465659789240") and not fits(2, "4111 1111 1111 1112") and not fits(2, "41111111")
    assert fits(1, "10.0.0.255") and not fits(1, "10.0.0.256") and not fits(1, "1.2.3")


def test_rows_without_id_are_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id long")
    held = rows.select("doc_id", F.coalesce(common.crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("h")).collect()
    assert all(r.h is not None for r in held) and not next(r.h for r in held if r.doc_id is None)
