"""Packing, mixing, line rules, private data, main text: edge cases and brute-force comparison."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import char_tagger, line_rules, main_text, mixing, packing, private_data
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.tokens import WordIds

DOCS = "doc_id long, text string, source string, size long, length int, score string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, 1, "x") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (3, "one", "a"), (3, "one", "a"), (None, "two words", "b"), (5, "\n \t", None),
       (6, "long " * 9000, "b"), (7, "a b c a b c", "a")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_word_ids_equal_whole_text_ids(tokenizer):
    texts = ["Hello, WORLD's don't 12x é É é Σίσυφος", "a<|endoftext|>b", "x\ty z\u0085q", "", "naïve... ### no!ok ñandú, ªº İstanbul",
             " ".join(random.Random(4).choices(["Été,", "foo.", "$$$bar***", "x9y", "ÇA", "it's", "日本", "ß"], k=300))]
    ids = WordIds(tokenizer_path(), room=3)
    for got, text in zip(ids.encode(texts) and ids.encode(texts), texts):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_packing_places_every_id_once(spark, tokenizer):
    rows = packing.pack_documents(docs_of(spark, ODD), tokenizer_path()).collect()
    whole = sorted([len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ODD])
    assert sum(r.length for r in rows) == sum(whole)
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs_of(spark, []), tokenizer_path()).count() == 0


def test_packer_keeps_all_limits():
    draw = random.Random(1)
    packer = packing.Packer(packing.Limits(tokens=100, segments=4, loss=60), 0)
    items = [(i, 0, draw.randint(1, 60), draw.randint(0, 30)) for i in range(300)]
    packer.add(items)
    seen = {}
    for _, pieces in packer.sequences(0):
        assert sum(p[2] for p in pieces) <= 100 and len(pieces) <= 4 and sum(map(packer.loss_of, pieces)) <= 60
        for doc, start, length, _ in pieces:
            seen.setdefault(doc, []).append((start, length))
    for doc, _, size, _ in items:
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == size


def test_mix_meets_targets(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.randint(0, 30)), draw.choice("aab") if i % 9 else None) for i in range(600)]
    plan = mixing.Curriculum(slice_rows=40)
    out = mixing.mix(docs_of(spark, rows), plan).collect()
    assert len(out) == 600 and all(r.taken <= 2 * r.size for r in out)
    taken, target = {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert all(0 <= t <= 1 for t in r.times) and list(r.times) == sorted(r.times)
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in out))
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs_of(spark, rows[::-1]), plan).collect()), key=str)


def test_mix_odd_rows(spark):
    out = mixing.mix(docs_of(spark, ODD)).collect()
    assert len(out) == len(ODD) and {r.source_size for r in out if r.source is None} == {0}
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert {r.target for r in mixing.mix(docs_of(spark, [(1, None, "a")])).collect()} == {0.0}
    mixed = mixing.apply_mix(docs_of(spark, [(1, "a b c", "s"), (2, "d e", "t")])).collect()
    assert {r.doc_id for r in mixed} == {1, 2}


def test_schedule_inversion(spark):
    plan = mixing.Curriculum(schedules=((2.0, 0.0, 1.0),))
    from pyspark.sql import functions as F

    got = spark.range(11).select(mixing.when_demanded(F.col("id") / 10, F.lit(0), plan).alias("t")).collect()
    area = lambda t: (2 * t - 2 * t * t if t < 0.5 else 0.5 + (t - 0.5) ** 2) / 0.75
    for i, r in enumerate(got):
        assert area(r.t) == pytest.approx(i / 10, abs=1e-9)


def plain_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    return len({p + k for at in seen.values() if len(at) > 1 for p in at for k in range(3)})


def test_line_rules_odd_rows_and_counts(spark):
    out = line_rules.judge(docs_of(spark, ODD), "source").collect()
    assert len(out) == len(ODD)
    texts = {i: t or "" for i, t, _ in ODD}
    for r in out:
        assert r.n_repeat_words == plain_repeats(texts[r.doc_id]) and not r.kept
    assert line_rules.judge(docs_of(spark, []), "source").count() == 0


def test_depleted_documents_go(spark):
    shared = "this very line stands in many documents of the host"
    own = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(i, f"{shared.upper() if i % 2 else shared}\n{own(i)}", "h") for i in range(12)]
    rows += [(100, "\n".join([shared] * 3 + [own(5)[:20]] + [" ".join(f"q{k}" for k in range(40))]), "g")]
    rows += [(200 + i, own(i % 2), "h") for i in range(12)]
    out = {r.doc_id: r.kept for r in line_rules.judge(docs_of(spark, rows), "source", line_rules.LineRules(most_docs=5)).collect()}
    assert all(out[i] for i in range(2, 12)) and out[100]
    assert not any(out[200 + i] for i in range(12)), "copies beyond the limit consist of shared lines only"
    kept = {r.doc_id: r.text for r in line_rules.clean(docs_of(spark, rows), "source", line_rules.LineRules(most_docs=5)).collect()}
    assert kept[3] == own(3) and shared in kept[100]


def test_base_spans():
    text = "a@b.cc_x@d.ee @no 1.2.3.400 1.2.3.4.5 4111 1111 1111 1111 4111111111111112 +1 (438) 555-5817 +12 " + "9" * 5000 + "z" * 5000
    base, unsure = private_data.base_spans(text)
    found = [(private_data.KINDS[k], text[s:e]) for k, s, e in base]
    assert found == [("email", "a@b.cc"), ("email", "_x@d.ee"), ("ip", "1.2.3.4"), ("phone", "+1 (438) 555-5817")]
    assert private_data.base_spans("x 4111 1111 1111 1111 y")[0] == [(2, 2, 21)]
    assert private_data.base_spans("")[0] == []


def test_tagger_gradient_matches_differences():
    p = {k: v.astype(float) for k, v in char_tagger.start_parameters(5, char_tagger.Training(hidden=3, embedding=4)).items()}
    draw = np.random.default_rng(0)
    ids, tags = draw.integers(0, 12, (2, 6)), draw.integers(0, 5, (2, 6))
    _, g = char_tagger.gradients(p, ids, tags)
    for name in p:
        at = (int(ids[0, 0]), 1) if name == "letters" else tuple(int(draw.integers(0, n)) for n in p[name].shape)
        sides = []
        for step in (1e-3, -1e-3):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            sides.append(char_tagger.gradients(q, ids, tags)[0])
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(g[name][at], abs=2e-4)


def test_private_data_end_to_end(spark):
    draw = random.Random(3)

    def card():
        head = "4" + "".join(draw.choices("0123456789", k=14))
        return next(head + d for d in "0123456789" if private_data.luhn(head + d))

    words = lambda: " ".join(draw.choices(["the", "on", "ering", "thand", "of"], k=12))
    rows = [(3000 + i, f"{words()} {draw.choice([card(), '+1 (438) 555-%04d' % i, 'ab.%d@mail.example.com' % i, '10.%d.3.4' % (i % 200)])} {words()}", "s")
            for i in range(400)]
    adjacent = f"{words()} +1 (689) 555-1019 {card()} {words()}"
    rows += [(1000, adjacent, "s"), *ODD, (2000, words(), "s")]
    frame = docs_of(spark, rows)
    tagger = private_data.learn(frame, private_data.Finder(training=char_tagger.Training(steps=150)))
    out = private_data.find(frame, tagger).collect()
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in out:
        base = private_data.described(private_data.base_spans(texts[r.doc_id])[0])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    by_id = {r.doc_id: r for r in out}
    assert by_id[2000].spans == ""
    finder = tagger.finder
    ids, tags = private_data.labelled_windows([t for i, t, _ in rows if (i or 0) >= 3000], finder)
    assert (char_tagger.decode(tagger.parameters, ids) == tags)[tags > 0].mean() > 0.95
    clean = {r.doc_id: r.text for r in private_data.redact(frame, tagger).collect()}
    assert clean[1] is None and clean[2000] == texts[2000] and "[" in clean[3000]
    assert "[PHONE] [CARD]" in clean[1000], "the exact patterns run both together and find none"
    assert private_data.find(docs_of(spark, []), tagger).count() == 0


def test_windows_cover_triggers_and_reconcile():
    finder = private_data.Finder()
    text = "x" * 500 + "1" + "y" * 300 + "@" + "z" * 20 + "7" * 400
    windows = private_data.windows_of(text, finder)
    covered = {k for s, e in windows for k in range(s, e)}
    assert all(k in covered for k, c in enumerate(text) if c in "17@") and all(e - s <= 96 for s, e in windows)
    a, b = np.zeros(96, int), np.zeros(96, int)
    a[80:] = 6
    a[80] = 5
    b[16:40] = 6
    b[16] = 5
    assert private_data._reconciled([(0, 96, a), (64, 160, b)]) == [(2, 80, 104)]


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice"><p>We, use, cookies, here, now.</p></div>
<article><h1>Head &amp; line</h1><p>First <b>bold
 words</b>, and, more&nbsp;text.<p>Second&#33; <a href=x>link</a><br>after<div class="ad">Buy</div>
<section><p>Third, of, three.</p></section><div id="comments"><p>Nice, really, nice.</p></div></article>
<aside>Side</aside><form>Name <input></form><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert main_text.main_text(PAGE) == "Head & line\n\nFirst bold words, and, more text.\n\nSecond! link after\n\nThird, of, three."
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<nav>only</nav>") == ""
    assert main_text.main_text("plain &am text") == "plain &am text"
    assert len(main_text.main_text("<div>" * 50000 + "deep" + "</div>" * 50000)) == 4


def test_main_text_by_score_alone():
    body = "<p>" + "Long words here, with commas, and more of them, again. " * 5 + "</p>"
    page = f"<body><div><a href=1>a link, of, many</a> <a href=2>another, one</a></div><div>{body}{body}</div><div><a href=3>x, y</a></div></body>"
    assert main_text.main_text(page).count("Long words") == 10 and "another" not in main_text.main_text(page)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t")],
                                  "page_id long, url string, html string, text string")
    out = main_text.extract(pages).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert main_text.extract(pages.limit(0)).count() == 0
