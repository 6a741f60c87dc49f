"""Tagging by a table of names against one pattern per entity."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import text as TX
from tidemark.operators.text import _SPAN, tag_by_names, tag_entities
from tidemark.plans.catalog import QUERIES


def test_same_rows_as_patterns_over_many_names(spark):
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "ru", "té", "ба", "sen", "v"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    seen = {}
    while len(seen) < 100_000:
        seen[rng.choice([" ", " & ", "-"]).join(word() for _ in range(rng.randint(1, 3)))] = f"E{len(seen) % 40}"
    texts = [(i, rng.choice(["", "«", " "]) + "".join(
        word().upper() + rng.choice([" ", "  ", " & ", "-", ". "]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "..."), (None, "ka lo")]
    names = spark.createDataFrame(list(seen.items()), "alias string, entity string")
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("entity", F.lit("its own"))
    got = sorted((r.doc_id, r.entity) for r in tag_by_names(docs, names).collect())
    by_entity = {}
    for alias, entity in seen.items():
        by_entity.setdefault(entity, []).append(alias)
    want = []
    for entity, aliases in by_entity.items():
        pattern = re.compile(r"\b(" + "|".join(re.escape(a) for a in sorted(aliases, key=len, reverse=True)) + r")\b", re.I)
        want += [(i, entity) for i, text in texts if i is not None and text and pattern.search(text)]
    assert got == sorted(want) and len(got) > 300


def test_longest_names_and_odd_rows(spark):
    names = spark.createDataFrame(
        [("Man United", "mu"), ("United", "u"), ("Man", "m"), ("Man United", "mu2"), ("(F.C. Basel.)", "b"), ("!?", "none"),
         ("", "none"), (None, "none"), ("Basel", None), ("United Kingdom Tour", "k")], "alias string, entity string")
    docs = spark.createDataFrame(
        [(1, "man united won"), (2, "United; Man-United"), (3, "Man United Kingdom Tour"), (4, "at f.c. Basel."), (5, "Manunited"),
         (6, "United man united"), (7, "x"), (7, "Man")], "id long, title string")
    told = lambda **o: {(r.id, r.entity) for r in tag_by_names(docs, names, "id", "title", **o).collect()}
    assert told() == {(1, "mu"), (1, "mu2"), (1, "u"), (1, "m"), (2, "u"), (2, "m"), (3, "mu"), (3, "mu2"), (3, "u"), (3, "m"), (3, "k"),
                      (4, "b"), (6, "u"), (6, "m"), (6, "mu"), (6, "mu2"), (7, "m")}
    assert told(longest=True) == {(1, "mu"), (1, "mu2"), (2, "u"), (2, "m"), (3, "mu"), (3, "mu2"), (3, "k"), (4, "b"),
                                  (6, "u"), (6, "mu"), (6, "mu2"), (7, "m")}
    assert tag_by_names(docs, names.limit(0), "id", "title").count() == 0 and tag_by_names(docs.limit(0), names, "id", "title").count() == 0


def test_names_over_the_parts_of_a_long_text(spark):
    words = ["w"] * (3 * _SPAN)
    words[_SPAN - 1], words[_SPAN], words[2 * _SPAN - 1], words[-1] = "left", "right", "edge", "end"
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    names = {"pair": ["left right"], "edge": ["edge w"], "end": ["w end"], "no": ["right left", "end w"]}
    table = spark.createDataFrame([(a, e) for e, aliases in names.items() for a in aliases], "alias string, entity string")
    for longest in (False, True):
        assert {r.entity for r in tag_by_names(docs, table, longest=longest).collect()} == {"pair", "edge", "end"}
    assert docs.select(tag_entities(F.col("text"), names)).first()[0] == ["edge", "end", "pair"]


def test_runs_are_sorted_out_before_the_names_are_joined(spark, monkeypatch):
    """Names known everywhere, names that are joined, entities of several rows of bits: the same rows, the pieces taken once."""
    plain = spark.createDataFrame(
        [(i, " ".join(f"w{(i * k) % 9973}" for k in range(400)) + " common pair here") for i in range(50)], "doc_id long, text string")
    names = spark.createDataFrame(
        [("common pair", f"E{k}") for k in range(200)] + [("pair", f"E{k}") for k in range(90)] + [("here", "one"), ("rare", "none")],
        "alias string, entity string")
    want = {(i, e) for i in range(50) for e in ["one", *[f"E{k}" for k in range(200)]]}
    # All names broadcast, one of them, and only those of one row.
    for most, rows in ((1 << 16, 4), (1, 4), (1 << 16, 1)):
        monkeypatch.setattr(TX, "_KNOWN_EVERYWHERE", most)
        monkeypatch.setattr(TX, "_ROWS_EVERYWHERE", rows)
        got = tag_by_names(plain, names)
        assert {(r.doc_id, r.entity) for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.undo()
    plan = tag_by_names(plain, names)._jdf.queryExecution().optimizedPlan().toString()
    # Runs meet the filter before they are joined by name, and no other step repeats the pieces.
    assert "_filter#" in plan and plan.count("|\\W++, 0)") == 1


def test_entities_are_numbered_without_gaps(spark):
    entities = spark.range(0, 300, 1, 17).select(F.concat(F.lit("E"), "id").alias("entity"))
    for given, n in ((entities, 300), (entities.filter("entity in ('E1', 'E150', 'E299')"), 3), (entities.limit(0), 0)):
        rows = TX._numbered(given).collect()
        assert sorted(r._number for r in rows) == list(range(n)) and len({r.entity for r in rows}) == n


def test_alias_tags_of_odd_heads(spark, tmp_path):
    """Texts of fewer words than a name needs, with marks before and after; a text's second word names its entity."""
    texts = [(1, "«one» two", "en"), (2, "...", "en"), (3, None, "en"), (4, "Two three-four, FIVE six", "fr"), (5, "x three-four", "de"),
             (6, "", "de"), (6, "Y\U0001d4b3 \u00c9t\u00e9 z ", None)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.entities for r in QUERIES["alias_tags"](spark, str(tmp_path)).collect()}
    assert got == {1: "en-1", 4: "de-5 en-1 fr-4", 5: "de-5 fr-4", 6: "6"}
