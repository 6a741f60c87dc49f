"""Quality rules from words, repeats and lines that many documents of a host share. DataFrame functions only."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACE_RUN, SPACES, join_by_size, membership, possible
from tidemark.session import stage

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """A line is boilerplate in a host where over ``most_docs`` of its documents hold it. A document is depleted where
    over ``most_lost`` of the characters of its distinct lines are boilerplate. A document fails with fewer words than
    ``least_words`` or with over ``most_repeated`` percent of them in repeated three-word windows."""

    most_docs: int = 100
    most_lost: float = 0.5
    least_words: int = 50
    most_repeated: int = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)


def normal_line(line: Column) -> Column:
    return F.btrim(F.translate(F.lower(line), "123456789", "000000000"), F.lit(SPACES))


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found at least twice."""

    def covered(starts: Column) -> Column:
        end = F.aggregate(
            starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda had, at: F.struct((at + 3).alias("end"), (had["n"] + at + 3 - F.greatest(at, had["end"])).alias("n")),
        )
        return end["n"]

    def places(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ranked, lambda r: covered(F.sort_array(F.transform(
            F.filter(r, lambda x, i: (x["h"] == F.get(r, i + 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(r, i - 1)["h"]).eqNullSafe(True)),
            lambda x: x["i"]))))

    windows = let(words, lambda w: F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda first, i: F.xxhash64(first, F.get(w, i + 1), F.get(w, i + 2))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(places(h))).cast("long")


#: What tells documents apart: rows are one document only if their id, text and host are the same.
DOCUMENT = ["doc_id", "text_key", "no_host", "host"]


def document_key(host: str) -> list[Column]:
    """The columns of ``DOCUMENT``. All but doc_id are never null."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"),
            F.col(host).isNull().alias("no_host"), F.xxhash64(F.col(host).cast("string")).alias("host")]


def of_document(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``other`` by the document's key, which ``rows`` keep under ``_doc_id`` and so on."""
    return rows.join(other, functools.reduce(Column.__and__, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in DOCUMENT]), how)


def text_facts(docs: DataFrame, host: str) -> DataFrame:
    """The document's key (``_doc_id`` and so on), the counts of its whole text (null text: no words) and its distinct lines,
    as hash and characters, of every row. Staged: a text is split once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(*document_key(host), text.alias("_text"), words_of(text).alias("_words"), lines_of(text).alias("_all"))
    normal = F.array_distinct(F.transform("_all", normal_line))
    facts = split.select(
        *[F.col(c).alias(f"_{c}") for c in DOCUMENT],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_all") - F.size(F.array_distinct("_all"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.transform(normal, lambda n: F.struct(F.xxhash64(n).alias("line"), F.length(n).alias("chars"))).alias("_lines"),
    )
    return stage(facts.withColumn("line_chars", F.aggregate("_lines", F.lit(0), lambda had, x: had + x["chars"])), "facts")


def boilerplate(facts: DataFrame, rules: LineRules) -> DataFrame:
    """(document's key, line, chars): the boilerplate among each distinct document's distinct lines.

    Rows that are one document are folded before their lines are counted, so that repeated rows count once. Lines that
    surely are no boilerplate stay where they are; the commonest ones are not gathered either.
    """
    once = facts.select(*[F.col(f"_{c}").alias(c) for c in DOCUMENT], "_lines").groupBy(*DOCUMENT).agg(F.first("_lines").alias("lines"))
    rows = once.select(*DOCUMENT, F.explode("lines").alias("x")).select(*DOCUMENT, "x.*")
    many = stage(rows.groupBy("no_host", "host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > rules.most_docs), "many")
    held = stage(possible(rows, "line", membership(many, "line")), "held")
    return join_by_size(held, many, ["no_host", "host", "line"], "n").select(*DOCUMENT, "line", "chars")


def judge(docs: DataFrame, host: str = "source", rules: LineRules = LineRules()) -> DataFrame:
    """Counts and verdict of every document.

    docs: doc_id, text and the host column; others are not read. Rows with the same id, text and host are one document in
    the line frequencies, and each gets its verdict. Each row's verdict is on its own text and host, whatever other rows
    have its id or none. A null text has no words and fails; null hosts are one host; no rows, no verdicts. Only hashes and
    lengths of lines are shuffled.
    """
    facts = text_facts(docs, host)
    return _judged(facts, boilerplate(facts, rules), rules).drop(*[f"_{c}" for c in DOCUMENT[1:]]).withColumnRenamed("_doc_id", "doc_id")


def _judged(facts: DataFrame, found: DataFrame, rules: LineRules) -> DataFrame:
    """``judge`` with the document's key in place of doc_id."""
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    lost = found.groupBy(*DOCUMENT).agg(F.sum("chars").alias("lost"))
    return of_document(facts, lost, "left").select(
        *[f"_{c}" for c in DOCUMENT], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.coalesce(F.col("lost"), F.lit(0)) <= rules.most_lost * F.col("line_chars"))).alias("kept"),
    )


def clean(docs: DataFrame, host: str = "source", rules: LineRules = LineRules()) -> DataFrame:
    """Kept documents, all columns, their text without boilerplate lines.

    The boilerplate hashes of one document are gathered in its row; they are at most as many as its own lines.
    """
    facts = text_facts(docs, host)
    found = stage(boilerplate(facts, rules), "boilerplate")
    gone = found.groupBy(*DOCUMENT).agg(F.collect_set("line").alias("_gone"))
    kept = _judged(facts, found, rules).filter("kept").select(*[F.col(f"_{c}").alias(c) for c in DOCUMENT]).distinct()
    given = docs.select(F.struct(*docs.columns).alias("_given"), *[k.alias(f"_{c}") for c, k in zip(DOCUMENT, document_key(host))])
    text = F.col("_given")["text"]
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains("_gone", F.xxhash64(normal_line(x))), F.lit(False)))
    return of_document(of_document(given, kept, "left_semi"), gone, "left").select(
        *[F.array_join(lines, "\n").alias(c) if c == "text" else F.col("_given")[c].alias(c) for c in docs.columns])
