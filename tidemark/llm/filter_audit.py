"""Audit of how filters interact: which filter removes what, in every order of applying them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACE_RUN, SPACES, small_batches

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = "#$%&*|"


def text_facts(text: Column) -> Column:
    """What the standard filters ask of a text: its words, distinct words, code points, capitals and symbols."""
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    return F.element_at(F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct"), F.length(text).alias("points"),
        (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))).alias("capitals"),
        (F.length(F.translate(text, _SYMBOLS, "")) < F.length(text)).alias("symbols"))), 1)


#: Letter and failure condition on the facts of a text. A further filter, for repeated texts, follows them.
STANDARD: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("A", lambda x: x["words"] < 100),
    ("B", lambda x: 100 * x["distinct"] < 80 * x["words"]),
    ("C", lambda x: 100 * x["capitals"] > 10 * x["points"]),
    ("D", lambda x: x["symbols"]),
)


def removal_ranks(fails: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The step at which each mask is removed in each order, masks x orders; one more than the filters where none does.

    The min-plus product of the mask matrix (0 where a filter fails, else out of reach) and the matrix of the filters'
    positions in each order, which is the orders' inverse permutation.
    """
    count = fails.shape[1]
    cost = np.where(fails, 0, count + 1)
    position = np.argsort(orders, axis=1).T + 1
    return np.minimum((cost[:, :, None] + position[None, :, :]).min(axis=1), count + 1)


def audit_tables(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Every count of the audit, orders x steps.

    weights: masks x 3, the documents, good ones and toxic ones that fail exactly the filters of a mask (bit f: filter f).
    """
    count = int(len(weights)).bit_length() - 1
    fails = (np.arange(len(weights))[:, None] >> np.arange(count)) & 1 == 1
    orders = np.array(list(itertools.permutations(range(count))), np.int64)
    rank = removal_ranks(fails, orders)
    scattered = np.zeros((len(orders), count + 1, weights.shape[1]), np.int64)
    np.add.at(scattered, (np.arange(len(orders))[None, :], rank - 1), weights[:, None, :])
    removed = scattered[:, :count]
    failing = (fails * weights[:, :1]).sum(axis=0)
    shapley = np.zeros(count, np.int64)
    np.add.at(shapley, orders, removed[:, :, 0])
    return {
        "orders": orders,
        "kept": weights[:, 0].sum() - np.cumsum(removed[:, :, 0], axis=1),
        "removed": removed[:, :, 0],
        "redundant": failing[orders] - removed[:, :, 0],
        "unique_fails": weights[1 << orders, 0],
        "good_lost": removed[:, :, 1],
        "toxic_lost": removed[:, :, 2],
        "shapley": shapley[orders],
    }


def masks(docs: DataFrame, labels: DataFrame, part: str, filters=STANDARD) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail.

    The last bit is the repeat filter: another row has the same text and a smaller doc_id. Texts meet as digests. Rows of
    one id and text are counted first, then each text's rows by what they have in common, so that of a text's copies one
    row per kind is left when its least id is looked for.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"), text_facts(text).alias("x"))
    mask = sum((F.when(fails(F.col("x")), 1 << i).otherwise(0) for i, (_, fails) in enumerate(filters)), F.lit(0))
    folded = facts.select("doc_id", "part", "digest", mask.cast("int").alias("mask")).groupBy(
        "doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = folded.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").unionByName(
        folded.filter(F.col("doc_id").isNull()), allowMissingColumns=True)
    kinds = ["digest", "part", "mask", "good", "toxic"]
    kind = marked.select("doc_id", "n", "digest", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]).groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_without"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = kind.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("n_without")
    split = kind.join(least, "digest").select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("bit"), firsts.alias("n")),
        F.struct(F.lit(1 << len(filters)).alias("bit"), (F.col("n") - firsts).alias("n")))).alias("x"))
    return split.filter("x.n > 0").groupBy("part", (F.col("mask") + F.col("x.bit")).alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters=STANDARD, repeats: str = "E") -> DataFrame:
    """One row per part, order of filters and step, with the counts of what that step does.

    docs: doc_id, text and the part's column; labels: doc_id, quality, toxic; other columns are not read. Every row is a
    document: repeated rows of one id and text are all first or all repeats. A null text is the empty one, a null part the
    empty string. Rows without id are repeats of nothing and nothing repeats them; they have no labels. An id labelled
    several times is good or toxic if any of its labels is. No documents, no rows. A part's counts are one row of at most
    two to the number of filters masks; parts are audited side by side.
    """
    letters = np.array([x for x, _ in filters] + [repeats])
    sizes = masks(docs, labels, part, filters).groupBy("part").agg(
        F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), "n", "good", "toxic")).alias("counts"))
    small_batches(docs.sparkSession, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                weights = np.zeros((1 << len(letters), 3), np.int64)
                for x in counts:
                    weights[x["mask"]] = x["n"], x["good"], x["toxic"]
                tables = audit_tables(weights)
                orders = tables.pop("orders")
                steps = orders.shape[1]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([name] * orders.size, pa.string()),
                    "filter_order": np.repeat(["".join(x) for x in letters[orders]], steps),
                    "step": pa.array(np.tile(np.arange(1, steps + 1), len(orders)), pa.int32()),
                    **{k: pa.array(v.reshape(-1), pa.int64()) for k, v in tables.items()}})

    return sizes.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                 "unique_fails long, good_lost long, toxic_lost long, shapley long")
