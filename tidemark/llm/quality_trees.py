"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACE_RUN, SPACES, released, small_batches, training_rows
from tidemark.llm.line_rules import let, lines_of

_UPPER = "".join(chr(c) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])


@dataclass(frozen=True)
class Boosting:
    """``rows``: at most so many labelled rows are learned from, those with the smallest hash of their id."""

    rows: int = 20000
    bins: int = 64
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    least_weight: float = 2.0
    ridge: float = 1.0


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text, all from built-in functions; a null or empty text gives zeros."""
    chars = F.length(text)
    per_char = lambda letters: (chars - F.length(F.translate(text, letters, ""))) / F.greatest(chars, F.lit(1))
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    by_word = let(words, lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"),
        F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).alias("stutter"),
        F.size(F.filter(w, lambda x: F.length(x) == 1)).alias("single"),
        F.aggregate(w, F.lit(0), lambda had, x: F.greatest(had, F.length(x))).alias("longest")))
    by_line = let(lines_of(text), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    return {
        "chars": F.log1p(chars), "words": by_word, "lines": by_line,
        "symbols": per_char("#*$%&"), "bars": per_char("|<>{}"), "shouts": per_char("!"), "capitals": per_char(_UPPER),
        "digits": per_char("0123456789"), "stops": per_char(".,;:?"), "spaces": per_char(SPACES),
    }


def features(docs: DataFrame) -> DataFrame:
    """docs with an array of statistics, ``stats``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c not in ("text", "stats")]

    def numbers(s: Column) -> Column:
        w, x = s["words"], s["lines"]
        n, lines = F.greatest(w["n"], F.lit(1)), F.greatest(x["n"], F.lit(1))
        values = [
            s["chars"], F.log1p(w["n"]), F.expm1(s["chars"]) / n, w["distinct"] / n, w["stutter"] / n, w["single"] / n, w["longest"],
            F.log1p(x["n"]), x["distinct"] / lines, w["n"] / lines,
            *[s[k] for k in ("symbols", "bars", "shouts", "capitals", "digits", "stops", "spaces")],
        ]
        return F.array(*[v.cast("double") for v in values])

    return docs.select(*keep, let(F.struct(*[c.alias(n) for n, c in statistics(text).items()]), numbers).alias("stats"))


@dataclass(frozen=True)
class Trees:
    """Complete trees, flattened: row t holds tree t's inner nodes in level order, then its leaves."""

    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        """One step down per level, for all rows and trees at once."""
        trees, inner = self.feature.shape
        node = np.zeros((len(stats), trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(len(stats))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (stats[row, self.feature[tree, node]] > self.above[tree, node])
        raw = self.start + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def fit(stats: np.ndarray, labels: np.ndarray, plan: Boosting = Boosting()) -> Trees:
    """Trees by gradients and second derivatives of the logistic loss, summed in histograms."""
    inner, leaves = 2**plan.depth - 1, 2**plan.depth
    rows, width = stats.shape
    mean = min(max(labels.mean(), 1e-3), 1 - 1e-3) if rows else 0.5
    start = float(np.log(mean / (1 - mean)))
    feature, above, leaf = np.zeros((plan.trees, inner), np.int64), np.full((plan.trees, inner), np.inf), np.zeros((plan.trees, leaves))
    if not rows:
        return Trees(feature, above, leaf, start)
    cuts = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, plan.bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, stats[:, f]) for f, c in enumerate(cuts)], axis=1)
    raw = np.full(rows, start)
    for t in range(plan.trees):
        chance = 1 / (1 + np.exp(-raw))
        slope, bend = chance - labels, chance * (1 - chance)
        node = np.zeros(rows, np.int64)
        for depth in range(plan.depth):
            count, first = 2**depth, 2**depth - 1
            local, best = node - first, np.full(count, 1e-9)
            for f in range(width):
                slot = local * plan.bins + binned[:, f]
                g = np.bincount(slot, slope, count * plan.bins).reshape(count, -1)
                h = np.bincount(slot, bend, count * plan.bins).reshape(count, -1)
                gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
                gs, hs = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + plan.ridge) + (gs - gl) ** 2 / (hs - hl + plan.ridge) - gs**2 / (hs + plan.ridge)
                gain[(hl < plan.least_weight) | (hs - hl < plan.least_weight)] = 0
                gain = gain[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[t, first + better], above[t, first + better] = f, cuts[f][at[better]]
            node = 2 * node + 1 + (stats[np.arange(rows), feature[t, node]] > above[t, node])
        at = node - inner
        g, h = np.bincount(at, slope, leaves), np.bincount(at, bend, leaves)
        leaf[t] = -plan.rate * g / (h + plan.ridge)
        raw += leaf[t][at]
    return Trees(feature, above, leaf, start)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, plan: Boosting = Boosting()) -> Trees:
    """Trees from the statistics of the labelled documents that ``allowed`` admits; without any, every score is one half."""
    rows = training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), "quality", allowed, plan.rows)
    found = features(rows).orderBy("doc_id", "stats").select("stats", "label").collect()
    stats = np.array([r["stats"] for r in found], float)
    return fit(stats if len(found) else np.empty((0, 0)), np.array([r["label"] for r in found]), plan)


def score(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """The columns of docs but text, with score (0 to 1) and predicted (score >= threshold).

    Statistics of the whole text are made by built-in functions; only their numbers go to Python. Null and empty texts
    have statistics of zero and are scored like any; repeated rows score alike. No shuffle.
    """
    small_batches(docs.sparkSession, 4096)
    stats = features(docs.drop("score", "predicted"))
    kept = [c for c in stats.columns if c != "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = trees.score(numbers) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                [*kept, "score", "predicted"])

    return stats.mapInArrow(released(run), stats.select(*kept).schema.add("score", "double").add("predicted", "integer"))
