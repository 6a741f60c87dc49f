"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import SPACE_RUN
from tidemark.session import stage


@dataclass(frozen=True)
class Curriculum:
    """weights and schedules repeat over the sources in code-point order.

    A schedule gives a source's relative weight at evenly spaced times from 0 to 1, linear between them; only its
    shape counts, since its integral is scaled to the source's target. ``slice_rows``: documents of a source that one
    task orders.
    """

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    schedules: tuple[tuple[float, ...], ...] = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
    share: float = 1.5
    most: float = 2.0
    slice_rows: int = 2000


#: Tasks over which the copies of one common row are spread.
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_RUN.replace("[", "[^"))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, plan: Curriculum) -> DataFrame:
    """One row per source: its size, weight, schedule number and target.

    sizes: no_source, source_key, size. Targets share ``share`` times all sizes by weight; none exceeds ``most`` times
    its source's size. Capped sources come first in the order of size over weight, so the common factor of the others
    follows from running sums over the sources.
    """
    sources = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy("no_source", "source_key")
    weights = F.array(*[F.lit(w) for w in plan.weights])
    sources = (
        sources.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(weights, (F.col("rank") % len(plan.weights) + 1).cast("int")))
        .withColumn("schedule", (F.col("rank") % len(plan.schedules)).cast("int"))
        .withColumn("cap", plan.most * F.col("source_size"))
    )
    everyone, by_cap = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    after = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    factor = (
        (plan.share * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after)
    )
    return (
        sources.withColumn("place", F.row_number().over(by_cap))
        .withColumn("factor", factor)
        .withColumn("fits", F.when(F.col("factor") <= F.col("cap") / F.col("weight"), F.col("place")))
        .withColumn("factor", F.min_by("factor", "fits").over(everyone))
        .withColumn("target", F.least("cap", F.coalesce(F.col("factor") * F.col("weight"), F.col("cap"))))
        .select("no_source", "source_key", "source_size", "n_docs", "schedule", "target")
    )


def when_demanded(share: Column, schedule: Column, plan: Curriculum) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` of its target.

    On each stretch the weight is linear, so demand is a parabola and its inverse a square root.
    """
    out = F.lit(None).cast("double")
    for number, weights in reversed(list(enumerate(plan.schedules))):
        steps = len(weights) - 1
        areas = [(weights[i] + weights[i + 1]) / 2 / steps for i in range(steps)]
        total, time = sum(areas), F.lit(1.0)
        for i in reversed(range(steps)):
            low, slope = weights[i], (weights[i + 1] - weights[i]) * steps
            need = share * total - sum(areas[:i])
            inside = need / low if not slope else (F.sqrt(F.greatest(F.lit(0.0), low * low + 2 * slope * need)) - low) / slope
            time = F.when(share * total <= sum(areas[: i + 1]), i / steps + inside).otherwise(time)
        out = F.when(schedule == number, time).otherwise(out)
    return out


def mix(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """Per document the words the mix takes and the training times of its copies.

    docs: doc_id, text, source; other columns are not read. A document's size is its number of words (null text: 0).
    A source's documents stand in the order of md5(doc_id) (ties by doc_id, then size); a pass ends after the last and
    the next begins. A copy is taken if its middle lies within the source's target, so the taken words miss the target
    by half a document at most. Null sources are one source, the last; repeated rows are documents of their own; null
    ids stand first among ties. Returns doc_id, source, size, source_size, target, taken, times (ascending).
    """
    return _mixed(docs, plan).drop("row")


def _row(docs: DataFrame) -> Column:
    """A digest of all columns of a row: rows that share it are the same in every one."""
    others = [c for c in docs.columns if c != "text"]
    return F.md5(F.concat(F.to_json(F.struct(*[docs[c] for c in others]), {"ignoreNullFields": "false"}), F.coalesce(docs["text"].isNull().cast("string"), F.lit("")),
                          F.coalesce(docs["text"].cast("string"), F.lit(""))).cast("binary"))


def _mixed(docs: DataFrame, plan: Curriculum) -> DataFrame:
    """``mix`` with the digest of each row."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sizes = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
            word_count(F.col("text").cast("string")).alias("size"), key.alias("key"), _row(docs).alias("row"),
        ),
        "sizes",
    )
    source = ["no_source", "source_key"]
    targets = stage(source_targets(sizes, plan), "targets")
    slices = F.ceil(F.col("n_docs") / plan.slice_rows)
    placed = sizes.join(targets, source).withColumn(
        "slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * slices / F.lit(2**32))
    )
    before = W.partitionBy(*source).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*source, "slice").agg(F.sum("size").alias("slice_size"))
        .withColumn("slice_start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
        .drop("slice_size")
    )
    inside = W.partitionBy(*source, "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("slice_start") + F.col("through") - F.col("size") / 2
    passes = F.array(*[middle + i * F.col("source_size") for i in range(-int(-plan.most // 1))])
    return (
        placed.withColumn("through", F.sum("size").over(inside))
        .join(starts, [*source, "slice"])
        .withColumn("middles", F.filter(passes, lambda m: (m < F.col("target")) & (F.col("size") > 0)))
        .select(
            "row", "doc_id", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "size", "source_size", "target",
            (F.col("size") * F.size("middles")).alias("taken"),
            F.transform("middles", lambda m: when_demanded(m / F.col("target"), F.col("schedule"), plan)).alias("times"),
        )
    )


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Documents range-sorted by the time of their first copy; what the mix leaves out comes last."""
    first = F.coalesce(F.array_min("times"), F.lit(2.0))
    parts = [partitions] if partitions else []
    return mixed.withColumn("_first", first).repartitionByRange(*parts, "_first", "doc_id").sortWithinPartitions("_first", "doc_id").drop("_first")


def apply_mix(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The mixed corpus: each document once for every copy the mix takes, range-sorted by the copies' training times.

    All columns stay. Documents without words are no part of a mix. Each row has the copies that the mix gives to it, also
    among rows that share an id or have none; rows that are equal in all columns share theirs. A row that stands for over a
    thousandth of all copies is dealt to ``SALTS`` tasks; of those there are at most a thousand.
    """
    times = stage(_mixed(docs, plan).select("row", F.explode("times").alias("time")), "times")
    counts = stage(times.groupBy("row").agg(F.count("*").alias("n")), "copies")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(counts.filter(F.col("n") * 1000 > total).select("row"))
    given = docs.select(_row(docs).alias("row"), F.struct(*docs.columns).alias("given"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    rare = given.join(common, "row", "left_anti").dropDuplicates(["row"]).join(times.join(common, "row", "left_anti"), "row")
    often = given.join(common, "row", "left_semi").dropDuplicates(["row"]).select("*", salts).join(
        times.join(common, "row", "left_semi").withColumn("salt", F.pmod(F.xxhash64("time"), F.lit(SALTS))), ["row", "salt"])
    copies = rare.select("given", "time").unionByName(often.select("given", "time"))
    ordered = copies.repartitionByRange("time", "given.doc_id").sortWithinPartitions("time", "given.doc_id")
    return ordered.select("given.*")
