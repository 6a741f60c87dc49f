"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import ship, stage

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Before work in Python: send the package to the workers, and keep Arrow batches small, since texts can be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, after which the worker gives back what it has freed.

    Spark keeps workers for later tasks; without this each would hold on to the most it ever used.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def crc_bucket(column, buckets: int):
    """crc32 of the decimal text of an id, modulo ``buckets``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def one_per_id(rows: DataFrame) -> DataFrame:
    """doc_id and of its texts the one with the least hash. Rows of an id are combined before the shuffle."""
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """doc_id, text and label of at most ``most`` labelled documents, one row each, however often an id is repeated.

    The choice is made on the narrow label table, by hash; it is bounded, so sending it to the documents' tasks is too.
    """
    chosen = (
        labels.filter(allowed & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    chosen = F.broadcast(stage(chosen, "chosen"))
    return one_per_id(docs.join(chosen, "doc_id", "left_semi")).join(chosen, "doc_id")


def join_by_size(rows: DataFrame, sizes: DataFrame, on: list[str], count: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with one row per key, in which ``count`` tells how many rows have that key.

    Keys that more than one in ``share`` of the rows have are at most ``share``: these are broadcast, so that their rows
    stay where they are. All other keys are shuffled, none of which is large. Both tables are read twice; give staged ones.
    """
    total = sizes.agg(F.sum(count)).first()[0] or 0
    hot, cold = sizes.filter(F.col(count) * share > total), sizes.filter(F.col(count) * share <= total)
    by_key = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return by_key.unionByName(rest)


#: Bits of a membership filter, in words of 64: at most 2**20 rows, so that it may be broadcast whatever the data.
_FILTER_BITS = 1 << 26


def _bit(digest: str) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(digest, F.lit(31)), F.lit(_FILTER_BITS))
    return F.floor(place / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def membership(digests: DataFrame, digest: str) -> DataFrame:
    """A filter of the digests, (_word, _bits), of bounded size."""
    word, bit = _bit(digest)
    return stage(digests.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "membership")


def possible(rows: DataFrame, digest: str, members: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose digest can be among the members, with those that share a bit; or the rows that surely are not.

    No row is moved. With more members than bits every row is possible: an exact join follows for those in any case.
    """
    word, bit = _bit(digest)
    met = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(members), "_word", "inner" if inside else "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return met.filter(hit if inside else ~hit).drop("_word", "_bit", "_bits")
