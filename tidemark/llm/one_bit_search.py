"""Nearest neighbours by randomly rotated one-bit codes with error bounds, then exact reranking."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import small_batches
from tidemark.session import stage


@dataclass(frozen=True)
class Search:
    """``slack`` scales the error bound of an estimate; larger means more reranking. ``chunk`` rows and ``block`` queries
    meet in one step of a task; the meetings are spread over at least ``salts`` tasks, one more for every ``share`` chunks."""

    k: int = 5
    slack: float = 1.9
    chunk: int = 4096
    block: int = 1024
    salts: int = 24
    share: int = 16
    seed: int = 7


@functools.lru_cache(8)
def rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0].astype(np.float32)


def unit_rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    wide /= np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return wide.astype(np.float32) @ rotation(vectors.shape[1], seed)


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors, and each vector's inner product with its own code."""
    turned = unit_rotated(vectors, seed)
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(np.float32(vectors.shape[1]))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows give equal bits wherever they stand."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(query_ids, queries, ids, vectors, codes, agreement, search: Search) -> Iterator[tuple]:
    """(query, row, cosine) of each query's ``k`` best rows in this chunk.

    The estimate of a cosine is the product with the code over the code's agreement with its vector. Rows whose upper
    bound reaches the k-th largest lower bound are compared exactly. An id's lower bound is the largest of its rows', so
    that repeats of one id do not stand for k neighbours.
    """
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    width = search.slack * np.sqrt(np.maximum(0, 1 - agreement**2)) / agreement / np.sqrt(max(dim - 1, 1))
    turned = unit_rotated(queries, search.seed)
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id][:1] - 1))
    for low in range(0, len(queries), 128):
        part = slice(low, low + 128)
        about = turned[part] @ signs.T / np.sqrt(np.float32(dim)) / agreement
        own = query_ids[part, None] == ids[None, :]
        floor = np.where(own, -np.inf, about - width)
        each = floor if len(starts) == len(ids) else np.maximum.reduceat(floor[:, by_id], starts, axis=1)
        kth = np.partition(each, -search.k, axis=1)[:, -search.k] if len(starts) > search.k else np.full(len(floor), -np.inf)
        rows, cols = np.nonzero((about + width >= kth[:, None] - 1e-5) & ~own)
        for cut in range(0, len(rows), 65536):
            r, c = rows[cut: cut + 65536], cols[cut: cut + 65536]
            yield low + r, c, cosines(queries[low + r], vectors[c])


def best_of(query_ids, ids, found: Iterator[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, score, row = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    for r, c, s in found:
        at, score, row = np.concatenate([at, r]), np.concatenate([score, s]), np.concatenate([row, ids[c]])
        at, row, score = _top(at, row, score, k)
    return query_ids[at], row, score


def _top(at, row, score, k):
    order = np.lexsort((row, at))
    at, row, score = at[order], row[order], score[order]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    at, row, score = at[first], row[first], score[first]
    order = np.lexsort((row, -score, at))
    at, row, score = at[order], row[order], score[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], row[rank < k], score[rank < k]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a vector that has a length: no null or non-finite component, not all zero."""
    vec = F.col(vec_col)
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & vec.isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), vec.cast("array<float>").alias("vec"), F.size(vec).alias("dim"))


def _bundles(frame: DataFrame, rows: int, seed: int, coded: bool) -> DataFrame:
    """One row per up to ``rows`` vectors of a partition and dimension: ids, vectors and, if ``coded``, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count = 0

        def bundle(dim: int) -> pa.RecordBatch:
            nonlocal count
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
            codes, agreement = encode(vectors, seed) if coded else (np.empty(0, np.uint8), np.empty(0, np.float32))
            count += 1
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "part": pa.array([(TaskContext.get().partitionId() << 32) + count], pa.int64()),
                "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
                "codes": pa.array([codes.tobytes()], pa.binary()), "agreement": pa.array([agreement.tobytes()], pa.binary()),
            })

        for batch in batches:
            dims, ids = batch.column("dim").to_numpy(), batch.column("id").to_numpy()
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                vectors = batch.column("vec").take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                for cut in range(0, len(of), rows):
                    held.setdefault(int(dim), []).append((ids[of[cut: cut + rows]].astype(np.int64), vectors[cut: cut + rows]))
                    if sum(len(x[0]) for x in held[dim]) >= rows:
                        yield bundle(int(dim))
        for dim in list(held):
            yield bundle(dim)

    return frame.mapInArrow(run, "dim int, part long, ids binary, vectors binary, codes binary, agreement binary")


def search(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, plan: Search = Search()) -> DataFrame:
    """Each query's ``k`` nearest rows by cosine: query_id, rank, vec_id, score.

    rows, queries: an id and an array of floats; other columns are not read. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without an id, take no part; vectors of another dimension are no candidates.
    A row never finds its own id. Ties go to the smaller id; a repeated id counts once. No candidates: no rows.
    Codes cover every row; the queries meet all codes in blocks, each meeting in one step of bounded memory.
    """
    spark = rows.sparkSession
    small_batches(spark, plan.chunk)
    coded = stage(_bundles(usable(rows, id_col, vec_col), plan.chunk, plan.seed, True), "codes")
    asked = usable(queries, id_col, vec_col)
    blocks = max(1, -(-asked.count() // plan.block))
    asked = stage(_bundles(asked.repartition(blocks, "id"), plan.block, plan.seed, False), "queries")
    small_batches(spark, 4)
    salts = max(plan.salts, -(-coded.count() // plan.share))
    left = coded.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(salts)))
    right = asked.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids, q_ids = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["q_ids"], np.int64)
                vectors = np.frombuffer(x["vectors"], np.float32).reshape(len(ids), -1)
                asked_vectors = np.frombuffer(x["q_vectors"], np.float32).reshape(len(q_ids), -1)
                codes = np.frombuffer(x["codes"], np.uint8).reshape(len(ids), -1)
                agreement = np.frombuffer(x["agreement"], np.float32)
                query, row, score = best_of(q_ids, ids, nearest(
                    q_ids, asked_vectors, ids, vectors, codes, agreement, plan), plan.k)
                yield pa.RecordBatch.from_pydict({"query_id": query, "vec_id": row, "score": score})

    found = stage(left.join(right, ["dim", "salt"]).drop("part").mapInArrow(meet, "query_id long, vec_id long, score double"), "found")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= plan.k)
        .select("query_id", "rank", "vec_id", "score")
    )
