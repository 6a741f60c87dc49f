"""Near-duplicate vectors by an inverted multi-index: codebooks on halves, multi-sequence traversal, exact verification."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import join_by_size, released, small_batches
from tidemark.llm.graph import components
from tidemark.llm.ngram_join import by_group, linked_to
from tidemark.session import stage


@dataclass(frozen=True)
class MultiIndex:
    """``threshold``: least cosine of a link. Codebooks are fitted on at most ``sample`` rows (and ``sample_bytes``), with
    about ``cell_rows`` rows to a cell and at most ``codes`` codewords a half. Cells are visited up to a reach at which
    ``recall`` of the links of ``asked`` sampled vectors, found by brute force over all rows, would be met; 1 visits every
    cell that a link could lie in. ``evidence``: links below which the reach is estimated instead. ``block``: vectors of a
    cell that meet others in one step."""

    threshold: float = 0.93
    recall: float = 0.999
    sample: int = 20000
    sample_bytes: int = 1 << 26
    cell_rows: int = 2048
    codes: int = 256
    asked: int = 256
    evidence: int = 1000
    block: int = 1024

    @property
    def most(self) -> float:
        """The largest squared distance of linked unit vectors."""
        return 2 - 2 * self.threshold + 1e-9


@dataclass(frozen=True)
class Grid:
    """Codewords of the first and of the second half of vectors of one dimension, and how far cells are visited."""

    halves: tuple[np.ndarray, np.ndarray]
    reach: float

    def barriers(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each half, the nearest codeword, and the squared distance to the border towards every codeword's cell.

        A vector nearer to a codeword than to one's own lies beyond the plane between the two, so this is the least
        squared distance of the half to any half in that cell.
        """
        out, cut = [], unit.shape[1] // 2
        for half, words in zip((unit[:, :cut], unit[:, cut:]), self.halves):
            far = (half * half).sum(axis=1)[:, None] - 2 * half @ words.T + (words * words).sum(axis=1)[None, :]
            own = far.argmin(axis=1)
            apart = np.sqrt(np.maximum(((words[:, None, :] - words[None, :, :]) ** 2).sum(axis=2), 1e-30))[own]
            border = np.maximum(far - far[np.arange(len(far)), own][:, None], 0) / (2 * apart)
            border[np.arange(len(far)), own] = 0
            out.append((own, border * border))
        return out

    def cells(self, unit: np.ndarray) -> list[list[int]]:
        """Each vector's own cell, then the cells of higher number in reach, nearest first."""
        (first, a), (second, b) = self.barriers(unit)
        width = len(self.halves[1])
        own = first * width + second
        out = [[c] for c in own.tolist()]
        alone = (np.sort(a, axis=1)[:, 1:2] > self.reach).all(axis=1) & (np.sort(b, axis=1)[:, 1:2] > self.reach).all(axis=1)
        for i in np.flatnonzero(~alone):
            out[i].extend(c for u, v in nearest_cells(a[i], b[i], self.reach) if (c := int(u) * width + int(v)) > out[i][0])
        return out


def nearest_cells(a: np.ndarray, b: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Pairs of entries of two lists by ascending sum, up to ``reach``: the multi-sequence traversal."""
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[by_a].tolist(), b[by_b].tolist()
    ahead = [(a[0] + b[0], 0, 0)]
    while ahead:
        far, i, j = heapq.heappop(ahead)
        if far > reach:
            return
        yield by_a[i], by_b[j]
        if j + 1 < len(b):
            heapq.heappush(ahead, (a[i] + b[j + 1], i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(ahead, (a[i + 1] + b[0], i + 1, 0))


def codewords(vectors: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Means of ``count`` groups of the vectors, from the first different ones; fewer if there are fewer."""
    words = vectors[np.sort(np.unique(vectors, axis=0, return_index=True)[1])[:count]].copy()
    for _ in range(rounds):
        near = ((words * words).sum(axis=1)[None, :] - 2 * vectors @ words.T).argmin(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, vectors)
        size = np.bincount(near, minlength=len(words))
        words = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], words)
    return words


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def linked(one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors have the cosine, decided in double precision wherever single precision could err."""
    near = one.astype(np.float32) @ two.astype(np.float32).T
    out = near >= threshold
    rows, cols = np.nonzero(np.abs(near - np.float32(threshold)) < 1e-4)
    for cut in range(0, len(rows), 65536):
        r, c = rows[cut: cut + 65536], cols[cut: cut + 65536]
        out[r, c] = (one[r] * two[c]).sum(axis=1) >= threshold
    return out


def usable(vec: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def _by_dimension(batch: pa.RecordBatch, number: np.dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places of its rows, their vectors) of a batch's vectors that are not null."""
    vec = batch.column("vec")
    valid = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False))
    vec = vec.take(pa.array(valid))
    sizes = pc.list_value_length(vec).to_numpy(zero_copy_only=False) if len(vec) else np.empty(0, int)
    for dim in np.unique(sizes):
        of = np.flatnonzero(sizes == dim)
        yield int(dim), valid[of], vec.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).astype(number).reshape(-1, dim) + number.type(0)


def _digests(labels: list[str], vectors: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(x.encode() + b"\0" + v.tobytes(), digest_size=16).digest() for x, v in zip(labels, vectors)]


def fit(source: DataFrame, plan: MultiIndex, number: np.dtype) -> dict[int, Grid]:
    """The grids by dimension. Only the bounded sample and the counts of 22 reaches come to the driver."""
    good = source.filter(F.col("vec").isNotNull())
    counts = good.select(F.size("vec").alias("dim")).groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(64).collect()
    grids: dict[int, Grid] = {}
    for dim, n in counts:
        rows = max(1, min(plan.sample, plan.sample_bytes // (8 * dim)))
        wanted = min(plan.codes, math.ceil(math.sqrt(n / plan.cell_rows)), max(1, (1 << 20) // dim), rows // 8)
        if wanted <= 1 or dim < 2:
            continue
        taken = good.filter(F.size("vec") == dim).orderBy(F.xxhash64("id"), "id").limit(rows).select("label", "vec").toArrow()
        vectors = unit(np.stack([np.asarray(v, np.float64) for v in taken.column("vec").to_pylist()]))
        halves = tuple(codewords(x, wanted) for x in (vectors[:, : dim // 2], vectors[:, dim // 2:]))
        full = Grid(halves, plan.most)
        if plan.recall < 1:
            full = Grid(halves, _reach(good, full, vectors[: plan.asked], taken.column("label").to_pylist()[: plan.asked], plan, number))
        grids[dim] = full
    return grids


def _reach(good: DataFrame, grid: Grid, asked: np.ndarray, labels: list[str], plan: MultiIndex, number: np.dtype) -> float:
    """The least of 22 reaches at which ``recall`` of the asked vectors' links is met.

    All rows are compared with the asked vectors; for each link, from the lower of both cells, the squared distance to the
    other is counted. It is no less than the part that a link's two halves have by chance along two given directions; with
    little evidence, the part they have in ``recall`` of all cases.
    """
    dim, width = asked.shape[1], len(grid.halves[1])
    steps = plan.most * 2.0 ** -np.arange(21, -1, -1)
    known = np.array(labels)
    (first, a), (second, b) = grid.barriers(asked)
    cell = first * width + second

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("label").to_pylist(), object)
            for size, at, vectors in _by_dimension(batch, number):
                if size != dim:
                    continue
                mine = unit(vectors)
                rows, cols = np.nonzero(linked(mine, asked, plan.threshold) & (names[at][:, None] == known[None, :]))
                (u, x), (v, y) = grid.barriers(mine)
                here = u * width + v
                far = np.where(here[rows] <= cell[cols], x[rows, first[cols]] + y[rows, second[cols]], a[cols, u[rows]] + b[cols, v[rows]])
                yield pa.RecordBatch.from_pydict({"step": np.searchsorted(steps, far), "n": np.ones(len(far), np.int64)})

    small_batches(good.sparkSession, 4096)
    found = good.select("label", "vec").mapInArrow(released(run), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(steps) + 1, np.int64)
    for step, n in found:
        counts[step] = n
    chance = plan.most / dim
    if counts.sum() < plan.evidence:
        return min(plan.most, -2 * math.log(1 - plan.recall) * chance)
    met = np.searchsorted(np.cumsum(counts) / counts.sum(), plan.recall)
    return max(float(steps[min(met, len(steps) - 1)]), min(plan.most, 2 * chance))


def _places(source: DataFrame, grids: dict[int, Grid], number: np.dtype) -> DataFrame:
    """id, key (a digest of label and vector; null where the vector takes no part), dim, label and cells of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            keys: list[bytes | None] = [None] * len(labels)
            cells: list[list[int] | None] = [None] * len(labels)
            dims = [0] * len(labels)
            for dim, at, vectors in _by_dimension(batch, number):
                found = grids[dim].cells(unit(vectors)) if dim in grids else [[0]] * len(at)
                for i, key, c in zip(at.tolist(), _digests([labels[i] for i in at], vectors), found):
                    keys[i], cells[i], dims[i] = key, c, dim
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), batch.column("label"), pa.array(cells, pa.list_(pa.int32()))],
                ["id", "key", "dim", "label", "cells"])

    return source.mapInArrow(released(run), "id long, key binary, dim int, label string, cells array<int>")


def _vectors(source: DataFrame, number: np.dtype) -> DataFrame:
    """id, key and the vector's bytes of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("id"), batch.column("label").to_pylist()
            for _, at, vectors in _by_dimension(batch, number):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(_digests([labels[i] for i in at], vectors), pa.binary()),
                     pa.array([v.tobytes() for v in vectors], pa.binary())], ["id", "key", "vec"])

    return source.filter(F.col("vec").isNotNull()).mapInArrow(released(run), "id long, key binary, vec binary")


def _meetings(copies: DataFrame, plan: MultiIndex) -> DataFrame:
    """key, copy_id, n and each meeting of blocks that a distinct vector is part of, as one of its first or second block.

    A cell's own vectors meet one another; those that visit it from cells of lower number meet its own. Both sides are
    cut into blocks by hash of the key, so that no cell is gathered anywhere.
    """
    place = ["dim", "label", "cell"]
    spots = stage(copies.select("key", "copy_id", "n", "dim", "label", F.posexplode("cells").alias("at", "cell")), "spots")
    sizes = stage(spots.groupBy(*place).agg(
        F.count(F.when(F.col("at") == 0, 1)).alias("own"), F.count(F.when(F.col("at") > 0, 1)).alias("guests"),
        F.count("*").alias("rows")), "sizes")
    sized = join_by_size(spots, sizes, place, "rows").filter((F.col("own") > 1) | ((F.col("own") > 0) & (F.col("guests") > 0)))
    blocks = [F.ceil(F.col(c) / plan.block).cast("long") for c in ("own", "guests")]
    hashed = F.xxhash64("key", F.lit(13))
    none = F.lit(0).cast("long")

    def met(kind: str, i: Column, j: Column, first: Column, second: Column) -> Column:
        name = F.md5(F.concat_ws("/", F.lit(kind), i, j, "dim", "cell", "label"))
        return F.struct(name.alias("meeting"), first.alias("first"), second.alias("second"))

    def every(count: Column, of) -> Column:
        return F.transform(F.filter(F.sequence(none, count), lambda x: x < count), of)

    at = F.pmod(hashed, F.greatest(F.when(F.col("at") == 0, F.col("_own")).otherwise(F.col("_guests")), F.lit(1)))
    mine = F.col("_mine")
    same = every(F.col("_own"), lambda x: met("own", F.least(mine, x), F.greatest(mine, x), mine <= x, mine >= x))
    hosts = every(F.col("_guests"), lambda x: met("guests", mine, x, F.lit(True), F.lit(False)))
    visits = every(F.col("_own"), lambda x: met("guests", x, mine, F.lit(False), F.lit(True)))
    return sized.withColumn("_own", blocks[0]).withColumn("_guests", blocks[1]).withColumn("_mine", at).select(
        "key", "copy_id", "n", F.explode(F.when(F.col("at") == 0, F.concat(same, hosts)).otherwise(visits)).alias("x")
    ).select("key", "copy_id", "n", "x.*")


def links(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, plan: MultiIndex = MultiIndex()) -> DataFrame:
    """Direct links and component of every row: vec_id, n_links, component_id, kept.

    vectors: an id, a label and an array of numbers; other columns are not read. Rows link if their labels are equal and
    their cosine is at least ``threshold``; dimensions must be equal. Every row is a vector of its own, also where ids or
    whole rows repeat. component_id is the least id that links reach, kept says that it is the row's own. Rows whose id or
    label is null, or whose vector is null, empty, zero or holds null or non-finite components link with nothing and are
    kept; component_id is their id. An empty table gives no rows. Equal vectors of a label are folded to one with a
    multiplicity; every row is placed in the grid; meetings return counts and a spanning forest, never their pairs.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    number = np.dtype(np.float32 if single else np.float64)
    label, vec = F.col(label_col).cast("string"), F.col(vec_col).cast("array<float>" if single else "array<double>")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"),
                            F.when(usable(vec) & label.isNotNull() & F.col(id_col).isNotNull(), vec).alias("vec"))
    small_batches(spark, 4096)
    grids = fit(source, plan, number)
    small_batches(spark, 1024)
    places = stage(_places(source, grids, number), "places")
    copies = stage(places.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("id").alias("copy_id"), F.count("*").alias("n"), F.max("dim").alias("dim"), F.max("label").alias("label"),
        F.max("cells").alias("cells")), "copies")
    meetings = _meetings(copies, plan).withColumnRenamed("copy_id", "id")
    loaded = _vectors(source, number).dropDuplicates(["id", "key"]).join(meetings, ["id", "key"])

    def work(group: dict[str, list]) -> dict[str, list]:
        keys, n = group["key"], np.array(group["n"], np.int64)
        mine = unit(np.frombuffer(b"".join(group["vec"]), number).reshape(len(keys), -1))
        one, two = np.flatnonzero(group["first"]), np.flatnonzero(group["second"])
        adjacent = np.zeros((len(keys), len(keys)), bool)
        adjacent[np.ix_(one, two)] = linked(mine[one], mine[two], plan.threshold)
        adjacent |= adjacent.T
        np.fill_diagonal(adjacent, False)
        at = np.flatnonzero(adjacent.any(axis=1))
        label = linked_to(adjacent)
        return {"key": [keys[i] for i in at], "to": [keys[i] for i in label[at]], "links": (adjacent[at] @ n).tolist()}

    schema = pa.schema([("key", pa.binary()), ("to", pa.binary()), ("links", pa.int64())])
    met = loaded.select("meeting", "first", "second", "key", "n", "vec").repartition("meeting").sortWithinPartitions("meeting")
    found = stage(met.mapInArrow(released(by_group(work, ["meeting", "first", "second", "key", "n", "vec"], schema)),
                                 "key binary, to binary, links long"), "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = stage(components(found.select(F.col("key").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("key"), "root")
                  .join(copies.select("key", "copy_id"), "key"), "named")
    least = named.groupBy("root").agg(F.min("copy_id").alias("least"), F.count("*").alias("size"))
    reached = join_by_size(named, stage(least, "least"), ["root"], "size").select("key", "least")
    result = stage(
        copies.select("key", "copy_id", "n").join(counts, "key", "left").join(reached, "key", "left").select(
            "key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "copy_id").alias("component_id")),
        "result")
    taking = join_by_size(places.filter(F.col("key").isNotNull()).select("id", "key"), result, ["key"], "n")
    alone = places.filter(F.col("key").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return taking.select("id", "n_links", "component_id").unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
