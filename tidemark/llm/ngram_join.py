"""Word n-gram Jaccard self-join: MinHash bands, Bayesian pruning of candidates, exact verification."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACES, membership, possible, released, small_batches
from tidemark.llm.graph import components
from tidemark.llm.textvec import shingles, word_hashes
from tidemark.session import stage


@dataclass(frozen=True)
class JaccardJoin:
    """A pair at the threshold shares no band with probability (1 - threshold**rows)**bands, here 3e-6, and is pruned with
    about ``tolerance`` after each ``step`` hashes. ``block``: texts of one group that meet others in one step of a task."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    block: int = 1024
    block_shingles: int = 1 << 20
    seed: int = 5

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


@functools.lru_cache(4)
def _hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed).integers(0, 2**32, (2, count), dtype=np.uint64).astype(np.uint32)
    return draw[0] | np.uint32(1), draw[1]


@functools.lru_cache(4)
def least_matches(plan: JaccardJoin) -> tuple[int, ...]:
    """After each step, the fewest matching hashes with which a pair goes on.

    Under a uniform prior the similarity given m of n matches is Beta(m + 1, n - m + 1); a pair goes on while the
    probability of the threshold or more is at least the tolerance.
    """
    s = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(plan.step, plan.hashes + 1, plan.step):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            weight = np.exp(log - log.max())
            if weight[s >= plan.threshold].sum() >= plan.tolerance * weight.sum():
                out.append(m)
                break
    return tuple(out)


def signatures(found: np.ndarray, begin: np.ndarray, plan: JaccardJoin) -> np.ndarray:
    """MinHash values of each text, texts x hashes; zeros for a text without shingles."""
    multiply, flip = _hash_family(plan.hashes, plan.seed)
    out = np.zeros((len(begin) - 1, plan.hashes), np.uint32)
    full = np.diff(begin) > 0
    if full.any():
        base, first = (found >> np.uint64(32)).astype(np.uint32), begin[:-1][full]
        for j in range(plan.hashes):
            out[full, j] = np.minimum.reduceat((base ^ flip[j]) * multiply[j], first)
    return out


def surviving(left: np.ndarray, right: np.ndarray, plan: JaccardJoin) -> np.ndarray:
    """Which pairs of signatures are likely enough, comparing ``step`` hashes at a time."""
    need = least_matches(plan)
    out = np.zeros((len(left), len(right)), bool)
    tile = max(1, (1 << 21) // max(1, len(right) * plan.step))
    for low in range(0, len(left), tile):
        part = left[low: low + tile]
        rows, cols = None, None
        for k, least in enumerate(need):
            at = slice(k * plan.step, (k + 1) * plan.step)
            if rows is None:
                same = (part[:, None, at] == right[None, :, at]).sum(axis=2)
                rows, cols = np.nonzero(same >= least)
                same = same[rows, cols]
            else:
                same = same + (part[rows, at] == right[cols, at]).sum(axis=1)
                on = same >= least
                rows, cols, same = rows[on], cols[on], same[on]
            if not len(rows):
                break
        out[low + rows, cols] = True
    return out


def linked_to(adjacent: np.ndarray) -> np.ndarray:
    """The first node of each node's component in a square table of links."""
    label, was = np.arange(len(adjacent)), None
    while was is None or (label != was).any():
        was = label
        label = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(axis=1, initial=len(label)))
        label = label[label]
    return label


def overlaps(sets: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs, as products of incidence slabs over the elements that two sets share."""
    both = sets + other
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, element, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column = place[element]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(other)), np.float64)
    for low in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        slab = np.zeros((len(both), min(4096, len(shared) - low)), np.float32)
        slab[owner[a:b], column[a:b] - low] = 1
        out += slab[: len(sets)] @ slab[len(sets):].T
    return out


def by_group(work: Callable[[dict[str, list]], dict[str, list]], columns: list[str], schema: pa.Schema):
    """Rows sorted by their first column, handed to ``work`` one group at a time, whatever batches they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in columns}
        out: dict[str, list] = {f.name: [] for f in schema}

        def finish() -> None:
            for name, values in work(held).items():
                out[name].extend(values)
            for values in held.values():
                values.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            for values in out.values():
                values.clear()
            return batch

        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in columns]
            keys = lists[0]
            low = 0
            for high in [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]:
                if held[columns[0]] and low < len(keys) and held[columns[0]][-1] != keys[low]:
                    finish()
                for c, values in zip(columns, lists):
                    held[c].extend(values[low:high])
                low = high
            if len(out[schema.names[0]]) >= 4096:
                yield flush()
        if held[columns[0]]:
            finish()
        yield flush()

    return run


EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])
LINKS = pa.schema([("key", pa.binary()), ("to", pa.binary()), ("links", pa.int64())])


def sketch(docs: DataFrame, plan: JaccardJoin, with_sets: bool = False) -> DataFrame:
    """doc_id, row, key (a digest of the shingle set; null without words), n_shingles, and the signature or the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, begin = shingles(*word_hashes(batch.column("text").to_pylist()), plan.words)
            sets = [np.unique(found[begin[i]: begin[i + 1]]) for i in range(len(begin) - 1)]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            data = [s.tobytes() for s in sets] if with_sets else [s.tobytes() for s in signatures(found, begin, plan)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(keys, pa.binary()), pa.array(map(len, sets), pa.int64()),
                 pa.array(data, pa.binary())],
                ["doc_id", "row", "key", "n_shingles", "data"])

    return docs.mapInArrow(released(run), "doc_id long, row binary, key binary, n_shingles long, data binary")


def row_digest() -> Column:
    """A digest of id and text: equal for rows that repeat both, never null."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("/"),
                                  F.coalesce(F.col("text").cast("string"), F.lit("")))))


def in_blocks(members: DataFrame, group: list[str], blocks, keep: list[str]) -> DataFrame:
    """Each member once for every pair of blocks its own block is part of.

    members hold ``key`` and the group's columns; ``blocks`` is the number of blocks of the member's group. Returns the
    pair of blocks as one number (``meeting``), whether the member is of its first and of its second block, and ``keep``.
    """
    mine = F.pmod(F.xxhash64("key", F.lit(3)), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    pairs = members.withColumn("_blocks", blocks.cast("long")).withColumn("_mine", mine).select("*", other)
    return (
        pairs.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other"))
        .select(F.md5(F.concat_ws("/", *[F.hex(g) for g in group], "_i", "_j")).alias("meeting"),
                (F.col("_mine") == F.col("_i")).alias("first"), (F.col("_mine") == F.col("_j")).alias("second"), *keep)
        .repartition("meeting").sortWithinPartitions("meeting")
    )


def candidate_edges(texts: DataFrame, plan: JaccardJoin) -> DataFrame:
    """Edges (a, b) that connect every pair of texts that shares a band and survives pruning.

    texts: key and signature (data). A bucket's members are counted before they meet; buckets of one are dropped, those
    of many meet in blocks. Of each meeting only a spanning forest is returned, so a dense group gives no more rows than
    it has members.
    """
    width = 4 * plan.rows
    bands = F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(plan.bands - 1)),
        lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring(F.col("data"), b * width + 1, F.lit(width))).alias("bucket"))))
    rows = texts.select("key", bands.alias("x")).select("key", "x.*")
    sizes = rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = rows.join(sizes, ["band", "bucket"]).join(texts.select("key", "data"), "key")

    def work(group: dict[str, list]) -> dict[str, list]:
        sign = np.frombuffer(b"".join(group["data"]), np.uint32).reshape(len(group["key"]), -1)
        first, second = np.array(group["first"]), np.array(group["second"])
        one, two = np.flatnonzero(first), np.flatnonzero(second)
        adjacent = np.zeros((len(sign), len(sign)), bool)
        adjacent[np.ix_(one, two)] = surviving(sign[one], sign[two], plan)
        label = linked_to(adjacent | adjacent.T)
        from_ = np.flatnonzero(label != np.arange(len(label)))
        return {"a": [group["key"][i] for i in from_], "b": [group["key"][i] for i in label[from_]]}

    met = in_blocks(members, ["band", "bucket"], F.ceil(F.col("n") / plan.block), ["key", "data"])
    return met.mapInArrow(released(by_group(work, ["meeting", "first", "second", "key", "data"], EDGES)), "a binary, b binary")


def verified_links(grouped: DataFrame, plan: JaccardJoin) -> DataFrame:
    """(key, to, links): of each meeting, every member's number of partners and one partner of its verified component.

    grouped: key, root, data (signature), n_shingles, shingles (the set). All pairs of a group are pruned by their
    signatures, then compared exactly.
    """
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / (plan.block / 4), F.col("total") / plan.block_shingles))

    def work(group: dict[str, list]) -> dict[str, list]:
        keys, count = group["key"], len(group["key"])
        sign = np.frombuffer(b"".join(group["data"]), np.uint32).reshape(count, -1)
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        sizes = np.array([len(x) for x in sets], float)
        one, two = np.flatnonzero(group["first"]), np.flatnonzero(group["second"])
        likely = surviving(sign[one], sign[two], plan)
        rows, cols = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
        adjacent = np.zeros((count, count), bool)
        if len(rows):
            one, two = one[rows], two[cols]
            common = overlaps([sets[i] for i in one], [sets[i] for i in two])
            union = sizes[one][:, None] + sizes[two][None, :] - common
            adjacent[np.ix_(one, two)] = likely[np.ix_(rows, cols)] & (common >= plan.threshold * union - 1e-9)
        adjacent |= adjacent.T
        np.fill_diagonal(adjacent, False)
        links, label = adjacent.sum(axis=1), linked_to(adjacent)
        at = np.flatnonzero(links)
        return {"key": [keys[i] for i in at], "to": [keys[i] for i in label[at]], "links": links[at].tolist()}

    met = in_blocks(grouped.join(sizes, "root"), ["root"], blocks, ["key", "data", "shingles"])
    return met.mapInArrow(released(by_group(work, ["meeting", "first", "second", "key", "data", "shingles"], LINKS)),
                          "key binary, to binary, links long")


def _classes(docs: DataFrame, plan: JaccardJoin) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of all rows, the different texts with words (key, copy_id and first, their first row), and class_id,
    n_links and class_first (the class's first row) of those that link.

    The first row is that with the least id or, where none has one, the least digest.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         row_digest().alias("row"))
    small_batches(spark, 512)
    sketched = stage(sketch(source, plan), "sketches")
    texts = stage(
        sketched.filter(F.col("key").isNotNull()).groupBy("key").agg(
            F.min("doc_id").alias("copy_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"),
            F.max("data").alias("data"), F.max("n_shingles").alias("n_shingles")),
        "texts")
    near = stage(components(candidate_edges(texts, plan)), "near")
    grouped = near.select(F.col("node").alias("key"), "root").join(texts, "key")
    # Only texts that can be members' first rows are read into sets, which are folded and shuffled once, by their key.
    chosen = possible(source, "row", membership(grouped.select("first.row"), "row"))
    sets = sketch(chosen, plan, with_sets=True).select("key", F.col("data").alias("shingles")).dropDuplicates(["key"])
    grouped = stage(grouped.drop("first").join(sets, "key"), "grouped")
    small_batches(spark, 64)
    links = stage(verified_links(grouped, plan), "links")
    small_batches(spark, 512)
    classes = components(links.select(F.col("key").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    named = classes.select(F.col("node").alias("key"), "root").join(texts.select("key", "copy_id", "first"), "key")
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min("first").alias("class_first"))
    return sketched, texts, named.join(least, "root").join(counts, "key").select("key", "class_id", "class_first", "n_links")


def join(docs: DataFrame, plan: JaccardJoin = JaccardJoin()) -> DataFrame:
    """Class and links of every document: doc_id, class_id, copy_id, n_links.

    docs: doc_id, text; other columns are not read. Words are runs of other characters than ASCII white space, shingles
    are ``words`` of them in a row; a shorter text with words has one shingle, all of it. Documents with equal shingle
    sets are copies and share copy_id, their least doc_id. n_links counts the different sets with a Jaccard similarity
    of ``threshold`` or more; class_id is the least doc_id of all that links and copies connect. Null, empty and blank
    texts have no shingles: each is a class of its own, without links. Repeated rows are copies; null ids are never the
    least, and name a class only if all its ids are null.
    """
    sketched, texts, found = _classes(docs, plan)
    every = texts.select("key", "copy_id").join(found, "key", "left")
    return sketched.select("doc_id", "key").join(every, "key", "left").select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.coalesce("class_id", "copy_id")).alias("class_id"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, plan: JaccardJoin = JaccardJoin()) -> DataFrame:
    """Documents with all their columns, of each class one row: one with the least doc_id or, where no row has an id, one
    of the rows without.

    A row is told by its id and its text together, so other rows of the same id, or without an id, are judged by their own
    text. Documents without words are all kept; rows that repeat an id and a text are copies, but without words and id
    each row is a document.
    """
    sketched, texts, found = _classes(docs, plan)
    first = F.coalesce(F.col("class_first"), F.col("first"))["row"]
    keep = stage(texts.select("key", "first").join(found, "key", "left").select(first.alias("row")).distinct(), "kept")
    counts = sketched.filter(F.col("key").isNotNull()).groupBy("row").agg(F.count("*").alias("n"))
    doubtful = membership(counts.filter("n > 1").select("row").unionByName(counts.join(keep, "row", "left_anti").select("row")), "row")
    # A row that is neither repeated nor dropped stays where it is; only the others are folded and meet those to keep.
    given = docs.select(F.struct(*docs.columns).alias("given"), row_digest().alias("row"), _blank().alias("blank"))
    with_words, wordless = given.filter(~F.col("blank")), given.filter("blank")
    folded = possible(with_words, "row", doubtful).dropDuplicates(["row"]).join(keep, "row")
    rows = possible(with_words, "row", doubtful, inside=False).unionByName(folded.select("given", "row", "blank"))
    named, nameless = wordless.filter(F.col("given.doc_id").isNotNull()), wordless.filter(F.col("given.doc_id").isNull())
    return rows.unionByName(named.dropDuplicates(["row"])).unionByName(nameless).select("given.*")


def _blank() -> Column:
    return F.coalesce(F.length(F.translate(F.col("text").cast("string"), SPACES, "")) == 0, F.lit(True))
