"""Vector bin packing of token pieces under several limits at once."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import released, small_batches
from tidemark.llm.tokens import WordIds


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. ``pool`` is how many pieces a task weighs against each other."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048
    pool: int = 1024


GONE = 1e18


class Packer:
    """Fills one sequence after another from a bounded pool of pieces.

    Of the pieces that fit all limits, the one whose demand vector has the largest dot product with what the open
    sequence has left goes in. Where none fits but tokens, segments and loss are left, the largest piece is cut to
    the gap; its rest returns to the pool.
    """

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence = limits, first_sequence
        self.scale = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.items: list[tuple] = []
        self.demand = np.empty((0, 3))

    def loss_of(self, item: tuple) -> int:
        _, start, length, prompt = item[:4]
        return max(0, start + length - max(start, prompt))

    def add(self, items: list[tuple]) -> None:
        """Items: (document, start, length, tokens without loss at the document's head)."""
        if items:
            new = np.array([(i[2], 1, self.loss_of(i)) for i in items], float)
            self.items += items
            self.demand = np.concatenate([self.demand, new])

    def sequences(self, keep: int) -> Iterator[tuple[int, list[tuple]]]:
        """Sequences until at most ``keep`` pieces are in the pool. Placed pieces get a demand that nothing can hold."""
        waiting = len(self.items)
        while waiting > keep:
            left, placed, demand = self.scale.copy(), [], self.demand
            while left[0] > 0 and left[1] > 0:
                value = np.where((demand <= left).all(axis=1), demand @ (left / self.scale**2), -1.0)
                best = int(np.argmax(value))
                if value[best] >= 0:
                    placed.append(self.items[best])
                    left -= demand[best]
                    demand[best] = GONE
                    waiting -= 1
                    continue
                cut = self._cut(left)
                if cut is None:
                    break
                placed.append(cut)
                left -= (cut[2], 1, self.loss_of(cut))
            yield self.sequence, placed
            self.sequence += 1
        alive = self.demand[:, 0] < GONE
        self.items = [x for x, a in zip(self.items, alive) if a]
        self.demand = self.demand[alive]

    def _cut(self, left: np.ndarray) -> tuple | None:
        size = np.where(self.demand[:, 0] < GONE, self.demand[:, 0], 0)
        at = int(np.argmax(size))
        if size[at] < 2:
            return None
        doc, start, length, prompt = self.items[at]
        head = min(int(left[0]), length - 1, max(0, prompt - start) + int(left[2]))
        if head < 1:
            return None
        self.items[at] = rest = (doc, start + head, length - head, prompt)
        self.demand[at] = (rest[2], 1, self.loss_of(rest))
        return (doc, start, head, prompt)


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


@functools.lru_cache(1)
def worker_words(path: str) -> WordIds:
    """One memory of words for all tasks of a worker."""
    return WordIds(path)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), with_ids: bool = True,
                   prompt: str | None = None) -> DataFrame:
    """Token pieces of every document, placed in sequences.

    docs: doc_id, text and, if ``prompt`` names one, a column with the number of leading tokens that bear no loss.
    A null text is the empty text: its only id is the end id. Repeated rows are packed each for itself. Every id of
    every document is in exactly one piece; sequences have no gap. No shuffle: a task tokenises its own rows and packs
    them from a bounded pool, so a sequence holds documents of one task; its last sequence may be partly filled.
    Other columns are not read. ``ids`` holds the piece's ids as little-endian 32-bit numbers if ``with_ids``.
    """
    small_batches(docs.sparkSession, 1024)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         (F.coalesce(F.col(prompt).cast("long"), F.lit(0)) if prompt else F.lit(0).cast("long")).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(tokenizer)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []

        def place(sequence: int, pieces: list[tuple]) -> None:
            offset = 0
            for (doc_id, ids), start, length, _ in pieces:
                part = ids[4 * start: 4 * (start + length)]
                out.append((doc_id, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset,
                            bytes(part) if with_ids else None))
                offset += length

        def flush() -> pa.RecordBatch:
            rows = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, PIECES)], schema=PIECES)

        step = min(limits.tokens, limits.loss)
        for batch in batches:
            ids = words.encode(batch.column("text").to_pylist())
            tails = []
            for doc_id, mine, head in zip(batch.column("doc_id").to_pylist(), ids, batch.column("prompt").to_pylist()):
                doc, n = (doc_id, memoryview(mine)), len(mine) // 4
                full = n // step if step == limits.tokens else 0
                for k in range(full):
                    place(packer.sequence, [(doc, k * step, step, head)])
                    packer.sequence += 1
                tails += [(doc, s, min(step, n - s), head) for s in range(full * step, n, step)]
            packer.add(tails)
            if len(packer.items) >= limits.pool:
                for sequence, pieces in packer.sequences(limits.pool // 4):
                    place(sequence, pieces)
            if len(out) >= 4096:
                yield flush()
        for sequence, pieces in packer.sequences(0):
            place(sequence, pieces)
        if out:
            yield flush()

    packed = source.mapInArrow(released(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long, ids binary")
    return packed if with_ids else packed.drop("ids")
