"""Personal data in texts: exact patterns, and what a character tagger adds to them."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import char_tagger
from tidemark.llm.char_tagger import PAD, Training, symbols
from tidemark.llm.common import one_per_id, released, small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


@dataclass(frozen=True)
class Finder:
    """``rows``: at most so many documents are learned from, those with the smallest hash of their id among those that
    hold a digit or an at sign, with one text each, and from at most ``windows`` windows of them all, those with the
    smallest hash. Windows reach ``context`` characters beyond such a character and start ``stride`` apart."""

    rows: int = 3000
    windows: int = 12000
    context: int = 32
    stride: int = 64
    at_once: int = 1024
    training: Training = Training()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(kind, start, end) of the exact patterns, by kind and start; and the matches whose check failed though their shape
    is that of their kind. Each character is looked at a bounded number of times."""
    found: list[Span] = []
    unsure: list[Span] = []
    if not _TRIGGER.search(text):
        return found, unsure
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((0, start, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        good = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))
        (found if good else unsure).append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
        elif 13 <= len(digits) <= 19:
            unsure.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        good = 8 <= sum(c.isdigit() for c in m.group()) <= 15
        (found if good else unsure).append((3, m.start(), m.end()))
    return found, unsure


def windows_of(text: str, finder: Finder) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows that cover every digit and at sign with its context.

    Every kind needs such a character, so the rest of a text cannot begin or hold a span.
    """
    out, width, until = [], finder.training.width, -1
    low = None
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if low is not None and at - finder.context <= until:
            until = at + finder.context
            continue
        if low is not None:
            out += _cut(low, min(until, len(text)), width, finder.stride)
        low, until = max(0, at - finder.context), at + finder.context
    if low is not None:
        out += _cut(low, min(until, len(text)), width, finder.stride)
    return out


def _cut(low: int, high: int, width: int, stride: int) -> list[tuple[int, int]]:
    starts = range(low, max(low + 1, high - width + stride), stride)
    return [(s, min(s + width, high)) for s in starts]


def _filled(codes: np.ndarray, windows: list[tuple[int, int]], width: int) -> np.ndarray:
    ids = np.full((len(windows), width), PAD, np.int64)
    for row, (s, e) in enumerate(windows):
        ids[row, : e - s] = codes[s:e]
    return ids


@dataclass(frozen=True)
class Tagger:
    """Learned parameters and how to apply them."""

    parameters: dict
    finder: Finder

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """Spans of the tagger that overlap no base span and have their kind's shape.

        Windows of all texts are decoded together; where two overlap, a character takes the tag of the window in whose
        inside it lies deeper.
        """
        out: list[list[Span]] = [[] for _ in texts]
        work = [(i, w) for i, text in enumerate(texts) for w in windows_of(text, self.finder)]
        codes = {i: symbols(texts[i]) for i in {i for i, _ in work}}
        width = self.finder.training.width
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for low in range(0, len(work), self.finder.at_once):
            part = work[low: low + self.finder.at_once]
            ids = np.concatenate([_filled(codes[i], [w], width) for i, w in part])
            for (i, (s, e)), tags in zip(part, char_tagger.decode(self.parameters, ids)):
                if tags[: e - s].any():
                    held.setdefault(i, []).append((s, e, tags[: e - s]))
                elif i in held:
                    held[i].append((s, e, tags[: e - s]))
        for i, found in held.items():
            out[i] = [x for x in _reconciled(found) if _fits(texts[i], x) and not any(s < x[2] and x[1] < e for _, s, e in base[i])]
        return out


def _reconciled(found: list[tuple[int, int, np.ndarray]]) -> list[Span]:
    spans, run = [], []
    for s, e, tags in found:
        if run and s >= run[-1][1]:
            spans += _spans_of(run)
            run = []
        run.append((s, e, tags))
    return spans + _spans_of(run)


def _spans_of(run: list[tuple[int, int, np.ndarray]]) -> list[Span]:
    low, high = run[0][0], max(e for _, e, _ in run)
    tag, depth = np.zeros(high - low, np.int64), np.full(high - low, -1)
    for s, e, tags in run:
        inside = np.minimum(np.arange(e - s), np.arange(e - s)[::-1])
        deeper = inside > depth[s - low: e - low]
        tag[s - low: e - low][deeper] = tags[deeper]
        depth[s - low: e - low][deeper] = inside[deeper]
    spans, start = [], None
    for k in range(len(tag) + 1):
        now = tag[k] if k < len(tag) else 0
        if start is not None and (now == 0 or now % 2 == 1 or (now - 1) // 2 != (tag[k - 1] - 1) // 2):
            spans.append(((int(tag[k - 1]) - 1) // 2, low + start, low + k))
            start = None
        if now and start is None:
            start = k
    return spans


def _fits(text: str, span: Span) -> bool:
    """Whether an added span looks like its kind, passes its check (octets, check digit) and is not part of a longer word."""
    kind, start, end = span
    body = text[start:end]
    edge = lambda c: not (c.isalnum() or c in "_")
    if (start and not edge(text[start - 1])) or (end < len(text) and not edge(text[end])):
        return False
    digits = sum(c in "0123456789" for c in body)
    if kind == 0:
        name, _, host = body.partition("@")
        return bool(name and host) and not any(c.isspace() for c in body)
    if kind == 1:
        parts = body.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        shaped = 15 <= digits <= 19 and all(c in "0123456789 -" for c in body) and body[0].isdigit() and body[-1].isdigit()
        return shaped and luhn(body.replace(" ", "").replace("-", ""))
    return 8 <= digits <= 15 and all(c in "0123456789 ().-+" for c in body)


def windows_with_tags(text: str, finder: Finder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and tags (0, or 2 kind + 1 at a span's first character and 2 kind + 2 after it) of a text's training windows.

    Windows that touch a match of doubtful standing, shaped like its kind but failing its check, teach nothing.
    """
    width = finder.training.width
    base, unsure = base_spans(text)
    tag = np.zeros(len(text), np.int64)
    for kind, s, e in base:
        tag[s:e] = 2 * kind + 2
        tag[s] = 2 * kind + 1
    unsure = [(a, b) for _, a, b in unsure if not tag[a:b].any()]
    for s, e in windows_of(text, finder):
        if not any(a < e and s < b for a, b in unsure):
            yield _filled(symbols(text[s:e]), [(0, e - s)], width)[0], np.pad(tag[s:e], (0, width - (e - s)))


def labelled_windows(texts: list[str], finder: Finder) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of the first ``windows`` training windows of the texts, and those side by side."""
    return _taught(list(itertools.islice((x for text in texts for x in windows_with_tags(text, finder)), finder.windows)), finder)


def _taught(found: list[tuple[np.ndarray, np.ndarray]], finder: Finder) -> tuple[np.ndarray, np.ndarray]:
    width = finder.training.width
    ids, tags = (np.array([x[k] for x in found], np.int64).reshape(-1, width) for k in (0, 1))
    more = side_by_side(ids, tags)
    return np.concatenate((ids, more[0])), np.concatenate((tags, more[1]))


def side_by_side(ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows in which the span of the next window with one stands behind a space after the window's own span.

    The exact patterns run neighbouring numbers together and fail; here the tagger learns to tell them apart.
    """
    width, out, spans = ids.shape[1], [], []
    for row in range(len(ids)):
        heads = np.flatnonzero(tags[row] % 2 == 1)
        if len(heads) == 1:
            inside = np.flatnonzero(tags[row])
            spans.append((row, int(inside[0]), int(inside[-1]) + 1))
    space = symbols(" ")
    for (row, _, end), (other, low, high) in zip(spans, spans[1:]):
        out.append([np.concatenate((mine[row, :end], gap, mine[other, low:high], mine[row, end:]))[:width]
                    for mine, gap in ((ids, space), (tags, np.zeros(1, np.int64)))])
    new = np.array(out, np.int64).reshape(-1, 2, width)
    return new[:, 0], new[:, 1]


def training_windows(docs: DataFrame, finder: Finder) -> DataFrame:
    """doc_id, place, ids and tags of at most ``windows`` windows, those with the least hash over all sampled documents.

    The sample has one text of each of its ids. Windows are cut in the tasks, so no whole text comes to the driver.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).filter(text.rlike("[0-9@]"))
    chosen = rows.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(finder.rows)
    sample = one_per_id(rows.join(F.broadcast(chosen), "doc_id", "left_semi")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                windows = enumerate(windows_with_tags(text, finder))
                while part := list(itertools.islice(windows, finder.at_once)):
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([doc_id] * len(part), pa.int64()), "place": pa.array([k for k, _ in part], pa.int64()),
                        "ids": pa.array([x.tobytes() for _, (x, _) in part], pa.binary()),
                        "tags": pa.array([x.tobytes() for _, (_, x) in part], pa.binary())})

    small_batches(docs.sparkSession)
    found = sample.mapInArrow(released(run), "doc_id long, place long, ids binary, tags binary")
    return found.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(finder.windows)


def learn(docs: DataFrame, finder: Finder = Finder()) -> Tagger:
    """A tagger taught by the exact patterns' spans in a bounded sample of windows of documents."""
    found = training_windows(docs, finder).orderBy(F.xxhash64("doc_id"), "doc_id", "place").select("ids", "tags").collect()
    ids, tags = _taught([(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["tags"], np.int64)) for r in found], finder)
    return Tagger(char_tagger.fit(ids, tags, 2 * len(KINDS) + 1, finder.training), finder)


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, the counts and digest of the exact patterns' spans, and all spans as text (kind:start:end, comma-joined).

    docs: doc_id, text; other columns are not read. Null texts are empty. Positions are code points, ends exclusive.
    Whole texts of any length are searched; repeated rows each give their row. No shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            base = [base_spans(x)[0] for x in texts]
            more = tagger.added(texts, base)
            counts = [[sum(k == kind for k, _, _ in spans) for spans in base] for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(described(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array([described(b + m) for b, m in zip(base, more)], pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        released(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with personal data replaced in text, and n_chars, if there, counted anew. A null text stays null."""
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("text").to_pylist()
            texts = [x or "" for x in given]
            base = [base_spans(x)[0] for x in texts]
            spans = [b + m for b, m in zip(base, tagger.added(texts, base))]
            new = [x if x is None or not s else redacted(x, s) for x, s in zip(given, spans)]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, kept)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(released(run), schema)
