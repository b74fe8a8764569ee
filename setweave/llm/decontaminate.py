"""Benchmark decontamination by greedy string tiling (operator 7).

A benchmark item's token windows are looked up in a document's (shared-token seeds, by a running
Karp-Rabin hash).  Where enough of an item is touched, the two are tiled: the longest match of
tokens that aren't yet covered is marked, again and again, down to MIN_MATCH tokens.  Tiles may
stand in any order, so reordered passages count.  A document is contaminated by an item of which
its tiles cover COVERAGE or more.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

MIN_MATCH = 5
COVERAGE = 0.5
#: Bytes of benchmark text that one pass over the documents carries to each worker.
BLOCK_BYTES = 32_000_000
STRIP = b".,;:!?\"'()[]{}<>|*#$%&"
BASE = 1_000_003
CACHE_WORDS = 200_000


class Tokens(dict):
    """Word -> number of its bare form in the benchmark's vocabulary, 0 for any other, -1 where nothing is left of it."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(STRIP)
        number = self.vocabulary.get(bare, 0) if bare else -1
        if len(self) < CACHE_WORDS:
            self[word] = number
        return number


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def bare_tokens(text: str | None) -> list[bytes]:
    return [b for w in words_of(text) if (b := w.strip(STRIP))]


def running(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64, then mixed) of all windows of k tokens."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(BASE) + ids[i : i + n].astype(np.uint64)
        h ^= h >> np.uint64(31)
        return h * np.uint64(0x9E3779B97F4A7C15)


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(item start, doc start, length) of greedy string tiling: longest first; ties go to the item's, then the document's leftmost."""
    k = min(min_match, len(item))
    if not k or len(doc) < k:
        return []
    a, b = running(item, k), running(doc, k)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    at = np.flatnonzero(hi > lo)
    if not len(at):
        return []
    i = np.concatenate([order[x:y] for x, y in zip(lo[at], hi[at], strict=True)])
    j = np.repeat(at, hi[at] - lo[at])
    # seeds in a row on a diagonal make one maximal match
    o = np.lexsort((i, j - i))
    i, j = i[o], j[o]
    cut = np.flatnonzero((np.diff(j - i) != 0) | (np.diff(i) != 1))
    first, last = np.append(0, cut + 1), np.append(cut, len(i) - 1)
    heap = [(-(int(i[y] - i[x]) + k), int(i[x]), int(j[x])) for x, y in zip(first, last, strict=True)]
    heapq.heapify(heap)
    used_i, used_j, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, x, y = heapq.heappop(heap)
        free = ~(used_i[x : x - n] | used_j[y : y - n])
        if free.all():
            used_i[x : x - n] = used_j[y : y - n] = True
            out.append((x, y, -n))
            continue
        # what is left of it competes again by its own length
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= k:
                heapq.heappush(heap, (-(e - s), x + s, y + s))
    return out


class Benchmark:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, coverage: float):
        self.min_match, self.coverage = min_match, coverage
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.tokens = [], []
        for item, text in items:
            words = bare_tokens(text)
            if words:
                self.ids.append(item)
                self.tokens.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({min(min_match, len(t)) for t in self.tokens}):
            own = [(running(t, k), n) for n, t in enumerate(self.tokens) if min(min_match, len(t)) == k]
            keys, owner = np.concatenate([h for h, _ in own]), np.repeat([n for _, n in own], [len(h) for h, _ in own])
            order = np.lexsort((owner, keys))
            self.by_length[k] = keys[order], owner[order]
        self.cache = Tokens(self.vocabulary)

    def find(self, text: str | None) -> list[tuple[int, float]]:
        """(item, coverage) of the items that contaminate a text, sorted by item."""
        words = words_of(text)
        ids = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        ids = ids[ids >= 0]
        touched: dict[int, int] = {}
        for k, (keys, owner) in self.by_length.items():
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            whole = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else np.empty(0, int)
            if not len(whole):
                continue
            h = running(ids, k)[whole]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            for x, y in set(zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True)):
                for n in owner[x:y].tolist():
                    touched[n] = touched.get(n, 0) + 1
        found: dict[int, float] = {}
        for n, seeds in touched.items():
            item = self.tokens[n]
            if seeds * min(self.min_match, len(item)) < self.coverage * len(item):
                continue
            share = sum(t[2] for t in tiles(item, ids, self.min_match)) / len(item)
            if share >= self.coverage:
                found[self.ids[n]] = max(share, found.get(self.ids[n], 0))
        return sorted(found.items())


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``block_bytes``, all rows of an item in one; each is one pass over the documents."""
    items = shared.project(benchmark, "item_id", "text").dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    for n in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == n).collect()
        yield sorted((r["item_id"], r["text"]) for r in rows)


#: The block that this worker last built the seeds of, by the name of its pass.
_built: dict[str, Benchmark] = {}


def _seeds(name: str, index) -> Benchmark:
    if name not in _built:
        _built.clear()
        _built[name] = Benchmark(*index.value)
    return _built[name]


_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))


def _matched(docs: DataFrame, benchmark: DataFrame, min_match: int, coverage: float, block_bytes: int) -> DataFrame:
    """(row, items): every row of ``docs`` as a struct, with what contaminates its text.

    Blocks come one after the other: a further block reads what the last pass wrote, and by then the
    last block is dropped from driver and workers, so that one block is held at a time.
    """
    spark = docs.sparkSession
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.array().cast("array<struct<item_id:long,coverage:double>>").alias("items"))
    last, at = None, docs.columns.index("text")
    for items in _blocks(benchmark, block_bytes):
        if last is not None:
            written = shared.materialize(out, "matched")
            last[0].destroy()
            shared.discard(last[1])
            out, last = written, (None, written)
        index, name = spark.sparkContext.broadcast((items, min_match, coverage)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], index=index, name=name) -> Iterator[pa.RecordBatch]:
            own = _seeds(name, index)
            for b in batches:
                texts, before = b.column(0).field(at), b.column(1).to_pylist()
                found = [sorted([*((x["item_id"], x["coverage"]) for x in old), *own.find(t.as_py())]) for t, old in zip(texts, before, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"item_id": i, "coverage": c} for i, c in f] for f in found], _FOUND)], names=["row", "items"])

        last = (index, last[1] if last else None)
        out = out.mapInArrow(run, out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, items (array of item_id, coverage, sorted) of every row of ``docs``.

    A null or empty text matches nothing; items without a token match nothing, and items of fewer
    than ``min_match`` tokens only as a whole; an item given several times counts once (by best
    coverage); repeated rows are tested each; an empty table on either side gives no matches; other
    columns aren't read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _matched(d, benchmark, min_match, coverage, block_bytes).select("row.doc_id", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (all columns) without the documents that some item contaminates."""
    d = _matched(docs, benchmark, MIN_MATCH, COVERAGE, block_bytes).filter(F.size("items") == 0)
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(shared.read_table(spark, sf_dir, "documents"), shared.read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("items") > 0).alias("contaminated"),
        F.coalesce(F.round(F.array_max(F.transform("items", lambda x: x["coverage"])), 6), F.lit(0.0)).alias("max_coverage"),
        F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"),
    )


SQL = None  # tiling is a greedy loop; tests compare with a plain version of it
