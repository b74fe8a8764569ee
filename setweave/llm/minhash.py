"""Links between items whose shingle sets are alike: MinHash banding, signatures, full sets.

1. A scan gives every item a key for each band of its minima, and, where sets are large, one byte of
   each of the minima as its signature.
2. Items with a key in common share a bucket.  Each bucket's items are paired with three of its
   members (its pivots), not with each other.  Pairs whose signatures agree enough are confirmed
   on the full sets, and confirmed links give components.
3. Buckets that still span several components are compared in blocks: one task holds the items of a
   block pair and compares the signatures of those of different components.  Items that agree with
   another one fetch their full sets, and the same blocks are compared on these.  What leaves a task
   is one link for each two components that it joins, so a bucket of any size is compared
   completely, without a row for each of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import components, shared
from .shingles import Minima, WordHashes, shingle_set, shingle_sets, words_of

#: Items of a block; two blocks' signatures are compared by one task at a time.
BLOCK = 1024
#: Standard errors that a signature may fall short of the threshold before a pair is given up.
SLACK = 5.0
PIVOTS = 3
SCAN = "id long, n_shingles long, set_key long, set_key2 long, sig binary, bands array<long>"


#: Characters of text whose sets are made at once.
CHUNK_CHARS = 1_000_000


def scan(items: DataFrame, minima: Minima) -> DataFrame:
    """``items`` (id long, text): set size, 128-bit key of the set, signature and band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            words, size, first = [], 0, 0
            for text in batch.column(1).to_pylist():
                words.append(words_of(text))
                size += len(text or "")
                if size >= CHUNK_CHARS:
                    yield scanned(batch.column(0).slice(first, len(words)), words, minima, cache)
                    words, size, first = [], 0, first + len(words)
            if words:
                yield scanned(batch.column(0).slice(first, len(words)), words, minima, cache)

    return items.select("id", "text").mapInArrow(run, SCAN)


def scanned(ids: pa.Array, words: list[list[bytes]], minima: Minima, cache: WordHashes, signed: bool = True) -> pa.RecordBatch:
    """The rows of ``scan`` for items that are given as words; without ``sig`` if not ``signed``."""
    h, owner = shingle_sets(words, cache)
    n = np.bincount(owner, minlength=len(words)).astype(np.int64)
    has = np.flatnonzero(n)
    start = (np.cumsum(n) - n)[has]
    keys = np.zeros((2, len(words)), np.uint64)
    m = np.empty((0, minima.size), np.uint32)
    if len(has):
        m = minima(h, start)
        with np.errstate(over="ignore"):
            keys[0, has] = np.bitwise_xor.reduceat(h, start)
            keys[1, has] = np.add.reduceat(h * h + h, start)

    def offsets(width: int) -> pa.Array:
        ends = np.zeros(len(words) + 1, np.int32)
        ends[1:] = np.cumsum((n > 0) * width)
        return pa.array(ends)

    columns = {"id": ids, "n_shingles": pa.array(n), "set_key": pa.array(keys[0].view(np.int64)), "set_key2": pa.array(keys[1].view(np.int64))}
    if signed:
        data = pa.py_buffer(np.ascontiguousarray(m.astype(np.uint8)).tobytes())
        columns["sig"] = pa.Array.from_buffers(pa.binary(), len(words), [None, offsets(minima.size).buffers()[1], data])
    columns["bands"] = pa.ListArray.from_arrays(offsets(minima.bands), pa.array(minima.band_keys(m).reshape(-1)))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def full_sets(items: DataFrame) -> DataFrame:
    """(id, s): the whole shingle set as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            sets = [shingle_set(words_of(t), cache).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    return items.select("id", "text").mapInArrow(run, "id long, s binary")


def _signatures(sets: DataFrame, minima: Minima) -> DataFrame:
    """(id, sig) from full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1)]
            size = np.array([len(x) for x in parts])
            m = minima(np.concatenate(parts), np.cumsum(size) - size).astype(np.uint8) if len(parts) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in m], pa.binary())], names=["id", "sig"])

    return sets.filter(F.octet_length("s") > 0).mapInArrow(run, "id long, sig binary")


def _agree(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum())


def least_agreeing(n: int, percent: int) -> int:
    """Signature bytes that must agree: the expected number at the threshold less SLACK standard errors."""
    s = percent / 100
    return int(np.floor(n * s - SLACK * np.sqrt(n * s * (1 - s))))


def _alike_signatures(pairs: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_agree(x, y) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = signatures.select(F.col("id").alias("a"), F.col("sig").alias("sa")), signatures.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |a & b| >= percent * |a | b| on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _in_blocks(members: DataFrame) -> DataFrame:
    """members (key, id, c, n) dealt over block pairs (key, lo, hi), each item once for each block of its bucket."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    d = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return d.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "c")


def _spread(blocks: DataFrame) -> DataFrame:
    """Block pairs over all shuffle partitions: their work is the square of their rows, so few bytes mustn't mean few tasks."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "lo", "hi")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups (equal key, lo, hi) of rows that come sorted, and where each group begins, with the end."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None and rest.num_rows:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key, lo, hi = (batch.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        if len(cut):
            yield batch.slice(0, int(cut[-1])), np.append(0, cut)
        rest = batch.slice(int(cut[-1]) if len(cut) else 0)
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _others(i: int, comp: np.ndarray, block: np.ndarray, one_block: bool) -> np.ndarray:
    """Later items of a block pair that item i is to be compared with there."""
    j = np.arange(i + 1, len(comp))
    return j[(comp[j] != comp[i]) & ((block[j] != block[i]) | one_block)]


def _with_partners(blocks: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """Rows of ``blocks`` whose signature agrees with that of an item of another component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches):
            lo, hi, own, c = (batch.column(k).to_numpy() for k in (1, 2, 3, 5))
            every = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(6)])
            hit = np.zeros(batch.num_rows, bool)
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                comp, block, sig, found, one = c[a:z], own[a:z], every[a:z], hit[a:z], lo[a] == hi[a]
                for i in range(z - a - 1):
                    j = _others(i, comp, block, one)
                    alike = j[(sig[j] == sig[i]).sum(1) >= least]
                    if len(alike):
                        found[i] = found[alike] = True
            yield batch.filter(pa.array(hit)).select(["key", "lo", "hi", "own", "id", "c"])

    d = _spread(blocks.join(signatures, "id").select("key", "lo", "hi", "own", "id", "c", "sig"))
    return d.sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "key long, lo int, hi int, own int, id long, c long")


def _block_links(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) confirmed on full sets that join the components of each block pair: at most one fewer than its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches):
            lo, hi, own, ids, c = (batch.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            every, links = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(6)], []
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                links += _joined(ids[a:z], c[a:z].copy(), own[a:z], every[a:z], lo[a] == hi[a], percent)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    d = _spread(blocks.join(sets, "id").select("key", "lo", "hi", "own", "id", "c", "s"))
    return d.sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def _joined(ids: np.ndarray, comp: np.ndarray, block: np.ndarray, sets: list[np.ndarray], one: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of one block pair's items."""
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    mark, links = np.zeros(number.max() + 1, np.int64), []
    for i in range(len(ids) - 1):
        j = _others(i, comp, block, one)
        if not len(j):
            continue
        own = number[start[i] : start[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[number], start)
        mark[own] = 0
        alike = 100 * both >= percent * (size + size[i] - both)
        for k in j[alike[j]].tolist():
            if comp[k] != comp[i]:
                links.append((int(ids[i]), int(ids[k])))
                comp[comp == comp[k]] = comp[i]
    return links


def link_components(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], minima: Minima, percent: int) -> DataFrame:
    """(id, component) of every id of ``rows`` that is linked to another.

    ``rows``: id, bands, and sig if sets are large, of items with different non-empty sets.  ``sets_of``
    gives (id, s) of the ids in its argument's column id.
    """
    spark, least = rows.sparkSession, least_agreeing(minima.size, percent)
    keyed = rows.select("id", F.explode("bands").alias("key"))
    buckets = shared.materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared.release(spark)
    members = shared.materialize(keyed.join(shared.few(buckets, 2), "key").select("key", "id", "n"), "members")
    shared.discard(buckets)
    shared.release(spark)
    pivots = members.groupBy("key").agg(
        F.min("id").alias("p0"), *[F.min(F.struct(F.xxhash64("id", F.lit(r)), F.col("id"))).getField("id").alias(f"p{r}") for r in range(1, PIVOTS)]
    )
    pivots = shared.materialize(pivots, "pivots")
    paired = members.join(shared.few(pivots, 1 + PIVOTS), "key")
    pairs = paired.select("id", F.explode(F.array_distinct(F.array(*[f"p{r}" for r in range(PIVOTS)]))).alias("p")).filter("id <> p")
    pairs = pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()

    if "sig" in rows.columns:
        signatures = shared.materialize(rows.select("id", "sig").join(members.select("id").distinct(), "id", "left_semi"), "signatures")
        pairs = shared.materialize(_alike_signatures(pairs, signatures, least), "alike")
        sets = _written(pairs.select(F.explode(F.array("a", "b")).alias("id")), sets_of)
    else:  # small sets, which take no more room than signatures
        sets = _written(members.select("id"), sets_of)
        signatures = shared.materialize(_signatures(sets, minima), "signatures")
    links = shared.materialize(_confirmed(pairs, sets, percent), "links")
    found = shared.materialize(components.components(links), "components")
    shared.discard(pivots, links)
    shared.release(spark)

    # buckets whose members aren't all in one component yet; a bucket of two has had its only pair compared
    labelled = members.filter("n > 2").join(shared.few(found, 2), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    labelled = shared.materialize(labelled, "labelled")
    open_keys = shared.materialize(labelled.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("key"), "open")
    blocks = shared.materialize(_with_partners(_in_blocks(labelled.join(shared.few(open_keys), "key")), signatures, least), "blocks")
    shared.discard(members, labelled, open_keys, signatures)
    if "sig" in rows.columns:
        shared.discard(sets)
        sets = _written(blocks.select("id"), sets_of)
    more = shared.materialize(_block_links(blocks, sets, percent), "links")
    shared.discard(blocks, sets)
    shared.release(spark)
    return found if more.isEmpty() else components.components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))


def _written(ids: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return shared.materialize(sets_of(shared.materialize(ids.distinct(), "ids")), "sets")
