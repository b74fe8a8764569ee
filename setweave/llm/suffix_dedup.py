"""Removal of repeated byte strings (operator 2), over a logarithmic family of suffix indexes.

A string of LENGTH bytes is a repeat if it also starts earlier in the corpus.  Only a sparse set of
suffixes is moved between machines: of any LENGTH bytes, at least one of the suffixes in them is
chosen by the hash of its first GRAM bytes (the least in the window), alike wherever the bytes occur.

1. Each chosen suffix is sent, by its gram, with a hash of its neighbourhood: all LENGTH-byte
   windows that hold the gram.  A neighbourhood that occurs earlier is a repeat as a whole; those
   that a task sees twice are settled there, so that a common passage isn't sent once a copy.
2. First occurrences of different neighbourhoods of one gram fetch their bytes.  For each gram they
   come in batches, in corpus order.  A batch gets its suffix array: its windows, sorted by the
   fingerprint of their LENGTH bytes (only equality matters, so fingerprint order serves).  It is
   merge-scanned against the levels of the family so far, then joins it; equal-sized levels merge.
3. Runs found in 1 and 2 are joined back to their documents and cut out.

Grams with very many different neighbourhoods are taken apart: their windows are dealt by fingerprint,
so that the rows moved grow with the windows.  Windows that a task sees twice are settled there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

LENGTH, GRAM = 100, 32
MULTIPLIER = 0x9E3779B97F4A7C15
#: Rows of a batch of the family; and of one gram, beyond which its windows are dealt by fingerprint.
BATCH, HOT = 2048, 100_000


def _power(n: int) -> np.uint64:
    return np.uint64(pow(MULTIPLIER, n, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(b: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-byte strings along the last axis, by doubling."""
    width = b.shape[-1]
    h, done, out, have = b.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if n & done:
            if out is None:
                out, have = h, done
            else:
                keep = width - have - done + 1
                out, have = out[..., :keep] * _power(done) + h[..., have : have + keep], have + done
        if done * 2 > n:
            return _mixed(out)
        h = h[..., :-done] * _power(done) + h[..., done:]
        done *= 2


def _extreme(h: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over all w neighbours in a row, by doubling."""
    n = 1
    while n * 2 <= w:
        h = best(h[:-n], h[n:])
        n *= 2
    return h if n == w else best(h[: len(h) - (w - n)], h[w - n :])


def chosen(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen suffixes of a text of at least ``length`` bytes, and their grams' hashes."""
    h, w = rolling(b, gram), length - gram + 1
    least = _extreme(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_extreme(np.concatenate([pad, least, pad]), w, np.maximum) == h)
    return at, h[at]


def _neighbourhoods(b: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A hash of [at - (length - gram), at + length), cut at the ends of the text, and of where it was cut."""
    powers = np.cumprod(np.full(len(b), MULTIPLIER, np.uint64)) if len(b) else np.empty(0, np.uint64)
    inverse = np.uint64(pow(MULTIPLIER, -1, 2**64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    back = np.cumprod(np.full(len(b) + 1, inverse, np.uint64))
    lo, hi = np.maximum(at - (length - gram), 0), np.minimum(at + length, len(b))
    h = (total[hi] - total[lo]) * back[lo]
    return _mixed(h ^ _mixed(((at - lo) << 20 | (hi - at)).astype(np.uint64) * np.uint64(MULTIPLIER)))


def suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(known, g, nb, doc_id, pos) of the chosen suffixes of every text.

    ``known``: the same neighbourhood starts earlier among the rows that the task held with it, so
    this is a repeat already, and needn't meet the others of its gram (which may be very many).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            part, size = [], 0
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = np.frombuffer(text.as_buffer(), np.uint8)
                    at, g = chosen(raw, length, gram)
                    part.append((doc, at, g, _neighbourhoods(raw, at, length, gram)))
                    size += len(at)
                    if size >= 300_000:
                        yield _suffix_batch(part)
                        part, size = [], 0
            if part:
                yield _suffix_batch(part)

    rows = docs.filter("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) b").filter(F.octet_length("b") >= length)
    return rows.mapInArrow(run, "known boolean, g long, nb long, doc_id long, pos int")


def _suffix_batch(part: list) -> pa.RecordBatch:
    part.sort(key=lambda x: x[0])
    doc = np.repeat(np.array([d for d, _, _, _ in part], np.int64), [len(at) for _, at, _, _ in part])
    at, g, nb = (np.concatenate([x[k] for x in part]) for k in (1, 2, 3))
    if len({d for d, _, _, _ in part}) < len(part):
        # a document given twice has equal rows, which aren't repeats of each other: one of each stays
        order = np.lexsort((nb, g, at, doc))
        doc, at, g, nb = (c[order] for c in (doc, at, g, nb))
        new = np.ones(len(g), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | (g[1:] != g[:-1]) | (nb[1:] != nb[:-1])
        doc, at, g, nb = (c[new] for c in (doc, at, g, nb))
    # rows are in the order (doc_id, pos), and a stable sort leaves the first of each neighbourhood in front
    order = np.argsort(_mixed(g * np.uint64(MULTIPLIER) + nb), kind="stable")
    same = (g[order][1:] == g[order][:-1]) & (nb[order][1:] == nb[order][:-1])
    known = np.zeros(len(g), bool)
    known[order[1:][same]] = True
    return pa.RecordBatch.from_arrays(
        [pa.array(known), pa.array(g.view(np.int64)), pa.array(nb.view(np.int64)), pa.array(doc), pa.array(at.astype(np.int32))], names=["known", "g", "nb", "doc_id", "pos"]
    )


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order (known, g, nb, doc_id, pos): repeats of a neighbourhood (open false), and first ones of grams that have several (open true)."""
    held = None  # the first row of the only neighbourhood so far of the last gram
    last_g = last_nb = last_doc = last_pos = None
    for batch in batches:
        known = batch.filter(batch.column(0))
        batch = batch.slice(0, batch.num_rows - known.num_rows)
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known.column(1), known.column(3), known.column(4), pa.array(np.zeros(known.num_rows, bool))], names=["g", "doc_id", "pos", "open"])
        if not batch.num_rows:
            continue
        g, nb, doc, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
        new_g, new_nb = np.ones(len(g), bool), np.ones(len(g), bool)
        new_g[1:] = g[1:] != g[:-1]
        new_g[0] = last_g is None or g[0] != last_g
        new_nb[1:] = nb[1:] != nb[:-1]
        new_nb[0] = last_nb is None or nb[0] != last_nb
        first = new_g | new_nb
        group = np.cumsum(new_g)  # 0: the gram that the last batch ended in
        runs = np.bincount(group[first], minlength=group[-1] + 1)
        carried = 0 if last_g is None or group[0] else 1
        several = runs >= 2
        if carried:
            several[0] = runs[0] >= 1
        if group[-1] > 0 or several[0]:
            if held is not None and carried and several[0]:
                yield _flagged([held], True)
            held = None if group[-1] > 0 or several[0] else held
        # a document given twice has equal rows, which aren't repeats of each other
        again = np.zeros(len(g), bool)
        again[1:] = ~first[1:] & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
        again[0] = not first[0] and doc[0] == last_doc and pos[0] == last_pos
        wanted = (~first | several[group]) & ~again
        # the last gram may yet get another neighbourhood
        if group[-1] > 0 and not several[-1]:
            k = np.flatnonzero(new_g)[-1]
            held = (g[k], doc[k], pos[k])
        at = np.flatnonzero(wanted)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(doc[at]), pa.array(pos[at]), pa.array(first[at])], names=["g", "doc_id", "pos", "open"])
        last_g, last_nb, last_doc, last_pos = g[-1], nb[-1], doc[-1], pos[-1]


def _flagged(rows: list, is_open: bool) -> pa.RecordBatch:
    g, doc, pos = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array([is_open] * len(g))], names=["g", "doc_id", "pos", "open"])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open intervals (touching ones become one)."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, far = start[o], np.maximum.accumulate(end[o])
    cut = np.flatnonzero(start[1:] > far[:-1])
    return start[np.append(0, cut + 1)], far[np.append(cut, len(far) - 1)]


def _neighbours(docs: DataFrame, flagged: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, runs found so far (start, end), and the open suffixes with their bytes."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, runs, opened = [], [], []
            for doc, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw, items = text.as_buffer().to_pybytes(), marks.values
                pos = items.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
                is_open = items.field("open").to_numpy(zero_copy_only=False).astype(bool)
                g = items.field("g").to_numpy(zero_copy_only=False)
                p = pos[~is_open]
                s, e = merged(np.maximum(p - reach, 0), np.minimum(p + length, len(raw)))
                docs_.append(doc)
                runs.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)])
                opened.append([{"g": int(k), "pos": int(x), "bytes": raw[max(x - reach, 0) : x + length]} for k, x in zip(g[is_open], pos[is_open], strict=True)])
                if len(docs_) >= 64:
                    yield _neighbour_batch(docs_, runs, opened)
                    docs_, runs, opened = [], [], []
            if docs_:
                yield _neighbour_batch(docs_, runs, opened)

    marks = flagged.groupBy("doc_id").agg(F.collect_list(F.struct("g", "pos", "open")).alias("marks"))  # as many as one text has
    texts = docs.filter("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) b")
    return texts.join(marks, "doc_id").mapInArrow(run, "doc_id long, runs array<struct<start:int,end:int>>, opened array<struct<g:long,pos:int,bytes:binary>>")


def _neighbour_batch(docs: list, runs: list, opened: list) -> pa.RecordBatch:
    run = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    item = pa.list_(pa.struct([("g", pa.int64()), ("pos", pa.int32()), ("bytes", pa.binary())]))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(runs, run), pa.array(opened, item)], names=["doc_id", "runs", "opened"])


class Family:
    """Levels of sorted fingerprints; a new batch is scanned against all, and equal-sized levels merge."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            found |= level[at] == keys
        return found

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.levels.append(keys)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels[-2:] = [np.unique(np.concatenate(self.levels[-2:]))]


def _windows(g, pos, data: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, fingerprint, start) of every window of ``length`` bytes that holds its row's gram."""
    reach = length - gram
    rows = np.zeros((len(g), length + reach), np.uint8)
    left = np.minimum(pos, reach)
    size = np.array([len(x) for x in data], np.int64)
    for i, x in enumerate(data):
        rows[i, reach - left[i] : reach - left[i] + len(x)] = np.frombuffer(x, np.uint8)
    h = _mixed(rolling(rows, length) + _mixed(g.view(np.uint64))[:, None])
    offset = np.arange(reach + 1)[None, :]  # the window starts at pos - reach + offset
    r, c = np.nonzero((offset >= (reach - left)[:, None]) & (offset + length <= (reach - left + size)[:, None]))
    return r, h[r, c], pos[r] - reach + c


def _as_runs(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, end) of windows whose starts follow one another."""
    if not len(doc):
        return doc, start, start
    o = np.lexsort((start, doc))
    d, s = doc[o], start[o]
    cut = np.flatnonzero((d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1))
    lo, hi = np.append(0, cut + 1), np.append(cut, len(d) - 1)
    return d[lo], s[lo], s[hi] + length


class Scanner:
    """Runs of repeats among the open suffixes of whole grams, which come in the order (g, doc_id, pos)."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.family = length, gram, Family()

    def __call__(self, g, doc, pos, data: list[bytes], same_next: bool):
        """(doc_id, start) of repeats in this batch; ``same_next``: the next batch begins with its last gram."""
        r, keys, start = _windows(g, pos, data, self.length, self.gram)
        _, rank = np.unique(doc, return_inverse=True)
        order = (rank[r].astype(np.int64) << 34) | start
        # the batch's suffix array
        o = np.argsort(keys, kind="stable")
        sorted_keys = keys[o]
        head = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(o) else np.empty(0, int)
        repeated = np.zeros(len(keys), bool)
        if len(o):
            earliest = np.minimum.reduceat(order[o], head)
            which = np.cumsum(np.bincount(head, minlength=len(o))) - 1
            older = self.family.holds(sorted_keys[head])
            repeated[o] = (order[o] > earliest[which]) | older[which]
        if same_next:
            own = (g == g[-1])[r]
            if not (g == g[-1]).all():
                self.family = Family()
            self.family.add(np.unique(keys[own]))
        else:
            self.family = Family()
        d, s = doc[r[repeated]], start[repeated]
        return d, s


def _repeats(opened: DataFrame, length: int, gram: int, batch_rows: int, hot: int) -> DataFrame:
    """(doc_id, start, end) of repeats among the first occurrences of different neighbourhoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(length, gram)
        for block, same_next in _blocks(batches, batch_rows):
            g, doc, pos = (block.column(i).to_numpy() for i in range(3))
            with np.errstate(over="ignore"):
                d, s = scanner(g, doc, pos.astype(np.int64), block.column(3).to_pylist(), same_next)
            if len(d):
                yield _runs_batch(*_as_runs(d, s, length))

    # every gram has two open rows or more, so the table of hot ones has at most rows / hot rows
    many = shared.materialize(opened.groupBy("g").count().filter(F.col("count") > hot).select("g"), "hot_grams")
    if many.isEmpty():
        shared.discard(many)
        rest = opened
    else:
        rest = shared.rows_without(opened, many, "g")
    found = rest.repartition("g").sortWithinPartitions("g", "doc_id", "pos").mapInArrow(run, RUN)
    return found if rest is opened else found.unionByName(_repeats_by_window(shared.rows_with(opened, many, "g"), length, gram, batch_rows))


RUN = "doc_id long, start int, end int"


def _runs_batch(doc, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "start", "end"])


def _repeats_by_window(opened: DataFrame, length: int, gram: int, batch_rows: int) -> DataFrame:
    """The same for hot grams: each window goes by its fingerprint; all but the first of a fingerprint are repeats.

    Those that are later than an equal one in their batch need no comparison; they are dealt by their own place.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                block = batch.slice(at, batch_rows)
                g, doc, pos = (block.column(i).to_numpy() for i in range(3))
                with np.errstate(over="ignore"):
                    r, h, start = _windows(g, pos.astype(np.int64), block.column(3).to_pylist(), length, gram)
                if not len(r):
                    continue
                own = doc[r]
                o = np.lexsort((start, own, h))
                h, own, start = h[o], own[o], start[o]
                head = np.append(True, h[1:] != h[:-1])
                first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
                later = (own != own[first]) | (start != start[first])
                d, s, e = _as_runs(own[later], start[later], length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(np.zeros(len(d), np.int64), h[head].view(np.int64))), pa.array(np.append(d, own[head])),
                        pa.array(np.append(s, start[head]).astype(np.int32)), pa.array(np.append(e, start[head] + length).astype(np.int32)),
                        pa.array(np.append(np.ones(len(d), bool), np.zeros(head.sum(), bool))),
                    ],
                    names=["h", "doc_id", "start", "end", "known"],
                )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # fingerprint, doc_id and start of the first window of the fingerprint that is being read
        for batch in batches:
            h, doc, start, end = (batch.column(i).to_numpy() for i in range(4))
            known = batch.column(4).to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            repeated = known.copy()
            new = np.flatnonzero(~known)
            if len(new):
                k, d, s = h[new], doc[new], start[new]
                carried = now is not None and now[0] == k[0]
                head = np.append(not carried, k[1:] != k[:-1])
                first = np.maximum.accumulate(np.where(head, np.arange(len(k)), -1))
                fd, fs = np.where(first < 0, now[1] if carried else 0, d[first]), np.where(first < 0, now[2] if carried else 0, s[first])
                repeated[new] = (d != fd) | (s != fs)
                now = (k[-1], fd[-1], fs[-1])
            if repeated.any():
                yield _runs_batch(doc[repeated], start[repeated], end[repeated])

    windows = opened.mapInArrow(spread, "h long, doc_id long, start int, end int, known boolean")
    sent = F.when(F.col("known"), F.xxhash64("doc_id", "start")).otherwise(F.col("h"))
    return windows.repartition(sent).sortWithinPartitions("known", "h", "doc_id", "start").mapInArrow(settle, RUN)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, bool]]:
    """Blocks of at least ``size`` rows that end where the document changes, and whether the gram goes on."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        while rest.num_rows > size:
            g, doc = (rest.column(i).to_numpy() for i in (0, 1))
            other = g[1:] != g[:-1]
            ends = np.flatnonzero(other | (doc[1:] != doc[:-1])) + 1
            ends = ends[ends >= size]
            if not len(ends):
                break
            k = int(ends[0])
            yield rest.slice(0, k).combine_chunks(), not other[k - 1]
            rest = rest.slice(k)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), False


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_rows: int = BATCH, hot: int = HOT) -> DataFrame:
    """doc_id and runs: the unordered, possibly overlapping byte intervals that repeat earlier text."""
    spark = docs.sparkSession
    sent = F.when(F.col("known"), F.xxhash64("doc_id", "pos")).otherwise(F.col("g"))
    moved = suffixes(docs, length, gram).repartition(sent).sortWithinPartitions("known", "g", "nb", "doc_id", "pos")
    flagged = shared.materialize(moved.mapInArrow(_sorted_out, "g long, doc_id long, pos int, open boolean"), "flagged")
    shared.release(spark)
    near = shared.materialize(_neighbours(docs, flagged, length, gram), "neighbours")
    shared.discard(flagged)
    shared.release(spark)
    opened = near.select("doc_id", F.explode("opened").alias("o")).select("o.g", "doc_id", "o.pos", "o.bytes")
    found = shared.materialize(_repeats(opened, length, gram, batch_rows, hot), "repeats")
    shared.release(spark)
    known = near.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.start", "r.end")
    return known.unionByName(found).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("runs"))  # as many as one text has


def _with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b"))
    return text.join(runs, "doc_id", "left")


def _runs_of(value) -> tuple[np.ndarray, np.ndarray]:
    if not value.is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    items = value.values
    return merged(items.field("start").to_numpy(zero_copy_only=False).astype(np.int64), items.field("end").to_numpy(zero_copy_only=False).astype(np.int64))


def _kept(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (bytes: the rest may cut a character), starts, ends of the removed runs, of every row.

    A null or empty text has nothing to remove.  A null doc_id is left whole and supplies nothing.
    doc_id is a key: rows that share one are read as one document's text, given more than once.
    An empty table gives an empty one; columns other than doc_id and text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, starts, ends = [], [], []
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                s, e = _runs_of(runs)
                kept.append(_kept(text.as_buffer().to_pybytes(), s, e))
                starts.append(s)
                ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["doc_id", "kept", "starts", "ends"])

    return _with_runs(docs, repeated_runs(docs, length)).mapInArrow(run, "doc_id long, kept binary, starts array<long>, ends array<long>")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(shared.read_table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, (length(hex(encode(coalesce(text, '')))) // 2)::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, (2 * p + 1)::BIGINT, 200)) AS k FROM d, unnest(range(0, n - 99)) r(p)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM w) WHERE rn > 1),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM f),
j AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM j GROUP BY ALL),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM s),
u AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM s GROUP BY doc_id),
k AS (SELECT t.doc_id, string_agg(substr(h, (2 * prev + 1)::BIGINT, (2 * (a - prev))::BIGINT), '' ORDER BY a) AS head FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN u USING (doc_id) LEFT JOIN k USING (doc_id)
"""
