"""Removal of repeated passages (operator 8): MinHash banding on paragraph segments, exact Jaccard, components.

A paragraph is a \\n-separated part of a text, and its segments are its sentences: a segment ends with
the first word, its eighth or a later one, that ends in . ! or ?, else with the paragraph.  Segments of
paragraphs of RUN_WORDS words or more are banded, alike ones (Jaccard of 5-word shingles) are joined
into components, and all but the first of each (by doc_id, then place) are repeats.  Repeats that stand
side by side in a paragraph make a passage; passages of RUN_WORDS words or more are cut out.  So a
passage is found inside a paragraph too, wherever it begins, and short common lines stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import minhash, near_dedup, pieces, shared
from .shingles import Minima, WordHashes, shingle_set

PERCENT = 75
BANDS, ROWS, EXTRA = 8, 2, 16  # tuned for recall: misses a pair at the threshold once in 750
#: Words of a segment before it may end, and of the shortest passage that goes.
SEGMENT_WORDS, RUN_WORDS = 8, 25
_S, _W = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SEGMENT = rf"{_S}*(?:{_W}+{_S}+){{{SEGMENT_WORDS - 1}}}(?:{_W}+{_S}+)*?{_W}*[.!?](?:{_S}+|$)|.+"
_SEGMENT = re.compile(SEGMENT)
_ENDS = frozenset(b".!?")
CHUNK_SEGMENTS = 20_000
SCAN = "id long, n_shingles long, set_key long, set_key2 long, bands array<long>"


def word_segments(words: list[bytes]) -> list[list[bytes]]:
    """The words of a paragraph, cut into its segments."""
    out, start = [], 0
    for end in [i for i, w in enumerate(words, 1) if w[-1] in _ENDS]:
        if end - start >= SEGMENT_WORDS:
            out.append(words[start:end])
            start = end
    return [*out, words[start:]] if start < len(words) else out


def count_segments(text: str) -> int:
    lines = ((line, line.split()) for line in text.encode("utf-8", "replace").split(b"\n"))
    return sum(len(word_segments(words)) if words else line != b"" for line, words in lines)


def segments_of(text: str | None) -> Iterator[tuple[int, list[bytes]]]:
    """(place, words) of the segments of long paragraphs; all segments of the text have places."""
    place = 0
    for line in (text or "").encode("utf-8", "replace").lower().split(b"\n"):
        words = line.split()
        if not words:
            place += line != b""  # blanks are a segment without words
            continue
        parts = word_segments(words)
        if len(words) >= RUN_WORDS:
            yield from enumerate(parts, place)
        place += len(parts)


def scan(numbered: DataFrame, minima: Minima) -> DataFrame:
    """Set size, 128-bit key of the set and band keys of every segment of (no, text) that may go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ids, words = WordHashes(), [], []
        for batch in batches:
            for no, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for place, own in segments_of(text.as_py()):
                    ids.append((no << pieces.PLACE_BITS) + place)
                    words.append(own)
                if len(ids) >= CHUNK_SEGMENTS:
                    yield minhash.scanned(pa.array(ids, pa.int64()), words, minima, cache, signed=False)
                    ids, words = [], []
        if ids:
            yield minhash.scanned(pa.array(ids, pa.int64()), words, minima, cache, signed=False)

    return numbered.select("no", "text").mapInArrow(run, SCAN)


def segment_sets(numbered: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s): the shingle sets of the segments in ``ids``, from whole texts beside the places that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for no, text, places in zip(*(c for c in batch.columns), strict=True):
                no, wanted = no.as_py(), set(places.as_py())
                found = [(place, shingle_set(own, cache).tobytes()) for place, own in segments_of(text.as_py()) if place in wanted]
                if found:
                    base = no << pieces.PLACE_BITS
                    yield pa.RecordBatch.from_arrays([pa.array([base + p for p, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["id", "s"])

    wanted = pieces.places_of(ids).withColumnRenamed("no", "own")
    return numbered.join(wanted, F.col("no") == F.col("own")).select("no", "text", "places").distinct().mapInArrow(run, "id long, s binary")


def repeats(docs: DataFrame, percent: int = PERCENT) -> tuple[pieces.Numbers, DataFrame]:
    """The documents' numbers, and (no, later, first): places of segments that repeat an earlier one, and of the first ones."""
    numbers, minima = pieces.Numbers(docs), Minima(BANDS, ROWS, EXTRA)
    numbered = numbers.of(docs, "text")
    rows = shared.materialize(scan(numbered, minima), "segments")
    found = near_dedup.groups(rows, lambda ids: segment_sets(numbered, ids), minima, percent)
    place, later = pieces.place_of(F.col("id")), F.col("id") > F.col("component")
    marked = shared.materialize(
        found.groupBy(pieces.number_of(F.col("id")).alias("no")).agg(
            F.collect_set(F.when(later, place)).alias("later"), F.collect_set(F.when(~later, place)).alias("first")  # as many as one text has
        ),
        "marked",
    )
    shared.discard(found)
    shared.release(docs.sparkSession)
    return numbers, marked


def cut(text: str, later: set[int]) -> tuple[str, int, int]:
    """A text without the passages among its segments at ``later``, how many segments it had and how many go."""
    kept, place, gone = [], 0, 0
    for line in text.split("\n"):
        parts = _SEGMENT.findall(line)
        sizes = [len(p.encode("utf-8", "replace").split()) for p in parts]
        goes, start = [False] * len(parts), 0
        for i in range(len(parts) + 1):
            if i == len(parts) or place + i not in later:
                if sum(sizes[start:i]) >= RUN_WORDS:
                    goes[start:i] = [True] * (i - start)
                start = i + 1
        if not parts or not all(goes):
            kept.append("".join(p for p, g in zip(parts, goes, strict=True) if not g))
        place, gone = place + len(parts), gone + sum(goes)
    return "\n".join(kept), place, gone


def _cuts(text, later):
    import pandas as pd

    rows = []
    for t, places in zip(text, later, strict=True):
        if t is None:
            rows.append((None, 0, 0))
        elif places is None or not len(places):
            rows.append((t, count_segments(t), 0))
        else:
            rows.append(cut(t, set(places)))
    return pd.DataFrame(rows, columns=["text", "n_segments", "n_removed"])


def _cut(docs: DataFrame, percent: int) -> DataFrame:
    """(row, found, out): out has the text that is left, n_segments and n_removed."""
    numbers, marked = repeats(docs, percent)
    return numbers.beside(docs, marked).withColumn("out", F.pandas_udf(_cuts, "text string, n_segments long, n_removed long")(F.col("row.text"), F.col("found.later")))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` (the same columns) with repeated passages cut out of the text.

    A paragraph that goes as a whole goes with its line end.  A null text stays null, an empty one
    empty; equal passages (ties) keep the first by doc_id, then place; a null doc_id is left whole and
    supplies nothing; rows that share a doc_id are one document given more than once.  An empty table
    gives an empty one.
    """
    d = _cut(docs, percent)
    return d.select(*[F.col("out.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_members counts the segments that are alike another one, first copies included."""
    d = _cut(shared.project(shared.read_table(spark, sf_dir, "documents"), "doc_id", "text"), PERCENT)
    return d.select(
        F.col("row.doc_id").alias("doc_id"),
        "out.n_segments",
        (F.coalesce(F.size("found.later"), F.lit(0)) + F.coalesce(F.size("found.first"), F.lit(0))).cast("long").alias("n_members"),
        "out.n_removed",
        F.sha2(F.coalesce("out.text", F.lit("")), 256).alias("kept_sha256"),
    )


SQL = rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, i, parts[i] AS line, regexp_extract_all(parts[i], '{SEGMENT}') AS segs, len(list_filter(regexp_split_to_array(parts[i], '{_S}+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) r(i)),
g AS (SELECT doc_id, i, k, segs[k] AS seg, n, list_filter(regexp_split_to_array(translate(segs[k], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_S}+'), lambda x: x <> '') AS words FROM l, unnest(range(1, len(segs) + 1)) r(k)),
p AS (SELECT array_to_string(words, ' ') AS t, min((doc_id, i, k)) AS first, any_value(words) AS words FROM g WHERE n >= {RUN_WORDS} GROUP BY 1),
q AS (SELECT row_number() OVER (ORDER BY first) AS id, * FROM p),
s AS (SELECT DISTINCT id, array_to_string(words[k:k+4], ' ') AS w FROM q, unnest(range(1, greatest(len(words) - 3, 2))) r(k)),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
m AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.w = b.w AND a.id <> b.id GROUP BY ALL),
link AS (SELECT a, b FROM m JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach(id, c) AS (SELECT id, id FROM q UNION SELECT b, c FROM reach JOIN link ON a = id AND c <= b),
root AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
f AS (SELECT q.t, r.first, count(*) OVER (PARTITION BY root.c) AS texts FROM q JOIN root USING (id) JOIN q r ON r.id = root.c),
u AS (SELECT t, count(*) AS uses FROM (SELECT array_to_string(words, ' ') AS t FROM g WHERE n >= {RUN_WORDS}) GROUP BY 1),
k AS (SELECT doc_id, i, k, seg, len(words) AS size, f.t IS NOT NULL AND f.first <> (doc_id, i, k) AS later, f.t IS NOT NULL AND (texts > 1 OR uses > 1) AS member
      FROM g LEFT JOIN f ON n >= {RUN_WORDS} AND f.t = array_to_string(words, ' ') LEFT JOIN u ON u.t = f.t),
v AS (SELECT *, sum((NOT later)::INT) OVER (PARTITION BY doc_id, i ORDER BY k) AS run FROM k),
w AS (SELECT *, later AND sum(size) FILTER (later) OVER (PARTITION BY doc_id, i, run) >= {RUN_WORDS} AS gone FROM v),
b AS (SELECT doc_id, i, count(*) AS n, count(*) FILTER (member) AS members, count(*) FILTER (gone) AS r, string_agg(seg, '' ORDER BY k) FILTER (NOT gone) AS kept FROM w GROUP BY doc_id, i),
a AS (SELECT l.doc_id, sum(coalesce(b.n, 0)) AS n, sum(coalesce(members, 0)) AS members, sum(coalesce(r, 0)) AS r, string_agg(coalesce(kept, ''), chr(10) ORDER BY l.i) FILTER (b.n IS NULL OR r < b.n) AS kept
      FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_segments, coalesce(members, 0)::BIGINT AS n_members, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a USING (doc_id)
"""
