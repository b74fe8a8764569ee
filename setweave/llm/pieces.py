"""Numbering the pieces (lines, segments) of documents, and cutting lines out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import shared

#: A piece's number is its document's and its place; an array can't hold as many lines as a text has places here.
PLACE_BITS = 27
MOST_DOCS = 1 << 36


class Numbers:
    """Numbers of documents that sort as their doc_id and leave room for a place in one long.

    They are the ids themselves where all fit (0 to 2**36 - 1), else the ranks among the distinct ids.
    """

    def __init__(self, docs: DataFrame):
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
        ends = ids.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        fit = ends["low"] is None or (ends["low"] >= 0 and ends["high"] < MOST_DOCS)
        self.ranks = None if fit else _ranks(ids.distinct())

    def of(self, docs: DataFrame, *columns: str) -> DataFrame:
        """(no, columns) of the rows that have a doc_id."""
        d = docs.select(F.col("doc_id").cast("long").alias("no"), *columns).filter("no is not null")
        if self.ranks is None:
            return d
        return d.withColumnRenamed("no", "_id").join(self.ranks, F.col("_id") == F.col("doc_id")).select("no", *columns)

    def beside(self, docs: DataFrame, found: DataFrame) -> DataFrame:
        """(row, found): every row of ``docs``, and of ``found`` (no, ...) what its document has, or null; as structs, so that no names clash."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        d = found.select(F.col("no").alias("doc_id"), F.struct(*found.columns).alias("found"))
        if self.ranks is not None:
            d = d.withColumnRenamed("doc_id", "no").join(self.ranks, "no").select("doc_id", "found")
        return rows.join(d, F.col("row.doc_id").cast("long") == F.col("doc_id"), "left").select("row", "found")


def _ranks(ids: DataFrame) -> DataFrame:
    """(doc_id, no): each id's row in its range partition, after all rows of the partitions before."""
    row = F.monotonically_increasing_id()  # the partition in its upper bits, the row in the lower 33
    ids = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = shared.materialize(ids.select("doc_id", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("row")), "ranks")
    before, offsets = 0, []
    for r in ids.groupBy("part").count().orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    parts = ids.sparkSession.createDataFrame(offsets, "part long, before long")
    return ids.join(F.broadcast(parts), "part").select("doc_id", (F.col("row") + F.col("before")).alias("no"))  # one row a partition


def piece_id(no: Column, place: Column) -> Column:
    return F.shiftleft(no, PLACE_BITS) + place


def number_of(piece: Column) -> Column:
    return F.shiftright(piece, PLACE_BITS)


def place_of(piece: Column) -> Column:
    return piece.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")


def lines(numbered: DataFrame) -> DataFrame:
    """(id, text) of the \\n-separated parts of (no, text)."""
    d = numbered.select("no", F.posexplode(F.split("text", "\n")).alias("place", "text"))
    return d.select(piece_id(F.col("no"), F.col("place")).alias("id"), "text")


def places_of(ids: DataFrame) -> DataFrame:
    """(no, places): the sorted places of the pieces in ``ids`` (column id)."""
    d = ids.select(number_of(F.col("id")).alias("no"), place_of(F.col("id")).alias("place"))
    return d.groupBy("no").agg(F.sort_array(F.collect_set("place")).alias("places"))  # as many as one text has


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_lines(text: Column, places: Column) -> Column:
    """``text`` without its lines at ``places``."""
    def kept(parts: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), places), lambda i: F.get(parts, i)), "\n")

    return F.when(places.isNull(), text).otherwise(let(F.split(text, "\n"), kept))
