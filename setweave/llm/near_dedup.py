"""MinHash near-duplicate documents (operator 1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import minhash, shared
from .shingles import Minima

PERCENT = 75
BANDS, ROWS = 32, 4  # misses a pair at the threshold once in 190,000
SALTS = 16


KEYS = ["n_shingles", "set_key", "set_key2"]


def _linked(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], minima: Minima, percent: int) -> DataFrame:
    """KEYS, component, salt of the classes of equal sets that are more than a single unlinked item; each once a salt."""
    full = rows.filter("n_shingles > 0 and id is not null")
    classes = shared.materialize(full.groupBy(*KEYS).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")

    # members of a class beside its first are left out by their ids, so that signatures and band keys aren't moved
    several = shared.materialize(classes.filter("n > 1"), "several")
    copies = full.select("id", *KEYS).join(shared.few(several, 5), KEYS).filter("id <> rep").select("id").distinct()
    # an id that was given with two sets may be the first of another class, and stays then
    copies = shared.materialize(copies.join(classes.select(F.col("rep").alias("id")), "id", "left_anti"), "copies")
    reps = shared.rows_without(full, copies, "id")
    found = shared.materialize(minhash.link_components(reps.select("id", *[c for c in ("sig", "bands") if c in rows.columns]), sets_of, minima, percent), "found")
    linked = classes.join(shared.few(found, 2), F.col("rep") == F.col("id"), "left").filter("n > 1 or component is not null")
    # salted, as a class may hold a third of all rows
    linked = linked.select(*KEYS, F.coalesce("component", "rep").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    linked = shared.materialize(linked, "linked")
    shared.discard(classes, several, copies, found)
    return linked


def _salted(rows: DataFrame) -> DataFrame:
    return rows.select("id", *KEYS).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))


def with_components(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], minima: Minima, percent: int) -> DataFrame:
    """id, n_shingles, component of every row of a written ``minhash.scan``; items with equal sets are one from the start."""
    out = _salted(rows).join(_linked(rows, sets_of, minima, percent), [*KEYS, "salt"], "left")
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def groups(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], minima: Minima, percent: int) -> DataFrame:
    """(id, component) of the rows of a written scan without signatures that are alike another one; ``rows`` is used up.

    Equal sets have equal band keys, so these travel once, with the class, and never as an array.
    """
    spark, bands = rows.sparkSession, [f"band{k}" for k in range(minima.bands)]
    full = rows.filter("n_shingles > 0").select("id", *KEYS, *[F.col("bands")[k].alias(b) for k, b in enumerate(bands)])
    classes = full.groupBy(*KEYS).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), *[F.max(b).alias(b) for b in bands])
    classes = shared.materialize(classes, "classes")
    items = shared.materialize(full.select("id", *KEYS), "items")
    shared.discard(rows)
    shared.release(spark)
    reps = classes.select(F.col("rep").alias("id"), F.array(*bands).alias("bands"))
    found = shared.materialize(minhash.link_components(reps, sets_of, minima, percent), "found")
    linked = classes.join(shared.few(found, 2), F.col("rep") == F.col("id"), "left").filter("n > 1 or component is not null")
    linked = linked.select(*KEYS, F.coalesce("component", "rep").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    linked = shared.materialize(linked, "linked")
    shared.discard(classes, found)
    shared.release(spark)
    return shared.materialize(_salted(items).join(linked, [*KEYS, "salt"]).select("id", "component"), "groups")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text; other columns aren't read).

    A null or empty text has no shingles and is linked with nothing.  Rows with one doc_id twice are
    one document if their sets are equal; else both count under that id.  A null doc_id is linked with
    nothing and kept, with a null component.  An empty table gives an empty one.
    """
    minima = Minima(BANDS, ROWS)
    items = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = shared.materialize(minhash.scan(items, minima), "scan")
    out = with_components(rows, lambda ids: minhash.full_sets(shared.rows_with(items, ids, "id")), minima, percent)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` (all columns) with one row of each component only: its least doc_id.

    Of rows that share a doc_id one stays; all rows without a doc_id stay.
    """
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select("doc_id").distinct()
    rest = shared.rows_without(docs, shared.materialize(gone, "gone"), "doc_id")
    twice = shared.materialize(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "twice")
    return shared.rows_without(rest, twice, "doc_id").unionByName(shared.rows_with(rest, twice, "doc_id").dropDuplicates(["doc_id"]))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS g FROM w, unnest(range(1, greatest(len(words) - 3, 2))) r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(id, c) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT b, c FROM reach JOIN link ON a = id AND c <= b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c)::BIGINT AS component_id, min(c) = doc_id AS kept
FROM w JOIN reach ON id = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
