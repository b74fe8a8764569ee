"""Seeded sampling by the hash of a key: exact sizes, the same rows in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import ranking


def hash_key(seed: int | str | Column, *keys: Column) -> Column:
    """A pseudo-random, reproducible sort key (the same in any engine that has md5)."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), *[k.cast("string") for k in keys]))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(hash_key(seed, F.col(key)), key).limit(n)


def split(df: DataFrame, key: str, test: float, validation: float, seed: int) -> DataFrame:
    """Adds part: max(1, int(test * n)) test rows, likewise validation, the rest train; ValueError if none is left."""
    n = df.count()
    n_test, n_val = max(1, int(test * n)), max(1, int(validation * n))
    if n - n_test - n_val <= 0:
        raise ValueError("no training rows left")
    order = hash_key(seed, F.col(key))
    return ranking.numbered(df, [order, F.col(key)], F.substring(order, 1, 2), out="_r").withColumn("part", F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")).drop("_r")


def permuted(df: DataFrame, key: str, column: str, seed: int | str | Column, by: list[str] = (), out: str | None = None) -> DataFrame:
    """``column`` dealt anew over the rows (within groups): the i-th row by key gets the i-th value by hash."""
    g = list(by)
    rows = ranking.numbered(df, [F.col(key)], ranking.range_of(df, key), g, "_i")
    hashed = df.select(*g, F.col(key).alias("_k"), F.col(column).alias("_v"), hash_key(seed, F.col(key)).alias("_h"))
    dealt = ranking.numbered(hashed, [F.col("_h"), F.col("_k")], F.substring("_h", 1, 2), g, "_i").select(*g, "_v", "_i")
    joined = rows.join(dealt, [*g, "_i"])
    return joined.withColumn(out or column, F.col("_v")).drop("_v", "_i")


def negative_edges(nodes: DataFrame, edges: DataFrame, n: int, seed: int, tries: int = 4) -> DataFrame:
    """n pairs u < v of node numbers (columns i 0..m-1, id) that aren't edges (u, v); no self loops; pairs may repeat.

    Draws are numbered, so that drawing more keeps the first ones; they double until n fit.  Where every pair is an edge there is none, and no row.
    """
    m = nodes.count()
    known = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    if m * (m - 1) // 2 <= known.count():
        return known.limit(0)
    spark = nodes.sparkSession
    draw = lambda s: F.conv(F.substring(hash_key(f"{seed}{s}", F.col("k")), 1, 8), 16, 10).cast("long") % m
    ids = nodes.select(F.col("i"), F.col("id"))
    while True:
        pairs = spark.range(n * tries).withColumnRenamed("id", "k").select("k", draw("u").alias("i"), draw("v").alias("j"))
        pairs = pairs.join(ids.withColumnRenamed("id", "x"), "i").join(ids.select(F.col("i").alias("j"), F.col("id").alias("y")), "j").filter("x <> y")
        pairs = pairs.select("k", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).join(known, ["u", "v"], "left_anti")
        if pairs.limit(n).count() == n:
            return pairs.orderBy("k").limit(n).select("u", "v")
        tries *= 2
