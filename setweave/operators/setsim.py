"""Set overlap, its statistics, and pairs of items that share values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import combinatorics as C, numbers as N


def sizes(members: DataFrame, key: str = "gs_id") -> DataFrame:
    return members.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


#: Sets of a block, about, and cells of a block's counts that are held at once.
BLOCK_SETS, MOST_CELLS = 256, 8_000_000


def overlaps(members: DataFrame, key: str = "gs_id", element: str = "gene", with_n: bool = False) -> DataFrame:
    """(a, b, olap[, n1, n2]) for all a < b with a common element: by the elements' lists of sets, never of all pairs.

    Each list goes once to every block of sets in it, less the sets of earlier blocks; pairs are made and counted
    there, so that no row is written for a pair's single elements.
    """
    d = members.select(F.col(key).alias("k"), F.col(element).alias("e"))
    d = d.join(d.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("n")), "k").filter("e is not null")
    kind = dict(d.dtypes)["k"]
    if kind in ("bigint", "int", "smallint", "tinyint"):  # near ids have lists in common more often
        block = F.floor(F.col("k") / BLOCK_SETS).cast("long")
    else:
        block = F.pmod(F.xxhash64("k"), F.lit(max(1, -(-d.select("k").distinct().count() // BLOCK_SETS))))
    lists = d.groupBy("e").agg(F.array_sort(F.collect_list(F.struct(block.alias("block"), "k", "n"))).alias("l")).filter(F.size("l") > 1)
    at = lambda i: F.element_at("l", i)["block"]
    starts = F.filter(F.sequence(F.lit(1), F.size("l") - 1), lambda i: (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1)))))
    d = lists.withColumn("i", F.explode(starts)).select(at(F.col("i")).alias("block"), F.slice("l", F.col("i"), F.size("l")).alias("l"))
    d = d.select("block", F.size(F.filter("l", lambda x: x["block"] == F.col("block"))).alias("own"), F.transform("l", lambda x: x["k"]).alias("k"), F.transform("l", lambda x: x["n"]).alias("n"))

    def run(table: pa.Table) -> pa.Table:
        return _counted(table["own"].to_numpy(), table["k"].combine_chunks(), table["n"].combine_chunks(), with_n)

    return d.groupBy("block").applyInArrow(run, f"a {kind}, b {kind}, olap long" + (", n1 long, n2 long" if with_n else ""))


def _counted(own: np.ndarray, lists: pa.ListArray, sizes: pa.ListArray, with_n: bool) -> pa.Table:
    """Pairs of each list's first ``own`` sets with those after them, counted over the lists."""
    flat = lists.flatten()
    ids = flat.unique()
    ids = ids.take(pc.sort_indices(ids))
    rank = pc.index_in(flat, ids).to_numpy().astype(np.int64)
    n = np.zeros(len(ids), np.int64)
    n[rank] = sizes.flatten().to_numpy()
    length = pc.list_value_length(lists).to_numpy()
    start = np.cumsum(length) - length
    # a row for each set of the block in a list: its place, and how many sets come after it
    i = np.repeat(start, own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    after = np.repeat(start + length, own) - i - 1
    firsts, first = np.unique(rank[i], return_inverse=True)
    order = np.argsort(first, kind="stable")
    i, after, first = i[order], after[order], first[order]
    rows = max(1, MOST_CELLS // len(ids))
    found = []
    for low in range(0, len(firsts), rows):
        high = min(low + rows, len(firsts))
        count = np.zeros((high - low) * len(ids), np.int64)
        x, end = np.searchsorted(first, [low, high])
        total = np.cumsum(after[x:end])
        while x < end:
            done = total[len(total) - (end - x) - 1] if len(total) > end - x else 0
            y = max(x + 1, x + int(np.searchsorted(total[len(total) - (end - x) :], done + MOST_CELLS, side="right")))
            r = after[x:y]
            j = np.repeat(i[x:y] + 1 - (np.cumsum(r) - r), r) + np.arange(r.sum())
            count += np.bincount(np.repeat(first[x:y] - low, r) * len(ids) + rank[j], minlength=len(count))
            x = y
        cell = np.flatnonzero(count)
        found.append((firsts[low + cell // len(ids)], cell % len(ids), count[cell]))
    x, y, c = (np.concatenate(f) for f in zip(*found, strict=True))
    a, b = np.minimum(x, y), np.maximum(x, y)
    keep = a != b
    a, b, c = a[keep], b[keep], c[keep]
    # where two sets of the block are met in either order
    code, back = np.unique(a * len(ids) + b, return_inverse=True)
    a, b, c = code // len(ids), code % len(ids), np.bincount(back, c, len(code)).astype(np.int64)
    out = {"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "olap": pa.array(c)}
    return pa.table(out | ({"n1": pa.array(n[a]), "n2": pa.array(n[b])} if with_n else {}))


def candidate_overlaps(candidates: DataFrame, members: DataFrame, key: str = "gs_id", element: str = "gene") -> DataFrame:
    """(a, b, olap) of given pairs only; pairs with nothing in common get 0."""
    x = members.select(F.col(key).alias("a"), F.col(element).alias("e"))
    y = members.select(F.col(key).alias("b"), F.col(element).alias("e"))
    found = candidates.join(x, "a").join(y, ["b", "e"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("olap"))
    return candidates.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("olap", F.lit(0)).cast("long").alias("olap"))


def with_sizes(pairs: DataFrame, set_sizes: DataFrame, key: str = "gs_id") -> DataFrame:
    left = set_sizes.select(F.col(key).alias("a"), F.col("n").alias("n1"))
    right = set_sizes.select(F.col(key).alias("b"), F.col("n").alias("n2"))
    return pairs.join(left, "a").join(right, "b")


def enriched(pairs: DataFrame, universe: Column) -> DataFrame:
    """Pairs that overlap more than expected: universe * olap > n1 * n2."""
    return pairs.filter(universe * F.col("olap") > F.col("n1") * F.col("n2"))


def overlap_graph(members: DataFrame, alpha: float = 0.8, statistics: bool = True, key: str = "gs_id", element: str = "gene") -> DataFrame:
    """The weighted edge list: enriched pairs with Jaccard, overlap coefficient, composite and hypergeometric columns."""
    members = members.select(key, element).dropDuplicates()
    universe = members.agg(F.countDistinct(element).alias("universe"))
    pairs = overlaps(members, key, element, with_n=True).crossJoin(F.broadcast(universe))  # one row
    pairs = enriched(pairs, F.col("universe"))
    o, a, b, n = F.col("olap"), F.col("n1"), F.col("n2"), F.col("universe")
    out = pairs.withColumns({"jaccard": N.jaccard(o, a, b), "simpson": N.simpson(o, a, b), "similarity": N.composite(o, a, b, alpha)})
    if statistics:
        s = C.pair_statistics(o, n, a, b)
        out = out.withColumn("_s", s).select("*", "_s.*").drop("_s")
    return out


def shared_value_pairs(items: DataFrame, key: str, value: str, extra: list[Column] = ()) -> DataFrame:
    """(a, b, n_shared, values) for items a < b with common values; ``extra`` aggregates see columns of both sides as x.*, y.*."""
    d = items.select(key, value, *[c for c in items.columns if c not in (key, value)]).dropDuplicates([key, value])
    x, y = d.alias("x"), d.alias("y")
    joined = x.join(y, F.col(f"x.{value}") == F.col(f"y.{value}")).filter(F.col(f"x.{key}") < F.col(f"y.{key}"))
    return joined.groupBy(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).agg(
        F.count(F.lit(1)).alias("n_shared"), F.array_sort(F.collect_set(f"x.{value}")).alias("values"), *extra
    )


def prevalence_limited(items: DataFrame, key: str, value: str, share: float = 0.8) -> DataFrame:
    """Rows whose value at most int(share * number of items) items hold."""
    n = items.agg(F.countDistinct(key).alias("_n"))
    held = items.groupBy(value).agg(F.countDistinct(key).alias("_c")).crossJoin(F.broadcast(n))  # one row
    return items.join(held.filter(F.col("_c") <= F.floor(F.lit(share) * F.col("_n"))).select(value), value, "left_semi")


def min_support(items: DataFrame, value: str, least: int, key: str | None = None) -> DataFrame:
    count = F.countDistinct(key) if key else F.count(F.lit(1))
    held = items.groupBy(value).agg(count.alias("_c")).filter(F.col("_c") >= least)
    return items.join(held.select(value), value, "left_semi")
