"""Over-representation of values in clusters, permutation nulls and redundancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import combinatorics as C, numbers as N
from . import ranking, sampling


def tested(cells: DataFrame) -> DataFrame:
    """Adds er and p to cells (a of n in the cluster, g of universe overall)."""
    a, n, g, u = (F.col(c) for c in ("a", "n", "g", "universe"))
    er = N.guarded(N.guarded(a, n), N.guarded(g, u))
    return cells.withColumns({"er": er, "p": C.survival(a, u, g, n)})


def metadata_enrichment(items: DataFrame, values: DataFrame, key: str, cluster: str, value: str, least: int = 1) -> DataFrame:
    """(cluster, value, a, n, g, universe, er, p, q) of the cells that occur.

    ``items``: key, cluster, one row an item.  ``values``: key, value.  False discovery control is over
    all clusters times all supported values; cells with a = 0 have p = 1 and only count in that number.
    """
    values = values.select(key, value).dropDuplicates()
    support = values.join(items.select(key), key, "left_semi").groupBy(value).agg(F.count(F.lit(1)).alias("g")).filter(F.col("g") >= least)
    universe = items.agg(F.count(F.lit(1)).alias("universe"), F.countDistinct(cluster).alias("_k")).crossJoin(support.agg(F.count(F.lit(1)).alias("_v")))
    n = items.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    cells = values.join(items.select(key, cluster), key).groupBy(cluster, value).agg(F.count(F.lit(1)).alias("a"))
    cells = cells.join(support, value).join(n, cluster).crossJoin(F.broadcast(universe))  # one row
    cells = tested(cells)
    return ranking.benjamini_hochberg(cells.withColumn("_tests", F.col("_k") * F.col("_v")), "p", tests="_tests").drop("_k", "_v", "_tests")


def over_representation(membership: DataFrame, assignments: DataFrame, low: int = 1, high: int = 0) -> DataFrame:
    """Gene-level test of every term against every cluster, by context (threshold).

    ``membership``: gs_id, gene.  ``assignments``: threshold, cluster, gs_id.  A cluster's genes are the
    union of its sets' genes; terms are the sets themselves with low <= genes in the universe <= high
    (high <= 0: no bound).  False discovery control is per threshold and cluster.
    """
    m = membership.select("gs_id", "gene").dropDuplicates()
    genes = assignments.join(m, "gs_id").select("threshold", "cluster", "gene").distinct()
    n = genes.groupBy("threshold", "cluster").agg(F.count(F.lit(1)).alias("n"))
    universe = m.agg(F.countDistinct("gene").alias("universe"))
    size = m.groupBy(F.col("gs_id").alias("term")).agg(F.count(F.lit(1)).alias("g"))
    size = size.filter((F.col("g") >= low) & (F.lit(high <= 0) | (F.col("g") <= high)))
    hits = genes.join(m, "gene").groupBy("threshold", "cluster", F.col("gs_id").alias("term")).agg(F.count(F.lit(1)).alias("a"))
    cells = hits.join(size, "term").join(n, ["threshold", "cluster"])
    terms = size.agg(F.count(F.lit(1)).alias("_n"))
    cells = tested(cells.crossJoin(F.broadcast(universe)).crossJoin(F.broadcast(terms)))  # one row each
    return ranking.benjamini_hochberg(cells, "p", ["threshold", "cluster"], "_n").drop("_n")


def significant(cells: DataFrame, fdr: float = 0.05) -> DataFrame:
    return cells.filter((F.col("a") > 0) & (F.col("q") <= fdr))


def empirical_p(null: DataFrame, observed: Column, value: str = "value", by: list[str] = ()) -> DataFrame:
    """[by], p, n_null: (number of null values >= observed, and one) over (number, and one); null without null values."""
    n = F.count(value)
    hits = F.sum(F.when(F.col(value) >= observed, 1).otherwise(0))
    return null.groupBy(*by).agg(F.when(n > 0, (hits + 1) / (n + 1)).alias("p"), n.alias("n_null"))


def permutation_null(items: DataFrame, key: str, label: str, replicates: int, seed: int) -> DataFrame:
    """(rep, key, label) with labels dealt anew in each replicate: one plan for all of them."""
    reps = items.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("rep"))
    every = items.select(key, label).crossJoin(F.broadcast(reps))  # as many rows as replicates
    return sampling.permuted(every, key, label, F.concat_ws("-", F.lit(seed), "rep"), by=["rep"])


def redundancy(terms: DataFrame, members: DataFrame, by: list[str], jaccard: float = 0.7, overlap: float = 0.9) -> DataFrame:
    """[by], term, kept_as, is_redundant: terms in rank order stay unless they are alike one that stays.

    ``terms``: by, term, rank (a short list in each group).  ``members``: term, element.
    """
    import pandas as pd

    sets = members.groupBy("term").agg(F.collect_set("element").alias("elements"))
    d = terms.join(sets, "term").select(*by, "term", "rank", "elements")
    kinds = dict(d.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept, rows = [], []
        for r in group.sort_values(["rank", "term"]).itertuples():
            own, like = set(r.elements), None
            for term, other in kept:
                both = len(own & other)
                if both / len(own | other) >= jaccard or both / min(len(own), len(other)) >= overlap:
                    like = term
                    break
            if like is None:
                kept.append((r.term, own))
            rows.append((*[group[c].iloc[0] for c in by], r.term, r.term if like is None else like, like is not None))
        return pd.DataFrame(rows, columns=[*by, "term", "kept_as", "is_redundant"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, "term"]) + f", kept_as {kinds['term']}, is_redundant boolean"
    return d.groupBy(*by).applyInPandas(run, schema)
