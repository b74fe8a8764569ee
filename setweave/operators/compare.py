"""Governing runs: leaderboards, tolerances, grids and consistency between runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import numbers as N


def grid(spark, space: dict[str, list], cap: int | None = None) -> DataFrame:
    """One row for each combination of the parameters' values, numbered in the order of ``space``; at most ``cap``."""
    if not space or any(not isinstance(v, list) or not v for v in space.values()):
        raise ValueError("every parameter needs a non-empty list")
    frames = [spark.createDataFrame([(x,) for x in v], [k]) for k, v in space.items()]
    d = reduce(lambda a, b: a.crossJoin(b), frames)  # as many rows as the grid has points
    d = d.withColumn("trial", F.row_number().over(W.orderBy(*space)).cast("int"))
    return d.filter(F.col("trial") <= cap) if cap else d


def eligible(df: DataFrame, baseline: DataFrame, bounds: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds eligible: each metric against the one baseline row: ("min", r): >= r * base; ("max", r): <= r * base; nulls fail."""
    b = baseline.select(*[F.col(m).alias(f"_b_{m}") for m in bounds])
    ok = F.lit(True)
    for m, (side, r) in bounds.items():
        limit = F.col(f"_b_{m}") * r
        ok = ok & F.coalesce(F.col(m) >= limit if side == "min" else F.col(m) <= limit, F.lit(False))
    return df.crossJoin(F.broadcast(b)).withColumn("eligible", ok).drop(*[f"_b_{m}" for m in bounds])  # one row


def violations(metrics: DataFrame, baseline: DataFrame, relative: float, floor: float, one_sided: list[str] = ()) -> DataFrame:
    """Rows of long metrics (run, metric, value) that drift from the baseline (metric, value) beyond max(floor, relative * |base|).

    A metric in ``one_sided`` may fall freely and only counts where it rises.
    """
    b = baseline.select("metric", F.col("value").alias("base"))
    d = metrics.join(b, "metric").withColumn("delta", F.col("value") - F.col("base")).withColumn("limit", F.greatest(F.lit(floor), relative * F.abs("base")))
    up = F.col("metric").isin(list(one_sided)) if one_sided else F.lit(False)
    return d.filter(F.when(up, F.col("delta") > F.col("limit")).otherwise(F.abs("delta") > F.col("limit")))


def status(ref: Column, new: Column, ok: float = 2.0, warn: float = 5.0, near_zero: float = 0.005) -> Column:
    """OK, WARN or FAIL by percent difference; near zero (in both) by absolute difference; MISSING if one lacks."""
    pct, diff = N.pct_diff(ref, new), F.abs(new - ref)
    small = (F.abs(ref) < near_zero) & (F.abs(new) < near_zero)
    return (
        F.when(ref.isNull() | new.isNull(), "MISSING")
        .when(small, F.when(diff <= near_zero, "OK").when(diff <= 3 * near_zero, "WARN").otherwise("FAIL"))
        .when(pct <= ok, "OK").when(pct <= warn, "WARN").otherwise("FAIL")
    )


def consistency(ref: DataFrame, new: DataFrame, keys: list[str], value: str = "value", **limits) -> DataFrame:
    a, b = ref.select(*keys, F.col(value).alias("ref")), new.select(*keys, F.col(value).alias("new"))
    return a.join(b, keys, "full").withColumn("status", status(F.col("ref"), F.col("new"), **limits))


def leaderboard(parts: list[DataFrame], key: str, baseline: str, bounds: dict[str, tuple[str, float]], order: list[Column]) -> DataFrame:
    """Metric frames joined by ``key`` (all keys), with eligibility against the baseline's row, best first."""
    d = reduce(lambda a, b: a.join(b, key, "full"), parts)
    d = eligible(d, d.filter(F.col(key) == baseline), bounds)
    return d.withColumn("place", F.row_number().over(W.orderBy(F.desc("eligible"), *order, key)).cast("int"))


def improvement(metrics: dict[str, tuple[float, bool]], base: str = "base_") -> Column:
    """Weighted sum of relative improvements; (weight, higher is better) by metric, against columns named base_<metric>."""
    total = F.lit(0.0)
    for m, (weight, up) in metrics.items():
        change = N.guarded(F.col(m) - F.col(base + m), F.abs(F.col(base + m)))
        total = total + weight * (change if up else -change)
    return total


def metric_table(long: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """Long (keys, method, value) as one column a method."""
    return long.groupBy(*keys).pivot("method", methods).agg(F.first("value"))


def search(trials: DataFrame, baseline: DataFrame, key: str, weights: dict[str, tuple[float, bool]], guards: dict[str, bool], relative: float = 0.03, floor: float = 0.01) -> DataFrame:
    """A grid search's outcome: (key, score, n_violations, feasible, place) of trials (key, one column a metric), best first.

    ``weights``: metric -> (weight, higher is better), scored against the one baseline row.  ``guards``: metric ->
    one-sided; it may not drift from the baseline beyond max(floor, relative * |base|), or only not rise if one-sided.
    A trial that lacks a guarded metric breaks that guard.  Feasible trials come first, then higher scores, then lesser keys.
    """
    names = [*dict.fromkeys([*weights, *guards])]
    d = trials.select(key, *names).crossJoin(F.broadcast(baseline.select(*[F.col(m).alias(f"base_{m}") for m in names])))  # one row
    broken = F.lit(0)
    for m, one_sided in guards.items():
        drift = F.col(m) - F.col(f"base_{m}")
        most = F.greatest(F.lit(floor), relative * F.abs(F.col(f"base_{m}")))
        broken = broken + F.coalesce(((drift if one_sided else F.abs(drift)) > most).cast("int"), F.lit(1))
    d = d.select(key, F.round(improvement(weights), 9).alias("score"), broken.alias("n_violations")).withColumn("feasible", F.col("n_violations") == 0)
    # as many rows as the grid has points
    return d.withColumn("place", F.row_number().over(W.orderBy(F.desc("feasible"), F.desc("score"), key)).cast("int"))


def over_seeds(runs: DataFrame, chosen_by: str, keys: list[str] = (), seed: str = "seed") -> DataFrame:
    """[keys], metric, n, mean, std (sample; 0 for one), representative: long (keys, seed, metric, value) over the seeds.

    The representative is the seed whose value of ``chosen_by`` is nearest to the median (ties: least seed).
    """
    keys = list(keys)
    own = runs.filter(F.col("metric") == chosen_by)
    middle = own.groupBy(*keys).agg(F.median("value").alias("_m"))
    near = own.join(middle, keys) if keys else own.crossJoin(F.broadcast(middle))  # one row
    pick = near.groupBy(*keys).agg(F.min_by(seed, F.struct(F.round(F.abs(F.col("value") - F.col("_m")), 9), F.col(seed))).alias("representative"))
    s = runs.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    return s.join(pick, keys, "left") if keys else s.crossJoin(F.broadcast(pick))  # one row


def representative(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row nearest to the median (ties: least key)."""
    m = df.agg(F.median(value).alias("_m"))
    return df.crossJoin(F.broadcast(m)).orderBy(F.abs(F.col(value) - F.col("_m")), key).limit(1).drop("_m")  # one row


def best_recipe(board: DataFrame, key: str, score: str, baseline: str, controls: tuple[str, ...] = ("shuffle_control", "random_control")) -> DataFrame:
    """One row: the recipe of best score that is neither the baseline nor a control (ties: least name); the baseline if there is none."""
    rest = board.filter(~F.col(key).isin(baseline, *controls)).filter(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(1).select(key)
    none = rest.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(F.lit(baseline).alias(key))
    return rest.unionByName(none)
