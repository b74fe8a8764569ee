"""Window operators: false discovery rates, ranks, scaling and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Ranges that an order over all rows is dealt in.
RANGES = 32


def range_of(df: DataFrame, column: str) -> Column:
    """A number of the range that a value lies in, growing with the value; cut at approximate quantiles (at most RANGES numbers on the driver)."""
    if dict(df.dtypes)[column] not in ("double", "float", "bigint", "int", "smallint", "tinyint") and not dict(df.dtypes)[column].startswith("decimal"):
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(column, [k / RANGES for k in range(1, RANGES)], 1000)).first()[0] or []
    out = F.lit(0)
    for c in sorted(set(cuts)):
        out = out + F.coalesce((F.col(column) > F.lit(c)).cast("int"), F.lit(0))
    return out


def running(df: DataFrame, column: str, sums: dict[str, str], by: list[str] = ()) -> DataFrame:
    """Adds running sums (new name -> column) in the order of ``column``, whose values are distinct (within groups).

    Without groups the order is dealt in ranges: each range has its own window, and adds what the ranges before it sum to.
    """
    if by:
        w = W.partitionBy(*by).orderBy(column).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({new: F.sum(old).over(w) for new, old in sums.items()})
    d = df.withColumn("_range", range_of(df, column))
    totals = d.groupBy("_range").agg(*[F.sum(old).alias(f"_t_{new}") for new, old in sums.items()])
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # at most RANGES rows
    totals = totals.select(F.col("_range").alias("_own"), *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in sums])
    w = W.partitionBy("_range").orderBy(column).rowsBetween(W.unboundedPreceding, 0)
    d = d.join(F.broadcast(totals), F.col("_range") == F.col("_own"))  # at most RANGES rows
    return d.withColumns({new: F.sum(old).over(w) + F.col(f"_b_{new}") for new, old in sums.items()}).drop("_range", "_own", *[f"_b_{new}" for new in sums])


def numbered(df: DataFrame, order: list[Column], part: Column, by: list[str] = (), out: str = "i") -> DataFrame:
    """Adds the place, from 1, of each row in ``order`` (within groups).

    ``part`` must not fall along the order: each part has its own window, and adds the rows of the parts before it.
    """
    by = list(by)
    d = df.withColumn("_part", part)
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    counts = d.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_own"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    on = F.col("_part") == F.col("_own")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rank = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))
    return d.join(counts, on).withColumn(out, rank + F.col("_b")).drop("_part", "_own", "_b", *[f"_by_{c}" for c in by])


def benjamini_hochberg(df: DataFrame, p: str = "p", by: list[str] = (), tests: str | None = None, out: str = "q") -> DataFrame:
    """q = min over larger p of p * n / rank, cut at 1; n is the rows of the group, or the column ``tests``.

    ``tests`` may be more than the rows: tests that aren't rows have p = 1.  Ties in p take the last
    rank among them, so the order of equal rows doesn't matter.  The windows run over distinct p values.
    """
    by = list(by)
    n = F.max(tests) if tests else F.count(F.lit(1))
    counts = df.groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"), n.alias("_n"))
    up = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*by).orderBy("_p").rowsBetween(0, W.unboundedFollowing)
    total = F.col("_n") if tests else F.sum("_n").over(W.partitionBy(*by))
    ranked = counts.withColumn("_q", F.col("_p") * total / F.sum("_c").over(up))
    ranked = ranked.withColumn("_q", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min("_q").over(down)))).drop("_c", "_n")
    on = F.col(f"d.{p}").eqNullSafe(F.col("r._p"))
    for c in by:
        on = on & F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}"))
    return df.alias("d").join(ranked.alias("r"), on).select("d.*", F.col("r._q").alias(out))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; give a total order."""
    return df.withColumn("_rk", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_rk") <= k).drop("_rk")


def average_rank(df: DataFrame, column: str, out: str, by: list[str] = ()) -> DataFrame:
    """Ranks from 1; equal values share the mean of theirs."""
    values = df.groupBy(*by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    values = running(values, "_v", {"_b": "_c"}, by).withColumn("_r", F.col("_b") - (F.col("_c") - 1) / 2).drop("_b", "_c")
    on = F.col("d." + column).eqNullSafe(F.col("v._v"))
    for c in by:
        on = on & F.col(f"d.{c}").eqNullSafe(F.col(f"v.{c}"))
    return df.alias("d").join(values.alias("v"), on).select("d.*", F.col("v._r").alias(out))


#: Quantiles of the map, and the largest score: the normal quantile of 1e-7 from either end.
QUANTILES, MOST_SCORE = 1000, 5.199337582605575


def rank_gauss(df: DataFrame, column: str, out: str) -> DataFrame:
    """Values through their quantile map to the normal distribution: the least gives -MOST_SCORE, the largest MOST_SCORE.

    The map has at most QUANTILES points (numbers on the driver) with straight lines between; equal values
    take the middle of their range.  Fewer than eight rows are z-scored instead.
    """
    import numpy as np

    n = df.agg(F.count(column)).first()[0]
    if n < 8:
        return scaled(df.withColumn(out, F.col(column).cast("double")), [out])
    shares = np.linspace(0, 1, min(QUANTILES, n))
    points = np.array(df.agg(F.percentile(F.col(column).cast("double"), shares.tolist())).first()[0])
    points = np.maximum.accumulate(points)

    @F.pandas_udf("double")
    def share(x):
        up, down = np.interp(x, points, shares), -np.interp(-x, -points[::-1], -shares[::-1])
        return type(x)(0.5 * (up + down), index=x.index).where(x.notna())

    p = share(F.col(column).cast("double"))
    d = df.withColumn("_p", p)
    score = F.when(F.col("_p") <= 1e-7, -MOST_SCORE).when(F.col("_p") >= 1 - 1e-7, MOST_SCORE).otherwise(normal_quantile(F.col("_p")))
    return d.withColumn(out, score).drop("_p")


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, by a rational approximation (relative error under 1.2e-9)."""
    # The coefficients of the published approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(xs, t):
        out = F.lit(xs[0])
        for x in xs[1:]:
            out = out * t + x
        return out

    q = p - 0.5
    r = q * q
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    tail = lambda t: poly(c, t) / poly(d, t)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(q * poly(a, r) / poly(b, r))


def scaled(df: DataFrame, columns: list[str], how: str = "zscore", tiny: float = 1e-12) -> DataFrame:
    """Each column less its mean (median) over its population deviation (quartile distance); a tiny divisor is 1."""
    agg = []
    for c in columns:
        x = F.col(c).cast("double")
        if how == "zscore":
            agg += [F.avg(x).alias(f"_m_{c}"), F.stddev_pop(x).alias(f"_s_{c}")]
        else:
            agg += [F.median(x).alias(f"_m_{c}"), (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias(f"_s_{c}")]
    d = df.crossJoin(F.broadcast(df.agg(*agg)))  # one row
    for c in columns:
        s = F.col(f"_s_{c}")
        d = d.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(s <= tiny, F.lit(1.0)).otherwise(s))
    return d.select(*df.columns)


def gini(df: DataFrame, size: str = "n", by: list[str] = ()) -> DataFrame:
    """Gini coefficient of sizes, and the largest and smallest share; the window runs over distinct sizes."""
    by = list(by)
    d = running(df.groupBy(*by, F.col(size).alias("_s")).agg(F.count(F.lit(1)).alias("_c")), "_s", {"_b": "_c"}, by)
    c, s, b = F.col("_c"), F.col("_s"), F.col("_b")
    ranks = c * b - c * (c - 1) / 2  # the sum of the ranks of equal sizes
    total, n = F.sum(c * s), F.sum(c)
    return d.groupBy(*by).agg(
        (2 * F.sum(ranks * s) / (n * total) - (n + 1) / n).alias("gini"), (F.max(s) / total).alias("largest"), (F.min(s) / total).alias("smallest")
    )
