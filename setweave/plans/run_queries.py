"""Governing runs: eligibility, tolerances, grids, leaderboards and consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import compare
from ..schema import table
from .registry import query, rounded

#: Metrics of "runs": suppliers' order lines by flag, in long form.
RUNS = "r AS (SELECT l_suppkey AS run, l_returnflag AS metric, avg(l_discount) * 100 AS value FROM lineitem GROUP BY ALL)"


def runs(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("metric")).agg((F.avg("l_discount") * 100).alias("value"))


@query(f"""WITH {RUNS}, b AS (SELECT metric, value AS base FROM r WHERE run = 1)
SELECT run, metric, round(value - base, 6) + 0.0 AS delta FROM r JOIN b USING (metric) WHERE CASE WHEN metric = 'R' THEN value - base > greatest(0.1, 0.05 * abs(base)) ELSE abs(value - base) > greatest(0.1, 0.05 * abs(base)) END""")
def constraint_violations(spark, sf):
    d = runs(spark, sf)
    return rounded(compare.violations(d, d.filter("run = 1"), 0.05, 0.1, ["R"]).select("run", "metric", (F.round("delta", 6) + 0.0).alias("delta")))


WIDE = f"{RUNS}, w AS (SELECT run, max(value) FILTER (metric = 'A') AS a, max(value) FILTER (metric = 'N') AS n, max(value) FILTER (metric = 'R') AS r FROM r GROUP BY 1)"


def wide(spark, sf) -> DataFrame:
    d = runs(spark, sf).withColumnRenamed("metric", "method").withColumn("value", F.col("value"))
    return compare.metric_table(d, ["run"], ["A", "N", "R"]).toDF("run", "a", "n", "r")


@query(f"""WITH {WIDE} SELECT w.run, coalesce(w.a >= b.a * 0.98 AND w.n <= b.n * 1.05 AND w.r <= b.r * 1.02, false) AS eligible FROM w, (SELECT * FROM w WHERE run = 1) b""")
def eligibility(spark, sf):
    d = wide(spark, sf)
    return compare.eligible(d, d.filter("run = 1"), {"a": ("min", 0.98), "n": ("max", 1.05), "r": ("max", 1.02)}).select("run", "eligible")


@query(f"""WITH {WIDE}, e AS (SELECT w.*, coalesce(w.a >= b.a * 0.98 AND w.n <= b.n * 1.05, false) AS eligible FROM w, (SELECT * FROM w WHERE run = 1) b)
SELECT run, eligible, round(a, 6) AS a, row_number() OVER (ORDER BY eligible DESC, round(a, 6) DESC NULLS LAST, run)::INT AS place FROM e""")
def leaderboard(spark, sf):
    d = wide(spark, sf)
    board = compare.leaderboard([d.select("run", "a"), d.select("run", "n")], "run", 1, {"a": ("min", 0.98), "n": ("max", 1.05)}, [F.round("a", 6).desc_nulls_last()])
    return rounded(board.select("run", "eligible", "a", "place"))


@query(f"""WITH {RUNS}, x AS (SELECT metric, run // 2 AS k, value FROM r WHERE run % 2 = 0), y AS (SELECT metric, run // 2 AS k, value FROM r WHERE run % 2 = 1),
j AS (SELECT metric, k, x.value AS ref, y.value AS new FROM x FULL JOIN y USING (metric, k))
SELECT metric, k, CASE WHEN ref IS NULL OR new IS NULL THEN 'MISSING' WHEN abs(ref) < 0.005 AND abs(new) < 0.005 THEN CASE WHEN abs(new - ref) <= 0.005 THEN 'OK' WHEN abs(new - ref) <= 0.015 THEN 'WARN' ELSE 'FAIL' END
WHEN abs(new - ref) / abs(ref) * 100 <= 2 THEN 'OK' WHEN abs(new - ref) / abs(ref) * 100 <= 5 THEN 'WARN' ELSE 'FAIL' END AS status FROM j""")
def consistency_status(spark, sf):
    d = runs(spark, sf).withColumn("k", F.floor(F.col("run") / 2))
    return compare.consistency(d.filter("run % 2 = 0"), d.filter("run % 2 = 1"), ["metric", "k"]).select("metric", "k", "status")


@query("""WITH g AS (SELECT a, b, c FROM unnest([0.1, 0.5]) x(a), unnest([16, 32, 64]) y(b), unnest(['zscore', 'robust']) z(c)) SELECT a::DOUBLE AS scale, b::BIGINT AS dim, c AS norm, row_number() OVER (ORDER BY a, b, c)::INT AS trial FROM g QUALIFY trial <= 10""")
def grid_expand(spark, sf):
    return compare.grid(spark, {"scale": [0.1, 0.5], "dim": [16, 32, 64], "norm": ["zscore", "robust"]}, 10)


@query(f"""WITH {WIDE} SELECT w.run, round(0.6 * coalesce((w.a - b.a) / abs(b.a), 0) - 0.4 * coalesce((w.n - b.n) / abs(b.n), 0), 6) + 0.0 AS score FROM w, (SELECT * FROM w WHERE run = 1) b""")
def improvement_score(spark, sf):
    d = wide(spark, sf)
    base = d.filter("run = 1").select(F.col("a").alias("base_a"), F.col("n").alias("base_n"))
    s = compare.improvement({"a": (0.6, True), "n": (0.4, False)})
    return d.crossJoin(F.broadcast(base)).select("run", (F.round(s, 6) + 0.0).alias("score"))  # one row


@query(f"WITH {RUNS} SELECT metric, round(max(value) FILTER (run = 1), 6) AS run1, round(max(value) FILTER (run = 2), 6) AS run2, round(max(value) FILTER (run = 3), 6) AS run3 FROM r WHERE run <= 3 GROUP BY 1")
def metric_method_table(spark, sf):
    d = runs(spark, sf).filter("run <= 3").withColumn("method", F.concat(F.lit("run"), F.col("run").cast("string")))
    return rounded(compare.metric_table(d, ["metric"], ["run1", "run2", "run3"]))


@query(f"WITH {WIDE} SELECT run, round(a, 6) AS a FROM w, (SELECT median(a) AS m FROM w) ORDER BY round(abs(a - m), 9), run LIMIT 1")
def representative_seed(spark, sf):
    return rounded(compare.representative(wide(spark, sf).select("run", F.round("a", 9).alias("a")), "run", "a"))


@query("""WITH c AS (SELECT user_id % 5 AS seed, event_id AS epoch, value FROM events WHERE value IS NOT NULL)
SELECT seed, epoch, round(max(value) OVER (PARTITION BY seed ORDER BY epoch), 6) AS best FROM c""")
def running_best(spark, sf):
    d = table(spark, sf, "events").filter("value is not null").select((F.col("user_id") % 5).alias("seed"), F.col("event_id").alias("epoch"), "value")
    return rounded(d.withColumn("best", F.max("value").over(W.partitionBy("seed").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0))).drop("value"))


@query("""WITH s AS (SELECT n_regionkey AS g, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), c AS (SELECT n_regionkey AS g, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000 GROUP BY 1)
SELECT r_name, coalesce(customers, 0)::BIGINT AS customers, coalesce(suppliers, 0)::BIGINT AS suppliers FROM region LEFT JOIN s ON s.g = r_regionkey LEFT JOIN c ON c.g = r_regionkey""")
def dashboard_join(spark, sf):
    n = table(spark, sf, "nation")
    s = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("customers"))
    c = table(spark, sf, "supplier").filter("s_acctbal > 9000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("suppliers"))
    d = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey").join(s, "n_regionkey", "left").join(c, "n_regionkey", "left")
    return d.select("r_name", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("customers", "suppliers")])


@query("""WITH m AS (SELECT l_returnflag AS metric, l_linestatus AS category, avg(l_quantity) AS value FROM lineitem GROUP BY ALL) SELECT k.metric, k.category, round(value, 6) AS value
FROM (VALUES ('A', 'F'), ('N', 'O'), ('Z', 'F')) k(metric, category) LEFT JOIN m ON m.metric = k.metric AND m.category = k.category""")
def keyed_lookup(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("category")).agg(F.avg("l_quantity").alias("value"))
    keys = spark.createDataFrame([("A", "F"), ("N", "O"), ("Z", "F")], "metric string, category string")
    return rounded(keys.join(m, ["metric", "category"], "left"))
