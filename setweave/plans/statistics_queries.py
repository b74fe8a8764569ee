"""Hypergeometric tests, enrichment, false discovery, permutation nulls, ranks and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import combinatorics as C, numbers as N
from ..operators import enrichment, ranking, sampling, setsim
from ..schema import table
from .registry import query, rounded
from .relational_queries import EDGES, MEMBERS, edges, members

#: ln(n choose k) in SQL.
CHOOSE = "lgamma(({0}) + 1.0) - lgamma(({1}) + 1.0) - lgamma(({0}) - ({1}) + 1.0)"


def _pmf(o: str, n: str, a: str, b: str) -> str:
    return f"({CHOOSE.format(a, o)} + {CHOOSE.format(f'{n} - {a}', f'{b} - {o}')} - ({CHOOSE.format(n, b)}))"


def _tail(low: str, high: str, n: str, a: str, b: str) -> str:
    """P(low <= X <= high) in SQL, as a list sum."""
    return f"coalesce(list_sum(list_transform(range(greatest({low}, 0, {a} + {b} - {n})::BIGINT, (least({high}, {a}, {b}) + 1)::BIGINT), lambda i: exp({_pmf('i', n, a, b)}))), 0)"


@query(f"""WITH {MEMBERS}, n AS (SELECT gs_id, count(*) AS n FROM m GROUP BY 1), u AS (SELECT count(DISTINCT gene) AS u FROM m),
o AS (SELECT x.gs_id AS a, y.gs_id AS b, count(*) AS o FROM m x JOIN m y ON x.gene = y.gene AND x.gs_id < y.gs_id GROUP BY ALL),
p AS (SELECT a, b, o, p.n AS n1, q.n AS n2, u FROM o JOIN n p ON p.gs_id = a JOIN n q ON q.gs_id = b, u WHERE u * o > p.n * q.n)
SELECT a, b, o AS olap, round(-{_pmf('o', 'u', 'n1', 'n2')}, 5) AS nlogpmf, round(least({_tail('0', 'o - 1', 'u', 'n1', 'n2')}, 1), 5) AS cdf,
round(-ln(least({_tail('0', 'least(n1, n2) - o', 'u', 'n1', 'n2')}, 1)), 5) + 0.0 AS nlogcdf FROM p""")
def hypergeom_pairs(spark, sf):
    d = setsim.overlap_graph(members(spark, sf)).select("a", "b", "olap", "nlogpmf", "cdf", "nlogcdf")
    return rounded(d, 5).withColumn("nlogcdf", F.col("nlogcdf") + 0.0)


def clustered_customers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Items with a cluster (customers of a nation, by region), and values of items (parts' brands that they bought)."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    items = c.select(F.col("c_custkey").alias("k"), F.col("n_regionkey").alias("cluster"))
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items, o.select(F.col("o_custkey").alias("k"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("value"))


ENRICH = f"""i AS (SELECT c_custkey AS k, n_regionkey AS cluster FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT DISTINCT o_custkey AS k, p_brand || '/' || p_size AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
g AS (SELECT value, count(*) AS g FROM v WHERE k IN (SELECT k FROM i) GROUP BY 1 HAVING count(*) >= 20), n AS (SELECT cluster, count(*) AS n FROM i GROUP BY 1),
t AS (SELECT count(*) AS universe, count(DISTINCT cluster) * (SELECT count(*) FROM g) AS tests FROM i),
a AS (SELECT cluster, value, count(*) AS a FROM v JOIN i USING (k) GROUP BY ALL),
c AS (SELECT cluster, value, a, n, g, universe, tests, round(coalesce((a / n) / (g / universe), 0), 9) AS er,
      round(least({_tail('a', 'least(g, n)', 'universe', 'g', 'n')}, 1), 9) AS p FROM a JOIN g USING (value) JOIN n USING (cluster), t),
r AS (SELECT *, p * tests / (count(*) OVER (ORDER BY p)) AS raw FROM c),
q AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q0 FROM r),
e AS (SELECT cluster, value, a, n, g, universe, er, p, min(q0) OVER (PARTITION BY p) AS q FROM q)"""


def _enriched(spark, sf) -> DataFrame:
    items, values = clustered_customers(spark, sf)
    # p is rounded before the ranks, so that equal ones are equal in any engine
    cells = enrichment.metadata_enrichment(items, values, "k", "cluster", "value", least=20).drop("q")
    tests = items.agg(F.countDistinct("cluster").alias("_k")).crossJoin(cells.agg(F.countDistinct("value").alias("_v")))
    cells = cells.withColumns({"p": F.round("p", 9), "er": F.round("er", 9)}).crossJoin(F.broadcast(tests.select((F.col("_k") * F.col("_v")).alias("_t"))))  # one row
    return ranking.benjamini_hochberg(cells, "p", tests="_t").drop("_t")


@query(f"WITH {ENRICH} SELECT cluster, value, a, n, g, universe, round(er, 5) AS er, round(p, 5) AS p, round(q, 5) AS q FROM e")
def enrichment_meta(spark, sf):
    return rounded(_enriched(spark, sf).select("cluster", "value", "a", "n", "g", "universe", "er", "p", "q"), 5)


@query(f"WITH {ENRICH} SELECT cluster, value, round(q, 5) AS q, round(er, 5) AS er FROM e QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(q, 7), round(er, 7) DESC, value) <= 5")
def enrichment_topn(spark, sf):
    d = _enriched(spark, sf)
    return rounded(ranking.top_per_group(d, ["cluster"], [F.round("q", 7).asc(), F.round("er", 7).desc(), F.asc("value")], 5).select("cluster", "value", "q", "er"), 5)


@query(f"""WITH {ENRICH} SELECT cluster, count(*) AS tested, count(*) FILTER (q <= 0.5) AS significant, round(max(er), 5) AS max_er, round(min(q), 5) AS min_q,
round(-log10(greatest(min(q), 1e-300)), 4) + 0.0 AS max_log10q, arg_min(value, (round(p, 7), value)) AS best FROM e GROUP BY 1""")
def enrichment_best(spark, sf):
    d = _enriched(spark, sf).groupBy("cluster")
    d = d.agg(
        F.count(F.lit(1)).alias("tested"), F.count(F.when(F.col("q") <= 0.5, 1)).alias("significant"), F.max("er").alias("max_er"), F.min("q").alias("min_q"),
        N.neg_log10(F.min("q")).alias("max_log10q"), F.min_by("value", F.struct(F.round("p", 7), F.col("value"))).alias("best"),
    )
    return d.select("cluster", "tested", "significant", F.round("max_er", 5).alias("max_er"), F.round("min_q", 5).alias("min_q"), (F.round("max_log10q", 4) + 0.0).alias("max_log10q"), "best")


@query("""WITH p AS (SELECT event_type, event_id, round(((event_id * 7919) % 10007) / 10007, 4) AS p FROM events),
r AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / count(*) OVER (PARTITION BY event_type ORDER BY p) AS raw FROM p),
q AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY event_type ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q0 FROM r)
SELECT event_type, event_id, p, round(min(q0) OVER (PARTITION BY event_type, p), 6) AS q FROM q""")
def bh_fdr(spark, sf):
    p = F.round(((F.col("event_id") * 7919) % 10007) / 10007, 4)
    return rounded(ranking.benjamini_hochberg(table(spark, sf, "events").select("event_type", "event_id", p.alias("p")), "p", ["event_type"]))


@query(f"""WITH {MEMBERS}, s AS (SELECT s_suppkey AS gs_id, s_nationkey % 4 AS cluster, '0.80' AS threshold FROM supplier),
gc AS (SELECT DISTINCT threshold, cluster, gene FROM s JOIN m USING (gs_id)), n AS (SELECT threshold, cluster, count(*) AS n FROM gc GROUP BY ALL), u AS (SELECT count(DISTINCT gene) AS universe FROM m),
z AS (SELECT gs_id AS term, count(*) AS g FROM m GROUP BY 1 HAVING count(*) BETWEEN 10 AND 505), k AS (SELECT count(*) AS tests FROM z),
c AS (SELECT threshold, cluster, gs_id AS term, count(*) AS a FROM gc JOIN m USING (gene) GROUP BY ALL),
w AS (SELECT *, round((a / n) / (g / universe), 9) AS er, round(least({_tail('a', 'least(g, n)', 'universe', 'g', 'n')}, 1), 9) AS p FROM c JOIN z USING (term) JOIN n USING (threshold, cluster), u, k),
r AS (SELECT *, p * tests / count(*) OVER (PARTITION BY threshold, cluster ORDER BY p) AS raw FROM w),
q AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY threshold, cluster ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q0 FROM r)
SELECT threshold, cluster, term, a, g, n, round(er, 5) AS er, round(p, 5) AS p, round(min(q0) OVER (PARTITION BY threshold, cluster, p), 5) AS q FROM q""")
def ora_enrichment(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gs_id"), (F.col("s_nationkey") % 4).alias("cluster"), F.lit("0.80").alias("threshold"))
    d = enrichment.over_representation(members(spark, sf), s, 10, 505).drop("q")
    tests = setsim.sizes(members(spark, sf)).filter("n between 10 and 505").agg(F.count(F.lit(1)).alias("_t"))
    d = d.withColumns({"p": F.round("p", 9), "er": F.round("er", 9)}).crossJoin(F.broadcast(tests))  # one row
    d = ranking.benjamini_hochberg(d, "p", ["threshold", "cluster"], "_t")
    return rounded(d.select("threshold", "cluster", "term", "a", "g", "n", "er", "p", "q"), 5)


@query("""WITH i AS (SELECT c_custkey AS k, c_nationkey % 5 AS c, c_acctbal AS x FROM customer), r AS (SELECT unnest(range(1, 21))::INT AS rep),
a AS (SELECT rep, k, row_number() OVER (PARTITION BY rep ORDER BY k) AS i FROM i, r),
b AS (SELECT rep, c, row_number() OVER (PARTITION BY rep ORDER BY md5('11-' || rep || ':' || k), k) AS i FROM i, r),
p AS (SELECT a.rep, b.c, avg(x) AS m FROM a JOIN b USING (rep, i) JOIN i USING (k) GROUP BY ALL), n AS (SELECT rep, max(m) - min(m) AS value FROM p GROUP BY 1),
o AS (SELECT max(m) - min(m) AS obs FROM (SELECT c, avg(x) AS m FROM i GROUP BY 1))
SELECT round(max(obs), 4) AS observed, round(avg(value), 4) AS null_mean, round(stddev_pop(value), 4) AS null_sd, round((count(*) FILTER (value >= obs) + 1) / (count(*) + 1), 6) AS p FROM n, o""")
def perm_null(spark, sf):
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("c"), F.col("c_acctbal").alias("x"))
    spread = lambda d, by: d.groupBy(*by).agg((F.max("m") - F.min("m")).alias("value"))
    dealt = enrichment.permutation_null(items, "k", "c", 20, 11).join(items.select("k", "x"), "k")
    null = spread(dealt.groupBy("rep", "c").agg(F.avg("x").alias("m")), ["rep"])
    obs = spread(items.groupBy("c").agg(F.avg("x").alias("m")), []).withColumnRenamed("value", "obs")
    d = null.crossJoin(F.broadcast(obs))  # one row
    p = enrichment.empirical_p(d, F.col("obs"))
    stats = d.agg(F.max("obs").alias("observed"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_sd"))
    return stats.crossJoin(p.select("p")).select(F.round("observed", 4).alias("observed"), F.round("null_mean", 4).alias("null_mean"), F.round("null_sd", 4).alias("null_sd"), F.round("p", 6).alias("p"))


@query("""WITH o AS (SELECT user_id % 7 AS g, value FROM events WHERE value IS NOT NULL)
SELECT g, round((count(*) FILTER (value >= 50) + 1) / (count(*) + 1), 6) AS p, count(*) AS n_null FROM o GROUP BY 1""")
def empirical_p(spark, sf):
    d = table(spark, sf, "events").select((F.col("user_id") % 7).alias("g"), "value")
    return rounded(enrichment.empirical_p(d, F.lit(50.0), by=["g"]))


@query("""WITH r AS (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rk FROM part) SELECT p_partkey, rk::DOUBLE AS rk FROM r""")
def average_ranks(spark, sf):
    return ranking.average_rank(table(spark, sf, "part"), "p_size", "rk").select("p_partkey", "rk")


@query("""WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, median(c_acctbal) AS md, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer)
SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z, round((c_acctbal - md) / iqr, 6) AS robust FROM customer, s""")
def zscore(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("z"), F.col("c_acctbal").alias("robust"))
    return rounded(ranking.scaled(ranking.scaled(d, ["z"]), ["robust"], "robust"))


@query("""WITH r AS (SELECT c_custkey, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS rk, count(*) OVER () AS n FROM customer)
SELECT c_custkey, round((rk - 0.5) / n, 6) AS quantile FROM r""")
def rank_quantiles(spark, sf):
    d = table(spark, sf, "customer")
    r = ranking.average_rank(d, "c_acctbal", "rk").crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return rounded(r.select("c_custkey", ((F.col("rk") - 0.5) / F.col("n")).alias("quantile")))


@query()
def rank_gauss(spark, sf):
    d = ranking.rank_gauss(table(spark, sf, "customer"), "c_acctbal", "g")
    return rounded(d.select("c_custkey", "g"))


@query("""SELECT k, ln_fact FROM (SELECT l_linenumber * 13 AS k, round(lgamma(l_linenumber * 13 + 1.0), 6) AS ln_fact FROM lineitem) GROUP BY ALL""")
def log_factorials(spark, sf):
    k = (F.col("l_linenumber") * 13).cast("int")
    return rounded(table(spark, sf, "lineitem").select(k.alias("k")).distinct().withColumn("ln_fact", C.log_factorial(F.col("k"))))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('5:' || o_orderkey), o_orderkey LIMIT 500")
def hashed_sample(spark, sf):
    return sampling.sample(table(spark, sf, "orders"), "o_orderkey", 500, 5).select("o_orderkey", "o_totalprice")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r <= greatest(1, floor(0.1 * n)) THEN 'test' WHEN r <= greatest(1, floor(0.1 * n)) + greatest(1, floor(0.2 * n)) THEN 'val' ELSE 'train' END AS part FROM r""")
def permutation_split(spark, sf):
    return sampling.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.1, 0.2, 3)


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents), b AS (SELECT lang, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) AS i FROM documents)
SELECT doc_id, lang FROM a JOIN b USING (i)""")
def label_permutation(spark, sf):
    return sampling.permuted(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 9)


@query(f"""WITH {EDGES}, o AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM e WHERE u <> v), n AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS m FROM supplier),
k AS (SELECT unnest(range(0, 400000)) AS k, (SELECT max(m) FROM n) AS m),
d AS (SELECT k, ('0x' || substr(md5('7u:' || k), 1, 8))::BIGINT % m AS i, ('0x' || substr(md5('7v:' || k), 1, 8))::BIGINT % m AS j FROM k),
p AS (SELECT k, least(x.id, y.id) AS u, greatest(x.id, y.id) AS v FROM d JOIN n x ON x.i = d.i JOIN n y ON y.i = d.j WHERE x.id <> y.id)
SELECT u, v FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.u = p.u AND o.v = p.v) ORDER BY k LIMIT 200""")
def negative_edges(spark, sf):
    from pyspark.sql import Window as W

    from ..operators import graph

    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.row_number().over(W.orderBy("s_suppkey")) - 1).cast("long").alias("i"))
    return sampling.negative_edges(nodes, graph.canonical(edges(spark, sf)), 200, 7)


@query("""WITH RECURSIVE d AS (SELECT s_nationkey % 5 AS cluster, p_brand AS term, -count(*) AS rank FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
t AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY rank, term) AS i FROM d QUALIFY i <= 10),
e AS (SELECT p_brand AS term, list(DISTINCT p_type || p_size) AS x FROM part GROUP BY 1),
m AS (SELECT a.term, list(b.term) AS alike FROM e a JOIN e b ON a.term <> b.term
  AND (len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) >= 0.3 OR len(list_intersect(a.x, b.x)) / least(len(a.x), len(b.x)) >= 0.5) GROUP BY 1),
r(cluster, i, kept, term, like_) AS (SELECT cluster, 1::BIGINT, [term], term, NULL::VARCHAR FROM t WHERE i = 1
UNION ALL SELECT cluster, i, CASE WHEN hit IS NULL THEN list_append(kept, term) ELSE kept END, term, hit FROM (
  SELECT r.cluster, t.i, r.kept, t.term, list_filter(r.kept, lambda k: list_contains(coalesce(m.alike, []), k))[1] AS hit FROM r JOIN t ON t.cluster = r.cluster AND t.i = r.i + 1 LEFT JOIN m ON m.term = t.term))
SELECT cluster, term, coalesce(like_, term) AS kept_as, like_ IS NOT NULL AS is_redundant FROM r""")
def redundancy_collapse(spark, sf):
    """Brands as terms, ranked by size within a region's suppliers, with the parts' types as elements."""
    d = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    terms = d.groupBy((F.col("s_nationkey") % 5).alias("cluster"), F.col("p_brand").alias("term")).agg((-F.count(F.lit(1))).alias("rank"))
    elements = table(spark, sf, "part").select(F.col("p_brand").alias("term"), F.concat("p_type", F.col("p_size").cast("string")).alias("element")).distinct()
    return enrichment.redundancy(ranking.top_per_group(terms, ["cluster"], [F.asc("rank"), F.asc("term")], 10), elements, ["cluster"], jaccard=0.3, overlap=0.5)
