"""Vectors, neighbours, cluster evaluation, projections, features and text weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import vectors as V
from ..operators import clustering, evaluation, features, graph, ranking, sampling
from ..schema import table
from .registry import query, rounded
from .relational_queries import edges


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"), "label")


#: The same in SQL: id, v (DOUBLE[]), label.
VEC = "x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@query(f"""WITH {VEC} SELECT id, round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 4) AS norm,
round(list_sum(list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z))))), 4) + 0.0 AS total FROM x""")
def l2_normalize(spark, sf):
    total = F.aggregate(V.l2_normalized(F.col("v")), F.lit(0.0), lambda s, x: s + x)
    return vectors(spark, sf).select("id", F.round(V.norm(F.col("v")), 4).alias("norm"), (F.round(total, 4) + 0.0).alias("total"))


@query(f"""WITH {VEC}, c AS (SELECT label, i, avg(v[i]) AS x FROM x, unnest(range(1, 65)) r(i) GROUP BY ALL), k AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM k a JOIN k b ON a.label < b.label ORDER BY cosine DESC, a, b LIMIT 20""")
def top_centroid_pairs(spark, sf):
    c = evaluation.centroids(vectors(spark, sf))
    x, y = c.alias("x"), c.alias("y")
    d = x.join(y, F.col("x.label") < F.col("y.label")).select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), F.round(V.cosine(F.col("x.centroid"), F.col("y.centroid")), 5).alias("cosine"))
    return d.orderBy(F.desc("cosine"), "a", "b").limit(20)


@query(f"""WITH {VEC}, n AS (SELECT p.id, q.id AS other, round(list_cosine_similarity(p.v, q.v), 9) AS sim FROM x p JOIN x q ON p.id <> q.id)
SELECT id, other, round(sim, 5) AS sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other)::INT AS rk FROM n QUALIFY rk <= 5""")
def knn(spark, sf):
    return evaluation.nearest(vectors(spark, sf), 5).select("id", "other", F.round("sim", 5).alias("sim"), "rk")


def halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two embeddings of the same ids: the first and the second half of each vector."""
    d = vectors(spark, sf)
    return d.select("id", F.slice("v", 1, 32).alias("v")), d.select("id", F.slice("v", 33, 32).alias("v"))


HALVES = f"{VEC}, h AS (SELECT id, v[1:32] AS a, v[33:64] AS b FROM x)"


@query(f"""WITH {HALVES}, p AS (SELECT p.id, q.id AS other, round(list_cosine_similarity(p.a, q.a), 9) AS sa, round(list_cosine_similarity(p.b, q.b), 9) AS sb FROM h p JOIN h q ON p.id <> q.id),
r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY sa DESC, other) AS ra, row_number() OVER (PARTITION BY id ORDER BY sb DESC, other) AS rb FROM p)
SELECT round(count(*) FILTER (ra <= 10 AND rb <= 10) / (10 * count(DISTINCT id)), 6) AS overlap, round(10 / (count(DISTINCT id) - 1), 6) AS random FROM r""")
def knn_overlap(spark, sf):
    a, b = halves(spark, sf)
    both = evaluation.nearest(a, 10).join(evaluation.nearest(b, 10).select("id", "other"), ["id", "other"]).agg(F.count(F.lit(1)).alias("hits"))
    n = a.agg(F.count(F.lit(1)).alias("n"))
    return rounded(both.crossJoin(n).select((F.col("hits") / (10 * F.col("n"))).alias("overlap"), (10 / (F.col("n") - 1)).alias("random")))  # one row each


@query(f"""WITH {HALVES}, p AS (SELECT round(list_cosine_similarity(p.a, q.a), 9) AS sa, round(list_cosine_similarity(p.b, q.b), 9) AS sb FROM h p JOIN h q ON p.id < q.id),
r AS (SELECT sa, sb, rank() OVER (ORDER BY sa) + (count(*) OVER (PARTITION BY sa) - 1) / 2 AS ra, rank() OVER (ORDER BY sb) + (count(*) OVER (PARTITION BY sb) - 1) / 2 AS rb FROM p)
SELECT round(corr(sa, sb), 5) AS pearson, round(corr(ra, rb), 5) AS spearman, (SELECT round(avg(list_cosine_similarity(a, b)), 5) FROM h) AS row_cosine FROM r""")
def spearman_pearson(spark, sf):
    a, b = halves(spark, sf)
    d = a.join(b.select("id", F.col("v").alias("w")), "id")
    rows = d.agg(F.avg(V.cosine(F.col("v"), F.col("w"))).alias("row_cosine"))
    p = evaluation.pair_cosines(d).select(F.round("sa", 9).alias("sa"), F.round("sb", 9).alias("sb")).persist()
    r = ranking.average_rank(ranking.average_rank(p, "sa", "ra"), "sb", "rb")
    return rounded(r.agg(F.corr("sa", "sb").alias("pearson"), F.corr("ra", "rb").alias("spearman")).crossJoin(rows), 5)  # one row each


def _silhouette_sql(dist: str) -> str:
    return f"""WITH {VEC}, d AS (SELECT p.id, p.label AS c, q.label AS o, avg({dist}) AS d FROM x p JOIN x q ON p.id <> q.id GROUP BY ALL),
s AS (SELECT id, c, min(d) FILTER (c = o) AS a, min(d) FILTER (c <> o) AS b FROM d GROUP BY ALL)
SELECT c AS label, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette, count(*) AS n FROM s GROUP BY 1"""


@query(_silhouette_sql("list_distance(p.v, q.v)"))
def silhouette_euc(spark, sf):
    return rounded(evaluation.silhouette(vectors(spark, sf)).groupBy("label").agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n")), 5)


@query(_silhouette_sql("1 - list_cosine_similarity(p.v, q.v)"))
def silhouette_cos(spark, sf):
    return rounded(evaluation.silhouette(vectors(spark, sf), metric="cosine").groupBy("label").agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n")), 5)


CENTRES = f"{VEC}, l AS (SELECT id, label, i, v[i] AS y FROM x, unnest(range(1, 65)) r(i)), c AS (SELECT label, i, avg(y) AS m, count(*) AS n FROM l GROUP BY ALL)"


@query(f"""WITH {CENTRES}, s AS (SELECT label, avg(d) AS s FROM (SELECT id, l.label, sqrt(sum((y - m) * (y - m))) AS d FROM l JOIN c USING (label, i) GROUP BY ALL) GROUP BY 1),
p AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL)
SELECT round(avg(w), 5) AS davies_bouldin FROM (SELECT p.a, max((x.s + y.s) / d) AS w FROM p JOIN s x ON x.label = p.a JOIN s y ON y.label = p.b GROUP BY 1)""")
def davies_bouldin(spark, sf):
    return rounded(evaluation.davies_bouldin(vectors(spark, sf)), 5)


@query(f"""WITH {CENTRES}, g AS (SELECT i, avg(y) AS g FROM l GROUP BY 1), b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM c JOIN g USING (i)),
w AS (SELECT sum((y - m) * (y - m)) AS w FROM l JOIN c USING (label, i)), k AS (SELECT count(DISTINCT label) AS k, count(DISTINCT id) AS n FROM x)
SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM b, w, k""")
def calinski_harabasz(spark, sf):
    return rounded(evaluation.calinski_harabasz(vectors(spark, sf)), 4)


@query("SELECT label, (vec_id % 8)::BIGINT AS other, count(*) AS n FROM embeddings GROUP BY ALL")
def contingency(spark, sf):
    return evaluation.contingency(table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 8).alias("other")), "label", "other")


@query("""WITH c AS (SELECT label AS a, vec_id % 8 AS b, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c),
ra AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1)), cb AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1))
SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM s, ra, cb""")
def ari(spark, sf):
    return rounded(evaluation.adjusted_rand(table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 8).alias("o")), "label", "o"))


@query("""WITH c AS (SELECT label AS a, vec_id % 8 AS b, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), ra AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), cb AS (SELECT b, sum(n) AS k FROM c GROUP BY 1)
SELECT round((SELECT sum(n / t * ln(n * t / (r * k))) FROM c JOIN ra USING (a) JOIN cb USING (b), t) / (((SELECT -sum(r / t * ln(r / t)) FROM ra, t) + (SELECT -sum(k / t * ln(k / t)) FROM cb, t)) / 2), 6) AS nmi""")
def nmi(spark, sf):
    return rounded(evaluation.normalized_mutual_information(table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 8).alias("o")), "label", "o"))


@query("""WITH l AS (SELECT vec_id AS id, s AS seed, ('0x' || substr(md5(s || ':' || vec_id % 40), 1, 6))::BIGINT % 5 AS c FROM embeddings, unnest([1, 2, 3, 4]) r(s)),
c AS (SELECT x.seed AS seed_a, y.seed AS seed_b, x.c AS a, y.c AS b, count(*) AS n FROM l x JOIN l y ON x.id = y.id AND x.seed < y.seed GROUP BY ALL),
s AS (SELECT seed_a, seed_b, sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c GROUP BY ALL),
ra AS (SELECT seed_a, seed_b, sum(n * (n - 1) / 2) AS sa FROM (SELECT seed_a, seed_b, a, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
cb AS (SELECT seed_a, seed_b, sum(n * (n - 1) / 2) AS sb FROM (SELECT seed_a, seed_b, b, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL)
SELECT seed_a, seed_b, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM s JOIN ra USING (seed_a, seed_b) JOIN cb USING (seed_a, seed_b)""")
def pairwise_ari(spark, sf):
    seeds = F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))
    d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), seeds.alias("seed"))
    d = d.withColumn("c", F.conv(F.substring(sampling.hash_key(F.col("seed"), F.col("id") % 40), 1, 6), 16, 10).cast("long") % 5)
    x, y = d.toDF("id", "seed_a", "a"), d.toDF("id", "seed_b", "b")
    return rounded(evaluation.adjusted_rand(x.join(y, "id").filter("seed_a < seed_b"), "a", "b", ["seed_a", "seed_b"]))


@query("""WITH s AS (SELECT vec_id % 10 AS y0, label, round(embedding[1]::DOUBLE, 3) AS score FROM embeddings), d AS (SELECT score, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS y FROM s),
g AS (SELECT score, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM d GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS a FROM g)
SELECT round(sum((n - p) * (tp - p / 2)) / (sum(p) * sum(n - p)), 6) AS auc, round(sum(p * tp / a) / sum(p), 6) AS ap FROM c""")
def pair_auc_ap(spark, sf):
    d = table(spark, sf, "embeddings").select(F.round(F.col("embedding")[0].cast("double"), 3).alias("score"), (F.col("label") % 2 == 0).cast("int").alias("y"))
    return rounded(evaluation.auc_ap(d, "score", "y"))


TFIDF = r"""w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda y: length(y) >= 2)) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1 HAVING count(*) >= 2),
raw AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)), len AS (SELECT id, sqrt(sum(w * w)) AS len FROM raw GROUP BY 1), t AS (SELECT id, term, w / len AS w FROM raw JOIN len USING (id))"""


def _documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))


@query(f"WITH {TFIDF} SELECT id, count(*) AS terms, round(max(w), 5) AS top, round(sum(w), 4) AS total FROM t GROUP BY 1")
def tfidf_weights(spark, sf):
    w = evaluation.tfidf(_documents(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.max("w").alias("top"), F.sum("w").alias("total"))
    return w.select("id", "terms", F.round("top", 5).alias("top"), F.round("total", 4).alias("total"))


@query(f"""WITH {TFIDF}, s AS (SELECT lang, term, sum(w) AS w FROM t JOIN documents d ON d.doc_id = t.id GROUP BY ALL)
SELECT round((SELECT sum(s) FROM (SELECT lang, sqrt(sum(w * w)) AS s FROM s GROUP BY 1)) / (SELECT count(*) FROM documents), 5) AS coherence""")
def text_coherence(spark, sf):
    d = _documents(spark, sf)
    return rounded(evaluation.coherence(evaluation.tfidf(d), d), 5)


@query(r"""WITH p AS (SELECT p_partkey AS id, p_brand AS label, lower(p_name || ' ' || p_type) AS t FROM part), n AS (SELECT count(*) AS n FROM p),
w AS (SELECT id, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda y: length(y) >= 2 AND y NOT IN ('of', 'the')) AS w, list_filter(regexp_split_to_array(t, '\s+'), lambda y: y <> '') AS c FROM p),
g AS (SELECT id, 'w' AS part, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w
  UNION ALL SELECT id, 'c', x[i:i + k - 1] FROM (SELECT id, ' ' || unnest(c) || ' ' AS x FROM w), (VALUES (3), (4), (5)) ks(k), unnest(range(1, greatest(1, length(x) - k + 1) + 1)) r(i) WHERE k = 3 OR length(x) >= k),
tf AS (SELECT id, part, term, count(*) AS tf FROM g GROUP BY ALL), idf AS (SELECT part, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY part, term, n HAVING count(*) >= 2),
raw AS (SELECT id, part, term, tf * idf AS w FROM tf JOIN idf USING (part, term)), len AS (SELECT id, part, sqrt(sum(w * w)) AS l FROM raw GROUP BY ALL), x AS (SELECT id, part || term AS term, w / l AS w FROM raw JOIN len USING (id, part)),
own AS (SELECT id, sqrt(sum(w * w)) AS l FROM x GROUP BY 1), c AS (SELECT label, term, sum(w) AS w FROM x JOIN p USING (id) GROUP BY ALL), cl AS (SELECT label, sqrt(sum(w * w)) AS l FROM c GROUP BY 1),
s AS (SELECT x.id, sum(x.w * c.w) / (max(own.l) * max(cl.l)) AS s FROM x JOIN p USING (id) JOIN c ON c.label = p.label AND c.term = x.term JOIN own ON own.id = x.id JOIN cl ON cl.label = p.label GROUP BY 1)
SELECT round(sum(s) / max(n), 5) AS coherence FROM s, n""")
def text_coherence_ngrams(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_brand").alias("label"))
    return rounded(evaluation.coherence(evaluation.ngram_tfidf(d, stop=["of", "the"]), d), 5)


def _weighed(v: str) -> str:
    """A checksum of a list in SQL: its entries times their places."""
    return f"round(list_sum(list_transform({v}, lambda x, i: x * i)), 4) + 0.0"


@query(f"""WITH {HALVES}, u AS (SELECT *, a[1:16] AS s, list_transform(b, lambda x: x / sqrt(list_sum(list_transform(b, lambda y: y * y)))) AS nb FROM h),
n AS (SELECT *, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS ns FROM u)
SELECT id, {_weighed("list_transform(range(1, 33), lambda i: 0.3 * a[i] + 0.7 * b[i])")} AS weighted, {_weighed("list_concat(list_transform(s, lambda x: 0.3 * x), list_transform(b, lambda x: 0.7 * x))")} AS concatenated,
{_weighed("b")} AS graph_base, {_weighed("s")} AS density_base, {_weighed("list_concat(list_transform(ns, lambda x: 0.3 * x), list_transform(nb, lambda x: 0.7 * x))")} AS both_normalized, {_weighed("nb")} AS graph_normalized FROM n""")
def merged_embeddings(spark, sf):
    a, b = halves(spark, sf)
    d = features.aligned(a, b)
    total = lambda v: F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4) + 0.0
    of = lambda name, *how: total(V.merged(F.col("a"), F.col("b"), *how)).alias(name)
    return d.select(
        "id", of("weighted", "weighted", 0.3), of("concatenated", "concatenate", 0.3, 16), of("graph_base", "graph_base", 0.3, 16), of("density_base", "density_base", 0.3, 16),
        of("both_normalized", "concatenate", 0.3, 16, "both"), of("graph_normalized", "graph_base", 0.3, 16, "emb2"),
    )


@query()
def kmeans_best(spark, sf):
    labels, seed = clustering.best_kmeans(vectors(spark, sf), 8, [11, 12, 13])
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.lit(seed).alias("seed"))


@query()
def agglomerative_clusters(spark, sf):
    return clustering.agglomerative(vectors(spark, sf), 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def kmedoids_clusters(spark, sf):
    return clustering.kmedoids(vectors(spark, sf), 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def pca_2d(spark, sf):
    d = clustering.pca(vectors(spark, sf), 2)
    return rounded(d.select("id", F.abs(F.col("p")[0]).alias("x"), F.abs(F.col("p")[1]).alias("y")))


@query()
def hungarian(spark, sf):
    d = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 10).cast("int").alias("other"))
    return clustering.matched(evaluation.contingency(d, "label", "other"), "label", "other")


@query("""WITH RECURSIVE c AS (SELECT label, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY ALL), l AS (SELECT label, row_number() OVER (ORDER BY label) AS i FROM c GROUP BY 1),
r(i, used, total) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT
UNION ALL SELECT i, used, max(total)::BIGINT FROM (SELECT l.i, r.used + x.bit AS used, r.total + coalesce(c.n, 0) AS total FROM r JOIN l ON l.i = r.i + 1,
  (SELECT b, (2 ** b)::BIGINT AS bit FROM range(0, 10) q(b)) x LEFT JOIN c ON c.label = l.label AND c.b = x.b WHERE (r.used // x.bit) % 2 = 0) GROUP BY ALL)
SELECT (SELECT count(*) FROM l) AS pairs, max(total) AS overlap FROM r WHERE i = (SELECT count(*) FROM l)""")
def matched_total(spark, sf):
    """What a matching is defined by: several may reach the same total."""
    d = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 10).cast("int").alias("other"))
    return clustering.matched(evaluation.contingency(d, "label", "other"), "label", "other").agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap").alias("overlap"))


@query()
def remapped_labels(spark, sf):
    d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 10).cast("int").alias("other"))
    m = clustering.matched(evaluation.contingency(d, "label", "other"), "label", "other")
    return clustering.relabelled(d, "other", m, "other", "label").groupBy("label", "other").agg(F.count(F.lit(1)).alias("n"))


def _blocks(spark, sf) -> dict[str, DataFrame]:
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    text = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), features.hashed_text_embedding(F.col("s_name"), 16).alias("v"))
    return {"text": text, "struct": features.structural_features(nodes, graph.canonical(edges(spark, sf)), "basic_plus")}


@query()
def feature_recipes(spark, sf):
    blocks = _blocks(spark, sf)
    made = [features.recipe(name, blocks, {"struct": 0.5}).withColumn("recipe", F.lit(name)) for name in ("text_only", "text_structlite", "shuffle_control", "random_control")]
    d = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    return rounded(d.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.avg(V.norm(F.col("v"))).alias("norm")), 4)


@query("""WITH m AS (SELECT ln(1 + greatest(o_totalprice, 0)) AS size, (o_orderstatus = 'F')::INT::DOUBLE AS up, (o_orderstatus <> 'F')::INT::DOUBLE AS dn, 0.0 AS other, (o_custkey % 2)::DOUBLE AS pubmed,
(year(o_orderdate) - 1990) / 40 AS year, 0.0 AS no_year, trim(c_mktsegment) AS organism FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT organism, row_number() OVER (ORDER BY count(*) DESC, organism) - 1 AS k FROM m WHERE organism <> '' GROUP BY 1 QUALIFY k < 8),
l AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i, unnest([size, up, dn, other, pubmed, year, no_year]) AS x FROM m UNION ALL SELECT 7 + k, (m.organism = t.organism)::INT::DOUBLE FROM m, t),
s AS (SELECT i, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM l GROUP BY 1)
SELECT i::INT AS i, n, round(avg((x - mean) / CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END), 4) + 0.0 AS mean, round(stddev_pop((x - mean) / CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END), 4) AS sd FROM l JOIN s USING (i) GROUP BY ALL""")
def metadata_features(spark, sf):
    c = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    meta = c.select(
        F.col("o_orderkey").alias("gs_id"), F.col("o_totalprice").alias("gs_size"), F.when(F.col("o_orderstatus") == "F", "up").otherwise("dn").alias("direction"),
        (F.col("o_custkey") % 2).alias("pubmed_present"), F.year("o_orderdate").cast("string").alias("pub_years"), F.col("c_mktsegment").alias("organism"),
    )
    d = features.metadata_features(meta)
    return rounded(d.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("x"), 4) + 0.0).alias("mean"), F.stddev_pop("x").alias("sd")), 4)


@query(f"""WITH {VEC}, b AS (SELECT id, floor((v[1] + 1) / 0.1)::BIGINT AS bin FROM x) SELECT bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY 1""")
def histogram(spark, sf):
    b = F.floor((F.col("v")[0] + 1) / 0.1)
    d = vectors(spark, sf).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(d.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())))


@query()
def method_study(spark, sf):
    from . import study

    a, b = halves(spark, sf)
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "id").join(a.select("id"), "id", "left_semi")
    return rounded(study.report({"first": a, "second": b}, d.select("id", "text"), d.select("id", F.col("lang").alias("value")), 4, [11, 12, 13]), 4)
