"""Scans of the other source formats, lists and labels, and the frames behind reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N, text as T, vectors as V
from ..operators import compare, evaluation, features
from ..schema import table
from ..sources import readers, sinks
from . import kg, study
from .registry import query, rounded
from .run_queries import WIDE, wide
from .source_queries import scratch
from .vector_queries import HALVES, VEC, halves, vectors


@query("SELECT p_partkey::VARCHAR AS goid, p_name AS description FROM part")
def description_scan(spark, sf):
    path = scratch(spark)
    table(spark, sf, "part").select(F.col("p_partkey").alias("GOID"), F.col("p_brand").alias("OTHER"), F.col("p_name").alias("DESCRIPTION")).write.csv(path, sep="\t", header=True)
    return readers.descriptions(spark, path)


@query("SELECT s_suppkey::VARCHAR AS id FROM supplier")
def id_list_scan(spark, sf):
    path = scratch(spark)
    ids = table(spark, sf, "supplier").select(F.explode(F.array(F.format_string(" %d ", "s_suppkey"), F.lit(""), F.lit("  "))).alias("value"))
    ids.write.text(path)
    return readers.id_list(spark, path)


@query("SELECT s_suppkey::VARCHAR AS a, (s_suppkey + 1)::VARCHAR AS b FROM supplier WHERE s_suppkey % 10 <> 0")
def candidate_pair_scan(spark, sf):
    path, s = scratch(spark), F.col("s_suppkey")
    table(spark, sf, "supplier").select(s.cast("string").alias("GS_ID_A"), F.when(s % 10 == 0, " ").otherwise((s + 1).cast("string")).alias("gs_id_b")).write.csv(path, header=True)
    return readers.candidate_pairs(spark, path)


@query("SELECT p_partkey::VARCHAR AS gs_id, p_name AS name, p_size::BIGINT AS gs_size, NULL::VARCHAR AS organism FROM part")
def metadata_scan(spark, sf):
    path = scratch(spark)
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("ID"), F.col("p_name").alias("NAME"), F.col("p_size").alias("GS_SIZE"))
    d.unionByName(d).write.csv(path, header=True)
    return readers.metadata(spark, path).select("gs_id", "name", "gs_size", "organism")


@query("SELECT n_regionkey::VARCHAR AS cluster, n_nationkey::VARCHAR AS gs_id, n_name AS gene FROM nation")
def cluster_gene_scan(spark, sf):
    path = scratch(spark)
    sets = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("gs_id"), F.array("n_name").alias("genes"))).alias("sets"))
    one = sets.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_regionkey").cast("string"), "sets"))).alias("clusters"))
    one.select(F.to_json(F.struct("clusters")).alias("value")).coalesce(1).write.text(path)
    return readers.cluster_genes(spark, path).filter("cluster is not null")


@query(f"WITH {VEC} SELECT id::VARCHAR AS id, len(v)::BIGINT AS dim, round(list_sum(list_transform(v, lambda x, i: x * i)), 3) + 0.0 AS total FROM x")
def npz_scan(spark, sf):
    path = scratch(spark) + ".npz"
    sinks.npz(table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding"), path)
    d = readers.npz_embeddings(spark, path)
    total = F.aggregate(F.transform(V.doubles(F.col("embedding")), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return d.select("id", F.size("embedding").cast("long").alias("dim"), (F.round(total, 3) + 0.0).alias("total"))


@query(f"WITH {VEC} SELECT id::VARCHAR AS id, 4::BIGINT AS dim, round(v[1] + v[2] + v[3] + v[4], 4) + 0.0 AS total FROM x")
def word_vector_scan(spark, sf):
    path = scratch(spark)
    line = F.concat_ws(" ", F.col("vec_id").cast("string"), F.slice("embedding", 1, 4).cast("array<string>"))
    table(spark, sf, "embeddings").select(line.alias("value")).unionByName(spark.createDataFrame([("9 4",)], "value string")).write.text(path)
    d = readers.vectors_of(readers.word_vectors(spark, path), table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id")))
    total = F.aggregate(V.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return d.select("id", F.size("embedding").cast("long").alias("dim"), (F.round(total, 4) + 0.0).alias("total"))


@query("SELECT n_nationkey::VARCHAR AS u, 'r' || n_regionkey AS v FROM nation")
def graphml_scan(spark, sf):
    n, path = table(spark, sf, "nation"), scratch(spark)
    nodes = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    edges = n.select(F.col("n_nationkey").cast("string").alias("u"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("v"), F.lit("in").alias("kind"))
    spark.createDataFrame([(sinks.graphml(nodes, edges),)], "value string").write.text(path)
    return readers.graphml(spark, path)[1].select("u", "v")


@query("""WITH p AS (SELECT o_orderkey, string_split(replace(o_custkey || '; ' || o_orderkey || ',,' || o_custkey, ';', ','), ',') AS l, o_custkey AS a, o_orderkey AS b FROM orders),
q AS (SELECT o_orderkey, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') AS l, a, b FROM p)
SELECT o_orderkey, CASE WHEN l[1] = l[2] THEN l[1] ELSE l[1] || '|' || l[2] END AS pmids, l[1] AS first, least(a, b) * 1000000 + greatest(a, b) AS pair FROM q""")
def parsed_lists(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    x = F.concat(c.cast("string"), F.lit("; "), o.cast("string"), F.lit(",,"), c.cast("string"))
    found = T.parse_pmids(x)
    return table(spark, sf, "orders").select("o_orderkey", T.pipe_joined(found).alias("pmids"), T.pipe_joined(T.first_of(found, 1)).alias("first"), N.pair_key(c, o, 1_000_000).alias("pair"))


@query("""WITH p AS (SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey)
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey WHERE l.l_suppkey = p.a AND m.l_suppkey = p.b)""")
def new_pairs(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    o = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), "l_orderkey")
    return kg.only_new(kg.shared_values(s, "id", "s_nationkey", "mesh"), kg.shared_values(o, "id", "l_orderkey", "pubmed")).select("a", "b")


@query(f"WITH {WIDE} SELECT run::VARCHAR AS run FROM w WHERE run NOT IN (1, 2, 3) AND a IS NOT NULL ORDER BY round(a, 9) DESC, run::VARCHAR LIMIT 1")
def best_recipe(spark, sf):
    d = wide(spark, sf).select(F.col("run").cast("string").alias("run"), F.round("a", 9).alias("a"))
    return compare.best_recipe(d, "run", "a", "1", ("2", "3"))


@query("""WITH m AS (SELECT l_returnflag AS k, unnest(['density', 'cov_mesh', 'delta_ratio', 'size', 'none']) AS name, unnest([avg(l_discount), avg(l_tax), avg(l_quantity), avg(l_quantity), NULL]) AS v FROM lineitem GROUP BY 1)
SELECT k, name, CASE name WHEN 'density' THEN printf('%.4f', v) WHEN 'cov_mesh' THEN printf('%.3f', v) WHEN 'delta_ratio' THEN printf('%.2f', v) || chr(215) WHEN 'size' THEN printf('%.1f', v) ELSE chr(8212) END AS text FROM m""")
def formatted_metrics(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.avg("l_discount").alias("density"), F.avg("l_tax").alias("cov_mesh"), F.avg("l_quantity").alias("delta_ratio"), F.avg("l_quantity").alias("size"), F.lit(None).cast("double").alias("none"))
    names = ("density", "cov_mesh", "delta_ratio", "size", "none")
    long = d.select("k", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("m")).select("k", "m.name", "m.v")
    return long.select("k", "name", T.formatted(F.col("v"), F.col("name")).alias("text"))


@query(f"WITH {VEC} SELECT id, round(v[1], 6) AS x, round(v[2], 6) AS y, label, ['red', 'green', 'blue'][label % 3 + 1] AS colour FROM x")
def scatter_frame(spark, sf):
    return rounded(features.scatter(vectors(spark, sf), "label", ["red", "green", "blue"], point="v"))


@query("""SELECT 'documents' AS source, vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'labels', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def missing_ids(spark, sf):
    of = lambda name: table(spark, sf, name).select(F.col("doc_id").alias("id"))
    return features.missing_ids(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), {"documents": of("documents"), "labels": of("labels")})


@query(f"""WITH {VEC}, n AS (SELECT p.id, q.id AS other, round(-list_distance(p.v, q.v), 9) AS sim FROM x p JOIN x q ON p.id <> q.id)
SELECT id, other, round(sim, 5) AS sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other)::INT AS rk FROM n QUALIFY rk <= 3""")
def knn_euclidean(spark, sf):
    return evaluation.nearest(vectors(spark, sf), 3, metric="euclidean").select("id", "other", F.round("sim", 5).alias("sim"), "rk")


@query(f"""WITH {HALVES}, c AS (SELECT list_cosine_similarity(a, b) AS c FROM h)
SELECT count(*) AS n_common_ids, 32::BIGINT AS dim_used, round(avg(c), 6) AS row_cos_mean, round(stddev_pop(c), 6) AS row_cos_std, round(quantile_cont(c, 0.05), 6) AS row_cos_p05,
round(quantile_cont(c, 0.5), 6) AS row_cos_p50, round(quantile_cont(c, 0.95), 6) AS row_cos_p95 FROM c""")
def modality_summary(spark, sf):
    a, b = halves(spark, sf)
    c = V.cosine(F.col("a"), F.col("b"))
    d = features.aligned(a, b).select(c.alias("c"), F.size("a").cast("long").alias("d"))
    return rounded(
        d.agg(
            F.count(F.lit(1)).alias("n_common_ids"), F.max("d").alias("dim_used"), F.avg("c").alias("row_cos_mean"), F.stddev_pop("c").alias("row_cos_std"),
            F.percentile("c", 0.05).alias("row_cos_p05"), F.percentile("c", 0.5).alias("row_cos_p50"), F.percentile("c", 0.95).alias("row_cos_p95"),
        )
    )


PATHWAYS = """a AS (SELECT DISTINCT l_suppkey AS id, CASE WHEN l_partkey % 2 = 0 THEN 'path:' || l_partkey ELSE l_partkey::VARCHAR END AS term, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')"""


def _pathways(spark, sf):
    d = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    term = F.concat(F.when(F.col("l_partkey") % 2 == 0, "path:").otherwise(""), F.col("l_partkey").cast("string"))
    return d.select(F.col("l_suppkey").alias("gs_id"), term.alias("term"), F.col("p_name").alias("name")).distinct()


@query(f"""WITH {PATHWAYS}, d AS (SELECT x.id AS a, y.id AS b, x.term, x.name, CASE WHEN x.term LIKE 'path:%' THEN 'KEGG' ELSE 'Reactome' END AS src FROM a x JOIN a y ON x.term = y.term AND x.id < y.id)
SELECT a, b, edge_type, n_shared, shared, names, sources FROM (SELECT a, b, 'shared_pathway' AS edge_type, count(*) AS n_shared, string_agg(term, ';' ORDER BY term) AS shared,
array_to_string(list_sort(list(DISTINCT name)), ';') AS names, array_to_string(list_sort(list(DISTINCT src)), ';') AS sources FROM d GROUP BY ALL)""")
def shared_pathways(spark, sf):
    d = kg.pathways(_pathways(spark, sf))
    return d.select("a", "b", "edge_type", "n_shared", *[F.array_join(c, ";").alias(c) for c in ("shared", "names", "sources")])


def _mesh(spark, sf):
    d = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("gs_id")).agg(F.collect_list(F.concat(F.lit(" Heading "), F.col("l_partkey").cast("string"))).alias("m"))
    return d.select("gs_id", F.array_join("m", ";").alias("mesh_descriptors"))


@query(f"""WITH {PATHWAYS}, m AS (SELECT DISTINCT l_suppkey AS id, 'Heading ' || l_partkey AS term, 'Heading ' || l_partkey AS name FROM lineitem WHERE l_returnflag = 'A'),
e AS (SELECT 'shared_disease' AS edge_type, * FROM a UNION ALL SELECT 'shared_mesh_term', * FROM m)
SELECT x.edge_type, x.id AS a, y.id AS b, count(*) AS n_shared, array_to_string(list_sort(list(DISTINCT x.name)), ';') AS names FROM e x JOIN e y ON x.edge_type = y.edge_type AND x.term = y.term AND x.id < y.id GROUP BY ALL""")
def shared_diseases(spark, sf):
    meta = _mesh(spark, sf)
    d = kg.diseases(meta, _pathways(spark, sf)).unionByName(kg.diseases(meta))
    return d.select("edge_type", "a", "b", "n_shared", F.array_join("names", ";").alias("names"))


@query("""WITH o AS (SELECT DISTINCT l_suppkey AS id, l_orderkey::VARCHAR AS x, l_returnflag <> 'R' AS later FROM lineitem WHERE l_returnflag <> 'N'),
d AS (SELECT a.id AS a, b.id AS b, count(*) AS n, string_agg(a.x, ';' ORDER BY a.x) AS shared FROM o a JOIN o b ON a.x = b.x AND a.id < b.id WHERE NOT a.later AND NOT b.later GROUP BY ALL),
v AS (SELECT a.id AS a, b.id AS b, min(a.x) AS x FROM (SELECT DISTINCT id, x FROM o) a JOIN (SELECT DISTINCT id, x FROM o) b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT a, b, n AS n_shared, shared FROM d UNION ALL SELECT a, b, 1, x FROM v WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.a = v.a AND d.b = v.b)""")
def pubmed_costudy(spark, sf):
    """Orders as articles: those of returned lines are listed in the metadata, those of accepted ones are found by a later look-up."""
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("gs_id"), F.col("l_orderkey").cast("string").alias("pmid"), "l_returnflag")
    meta = d.filter("l_returnflag = 'R'").groupBy("gs_id").agg(F.array_join(F.collect_list("pmid"), "; ").alias("pmids"))
    edges = kg.costudy(meta, found=d.filter("l_returnflag = 'A'"))
    return edges.select("a", "b", "n_shared", F.array_join("shared", ";").alias("shared"))


@query(f"""WITH {WIDE}, d AS (SELECT w.run, round(0.6 * coalesce((w.a - b.a) / abs(b.a), 0) - 0.4 * coalesce((w.n - b.n) / abs(b.n), 0), 9) AS score,
CASE WHEN w.a IS NULL OR abs(w.a - b.a) > greatest(0.01, 0.03 * abs(b.a)) THEN 1 ELSE 0 END + CASE WHEN w.r IS NULL OR w.r - b.r > greatest(0.01, 0.03 * abs(b.r)) THEN 1 ELSE 0 END AS n_violations FROM w, (SELECT * FROM w WHERE run = 1) b)
SELECT run, round(score, 6) + 0.0 AS score, n_violations::INT AS n_violations, n_violations = 0 AS feasible, row_number() OVER (ORDER BY n_violations = 0 DESC, score DESC, run)::INT AS place FROM d""")
def grid_search(spark, sf):
    d = wide(spark, sf)
    out = compare.search(d, d.filter("run = 1"), "run", {"a": (0.6, True), "n": (0.4, False)}, {"a": False, "r": True})
    return out.select("run", (F.round("score", 6) + 0.0).alias("score"), "n_violations", "feasible", "place")


@query("""WITH r AS (SELECT l_linenumber AS k, l_suppkey AS seed, l_returnflag AS metric, round(avg(l_discount) * 100, 6) AS value FROM lineitem GROUP BY ALL), m AS (SELECT k, median(value) AS m FROM r WHERE metric = 'A' GROUP BY 1),
p AS (SELECT k, seed FROM r JOIN m USING (k) WHERE metric = 'A' QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(abs(value - m), 9), seed) = 1)
SELECT k, metric, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, max(p.seed) AS representative FROM r LEFT JOIN p USING (k) GROUP BY ALL""")
def seed_summary(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("seed"), F.col("l_returnflag").alias("metric")).agg(F.round(F.avg("l_discount") * 100, 6).alias("value"))
    return rounded(compare.over_seeds(runs, "A", ["k"]))


@query()
def cluster_sweep(spark, sf):
    return rounded(study.sweep(vectors(spark, sf), [4, 8], [11, 12, 13]), 4)
