"""Set overlap, filters, joins, set operations, scalar functions, aggregates and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import numbers as N, text as T
from ..operators import features, graph, ranking, setsim
from ..schema import table
from . import kg
from .registry import query, rounded

MEMBERS = "m AS (SELECT DISTINCT l_suppkey AS gs_id, l_partkey AS gene FROM lineitem)"


def members(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("gs_id"), F.col("l_partkey").alias("gene")).dropDuplicates()


def edges(spark, sf) -> DataFrame:
    """Suppliers joined by an order: a multigraph with repeated pairs of both orientations."""
    d = table(spark, sf, "lineitem")
    x = d.select("l_orderkey", F.col("l_suppkey").alias("u"), F.col("l_quantity").alias("w"))
    y = d.select("l_orderkey", F.col("l_suppkey").alias("v"), F.col("l_linenumber").alias("k"))
    return x.withColumn("n", F.lit(1)).join(y.filter("k = 1"), "l_orderkey").select("u", "v", "w")


def every_edge(spark, sf) -> DataFrame:
    """Suppliers joined by an order, each with each: rows of both orientations, w the quantity of u."""
    d = table(spark, sf, "lineitem")
    x = d.select("l_orderkey", F.col("l_suppkey").alias("u"), F.col("l_quantity").alias("w"))
    return x.join(d.select("l_orderkey", F.col("l_suppkey").alias("v")), "l_orderkey").select("u", "v", "w")


EDGES = """e AS (SELECT x.l_suppkey AS u, y.l_suppkey AS v, x.l_quantity AS w FROM lineitem x
                 JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE y.l_linenumber = 1)"""
EVERY_EDGE = "e AS (SELECT x.l_suppkey AS u, y.l_suppkey AS v, x.l_quantity AS w FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey)"
CANON = "c AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM e WHERE u <> v GROUP BY ALL)"


@query(f"""WITH {MEMBERS}, n AS (SELECT gs_id, count(*) AS n FROM m GROUP BY 1), u AS (SELECT count(DISTINCT gene) AS universe FROM m),
o AS (SELECT x.gs_id AS a, y.gs_id AS b, count(*) AS olap FROM m x JOIN m y ON x.gene = y.gene AND x.gs_id < y.gs_id GROUP BY ALL)
SELECT a, b, olap, p.n AS n1, q.n AS n2, universe, round(olap / (p.n + q.n - olap), 6) AS jaccard, round(olap / least(p.n, q.n), 6) AS simpson,
       round(0.8 * (olap / (p.n + q.n - olap)) + 0.2 * (olap / least(p.n, q.n)), 6) AS similarity
FROM o JOIN n p ON p.gs_id = a JOIN n q ON q.gs_id = b, u WHERE universe * olap > p.n * q.n""")
def set_overlap_pairs(spark, sf):
    return rounded(setsim.overlap_graph(members(spark, sf), statistics=False)).select("a", "b", "olap", "n1", "n2", "universe", "jaccard", "simpson", "similarity")


@query(f"""WITH {MEMBERS}, c AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier)
SELECT a, b, count(y.gs_id) AS olap FROM c LEFT JOIN m x ON x.gs_id = a LEFT JOIN m y ON y.gs_id = b AND y.gene = x.gene GROUP BY ALL""")
def candidate_pair_overlap(spark, sf):
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return setsim.candidate_overlaps(c, members(spark, sf))


@query(f"WITH {MEMBERS} SELECT gs_id, count(*) AS n FROM m GROUP BY 1")
def membership_sizes(spark, sf):
    return setsim.sizes(members(spark, sf))


@query("SELECT count(DISTINCT l_partkey) AS universe, count(DISTINCT l_suppkey) AS sets, count(*) AS n_rows FROM lineitem")
def universe_size(spark, sf):
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_partkey").alias("universe"), F.countDistinct("l_suppkey").alias("sets"), F.count(F.lit(1)).alias("n_rows"))


@query("""WITH v AS (SELECT DISTINCT o_custkey AS k, l_partkey AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')
SELECT p.k AS a, q.k AS b, count(*) AS n_shared, string_agg(p.x::VARCHAR, ';' ORDER BY p.x) AS shared FROM v p JOIN v q ON p.x = q.x AND p.k < q.k GROUP BY ALL""")
def shared_value_pairs(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "lineitem").filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = setsim.shared_value_pairs(d.select("o_custkey", "l_partkey"), "o_custkey", "l_partkey")
    return pairs.select("a", "b", "n_shared", F.array_join(F.col("values").cast("array<string>"), ";").alias("shared"))


@query("""WITH t AS (SELECT o_custkey AS k, l_partkey AS x, min(l_discount) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
s AS (SELECT * FROM t WHERE p <= 0.02), n AS (SELECT count(DISTINCT k) AS n FROM s),
h AS (SELECT x FROM s, n GROUP BY x, n HAVING count(DISTINCT k) <= floor(0.8 * n)),
r AS (SELECT * FROM s WHERE x IN (SELECT x FROM h))
SELECT a.k AS a, b.k AS b, count(*) AS n_shared, round(least(min(least(a.p, b.p)), 1.0), 6) AS min_pval FROM r a JOIN r b ON a.x = b.x AND a.k < b.k GROUP BY ALL""")
def shared_term_pairs_minp(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    terms = d.groupBy("o_custkey", "l_partkey").agg(F.min("l_discount").alias("p"))
    return rounded(kg.shared_terms(terms, "o_custkey", "l_partkey", "p", "tf", cutoff=0.02).select("a", "b", "n_shared", "min_pval"))


@query("""SELECT c_custkey, c_name FROM customer WHERE trim(coalesce(c_mktsegment, '')) = 'BUILDING'""")
def equality_filter(spark, sf):
    return table(spark, sf, "customer").filter(T.to_text(F.col("c_mktsegment")) == "BUILDING").select("c_custkey", "c_name")


@query(f"""WITH {EDGES} SELECT u, v, count(*) AS n, sum(w) AS w FROM e WHERE u <> v
AND u IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND v IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL""")
def endpoint_filter(spark, sf):
    nodes = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    d = graph.with_endpoints(edges(spark, sf).filter("u <> v"), nodes)
    return d.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query(f"WITH {EDGES}, {CANON} SELECT u, v, w FROM c")
def canonical_edges_max(spark, sf):
    return graph.canonical(edges(spark, sf))


@query(f"""WITH {EDGES}, {CANON} SELECT u, v, w FROM c UNION ALL SELECT v, u, w FROM c UNION ALL SELECT s_suppkey, s_suppkey, 1.0 FROM supplier""")
def symmetric_doubling(spark, sf):
    return graph.doubled(graph.canonical(edges(spark, sf)), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@query("""SELECT l_partkey AS value, count(DISTINCT l_suppkey) AS support FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 25""")
def min_support(spark, sf):
    d = setsim.min_support(members(spark, sf), "gene", 25, "gs_id")
    return d.groupBy(F.col("gene").alias("value")).agg(F.countDistinct("gs_id").alias("support"))


@query("""WITH v AS (SELECT DISTINCT l_suppkey AS k, l_shipdate::DATE AS x FROM lineitem), n AS (SELECT count(DISTINCT k) AS n FROM v)
SELECT strftime(x, '%Y-%m-%d') AS day, count(*) AS n FROM v, n GROUP BY x, n.n HAVING count(*) <= floor(0.2 * n.n)""")
def prevalence_ceiling(spark, sf):
    d = table(spark, sf, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).dropDuplicates()
    return setsim.prevalence_limited(d, "l_suppkey", "day", 0.2).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT l_suppkey AS gs_id, count(DISTINCT l_partkey) AS m FROM lineitem GROUP BY 1) SELECT gs_id, m FROM n WHERE m >= 100 AND m <= 520""")
def size_band(spark, sf):
    return setsim.sizes(members(spark, sf)).filter("n >= 100 and n <= 520").select("gs_id", F.col("n").alias("m"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS p FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) <= 5""")
def significance_filter(spark, sf):
    p = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf, "events").select("event_id", p.alias("p")).filter("p <= 5")


@query("SELECT p_partkey, p_name FROM part WHERE p_name <> '' AND NOT starts_with(p_brand, 'Brand#1') AND NOT starts_with(p_brand, 'Brand#2')")
def prefix_reject(spark, sf):
    b = F.col("p_brand")
    return table(spark, sf, "part").filter((F.col("p_name") != "") & ~b.startswith("Brand#1") & ~b.startswith("Brand#2")).select("p_partkey", "p_name")


@query("""SELECT doc_id, coalesce(regexp_matches(text, '(?i)license|copyright'), false) AS legal, coalesce(contains(lower(text), 'the '), false) AS has_the FROM documents""")
def containment(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(t.rlike("(?i)license|copyright"), F.lit(False)).alias("legal"), F.coalesce(F.lower(t).contains("the "), F.lit(False)).alias("has_the"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1""")
def whitelist_finite(spark, sf):
    d = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view", "purchase") & F.col("value").isNotNull() & ~F.isnan("value"))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS dir_up, (CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::DOUBLE AS dir_dn,
(CASE WHEN o_orderstatus IN ('F', 'O') THEN 0 ELSE 1 END)::DOUBLE AS dir_other, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS badge FROM orders""")
def case_flags(spark, sf):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    direction = F.when(status == "F", "up").when(status == "O", "dn").otherwise("?")
    badge = F.when(price > 300000, "large").when(price > 100000, "medium").otherwise("small")
    return table(spark, sf, "orders").select("o_orderkey", *features.direction_flags(direction), badge.alias("badge"))


@query("""SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1""")
def semi_ids(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_ids(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "n_chars")


@query("""SELECT doc_id, vec_id IS NULL AS missing, round(coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 0), 4) AS sq
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def left_zero_fill(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    d = features.zero_filled(ids, table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 64)
    sq = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return d.select(F.col("id").alias("doc_id"), "missing", F.round(sq, 4).alias("sq"))


@query("""SELECT d.doc_id, d.lang, l.quality, e.label FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id""")
def three_way_inner(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("v"))
    b = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("v"))
    d = features.aligned(a, b).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id")
    return d.select(F.col("id").alias("doc_id"), F.col("a").alias("lang"), "quality", F.col("b").alias("label"))


@query("""SELECT p_partkey, coalesce(max(l_discount), -1.0) AS best, coalesce(count(l_orderkey), 0) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def lookup_defaults(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_discount").alias("best"), F.count(F.lit(1)).alias("n"))
    j = table(spark, sf, "part").join(d, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.select("p_partkey", F.coalesce("best", F.lit(-1.0)).alias("best"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS region FROM a FULL JOIN b ON a.id = b.id""")
def region_split(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    return kg.regions(o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderstatus = 'F'"))


@query("""SELECT s_suppkey AS a, n_nationkey::BIGINT AS b, 'nation' AS edge_type, NULL::DOUBLE AS weight, 1::BIGINT AS n_shared FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT l_suppkey, l_partkey, 'gene_overlap', max(l_quantity), NULL FROM lineitem GROUP BY ALL""")
def hetero_union(spark, sf):
    x = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    x = kg.relation(x.select(F.col("s_suppkey").alias("a"), F.col("n_nationkey").cast("long").alias("b"), F.lit(1).alias("n_shared")), "nation")
    y = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.max("l_quantity").alias("weight"))
    return x.unionByName(kg.relation(y, "gene_overlap"), allowMissingColumns=True).select("a", "b", "edge_type", "weight", "n_shared")


@query(f"""WITH {EDGES}, t AS (SELECT u AS a, v AS b, w AS weight, CASE WHEN w > 25 THEN 'mesh' ELSE 'pubmed' END AS edge_type FROM e WHERE u <> v),
r AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b), edge_type ORDER BY weight DESC, a) AS k FROM t) SELECT a, b, edge_type, weight FROM r WHERE k = 1""")
def edge_dedup(spark, sf):
    e = edges(spark, sf).filter("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("weight"), F.when(F.col("w") > 25, "mesh").otherwise("pubmed").alias("edge_type"))
    return kg.first_edges(e, [F.desc("weight"), F.asc("a")]).select("a", "b", "edge_type", "weight")


@query("""WITH v AS (SELECT o_custkey AS k, concat_ws(';', o_orderpriority, ' ' || o_orderstatus || ' ', '', o_orderstatus) AS x FROM orders)
SELECT k, x AS raw, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(x, ';'), lambda y: trim(y)), lambda y: y <> ''))), '|') AS parts FROM v""")
def split_semicolon(spark, sf):
    x = F.concat_ws(";", "o_orderpriority", F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")), F.lit(""), "o_orderstatus")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), x.alias("raw"), T.pipe_joined(F.array_sort(T.split_values(x))).alias("parts"))


@query("""WITH v AS (SELECT o_orderkey, o_orderpriority || '; ' || o_orderstatus || ',' || o_custkey::VARCHAR AS x FROM orders),
p AS (SELECT o_orderkey, list_filter(regexp_split_to_array(x, '[;|,\\s]+'), lambda y: y <> '') AS l FROM v)
SELECT o_orderkey, l[1] AS primary_value, len(list_distinct(l))::BIGINT AS n FROM p""")
def split_any(spark, sf):
    x = F.concat("o_orderpriority", F.lit("; "), "o_orderstatus", F.lit(","), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", T.primary_value(x).alias("primary_value"), F.size(T.split_any(x)).cast("long").alias("n"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(replace(replace(regexp_replace('GSE12' || p_partkey || ' ' || p_type || '_x-9', '(?i)GSE[0-9]+', ' ', 'g'), '_', ' '), '-', ' '), '[0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS cleaned,
p_name || ' ' || p_brand AS joined FROM part""")
def clean_text(spark, sf):
    x = F.concat(F.lit("GSE12"), F.col("p_partkey").cast("string"), F.lit(" "), "p_type", F.lit("_x-9"))
    return table(spark, sf, "part").select("p_partkey", T.clean_text(x).alias("cleaned"), T.concat_nonempty(F.col("p_name"), F.lit(" nan "), F.col("p_brand")).alias("joined"))


@query("""WITH y AS (SELECT o_orderkey, year(o_orderdate) AS y, o_custkey % 3 AS k FROM orders)
SELECT o_orderkey, round(CASE k WHEN 0 THEN y ELSE CASE k WHEN 1 THEN (y + 2001) / 2 END END, 6)::DOUBLE AS year,
round(coalesce((CASE k WHEN 0 THEN y WHEN 1 THEN (y + 2001) / 2 END - 1990) / 40, 0), 6)::DOUBLE AS scaled FROM y""")
def parse_year(spark, sf):
    y = F.year("o_orderdate").cast("string")
    x = F.when(F.col("o_custkey") % 3 == 0, y).when(F.col("o_custkey") % 3 == 1, F.concat(y, F.lit("|2001;199x"))).otherwise("unknown")
    year = T.parse_year(x)
    return rounded(table(spark, sf, "orders").select("o_orderkey", year.alias("year"), N.scaled_year(year).alias("scaled")))


@query("""SELECT event_id, round(coalesce(value, 0), 6) AS v, round(ln(1 + greatest(coalesce(value, 0), 0)), 6) AS log_w, round(sqrt(greatest(coalesce(value, 0), 0)), 6) AS sqrt_w,
round(1 / (1 + exp(-coalesce(value, 0) / 100)), 6) AS sig, least(40.0, greatest(12.0, 12 + 0.4 * round(coalesce(value, 0)))) AS width FROM events""")
def weights(spark, sf):
    v = T.safe_float(F.col("value"))
    d = table(spark, sf, "events").select(
        "event_id", v.alias("v"), N.weight(v).alias("log_w"), N.weight(v, "sqrt").alias("sqrt_w"), N.sigmoid(v / 100).alias("sig"), N.clamped(12 + 0.4 * F.round(v), 12.0, 40.0).alias("width")
    )
    return rounded(d)


@query("""SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS short,
replace(replace(replace(replace(substr(text, 1, 40), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe, regexp_replace(source || ' (GO:0001)', '\\s*\\(GO:[0-9]+\\)\\s*$', '') AS term FROM documents""")
def presentation_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.truncated(t, 300).alias("short"), T.html_escaped(F.substring(t, 1, 40)).alias("safe"), T.strip_term_suffix(F.concat("source", F.lit(" (GO:0001)"))).alias("term")
    )


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n1 FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n2 FROM supplier GROUP BY 1)
SELECT k, n1, coalesce(n2, 0)::BIGINT AS n2, coalesce(n2, 0)::BIGINT - n1 AS delta, round(coalesce(n2, 0) / n1, 6) AS ratio, round(100 * coalesce(n2, 0) / greatest(n1, coalesce(n2, 0)), 1) AS pct FROM a LEFT JOIN b USING (k)""")
def delta_ratio(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n1"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n2"))
    d = a.join(b, "k", "left").withColumn("n2", F.coalesce("n2", F.lit(0)).cast("long"))
    return rounded(d.select("k", "n1", "n2", (F.col("n2") - F.col("n1")).alias("delta"), N.guarded(F.col("n2"), F.col("n1")).alias("ratio"), N.overlap_pct(F.col("n2"), F.col("n1"), F.col("n2")).alias("pct")))


@query("""SELECT l_returnflag AS k, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, round(stddev_pop(l_extendedprice), 4) AS sd_pop,
min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem GROUP BY 1""")
def metric_summary(spark, sf):
    x = F.col("l_extendedprice")
    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k"))
    return rounded(d.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.stddev_pop(x).alias("sd_pop"), F.min(x).alias("low"), F.max(x).alias("high"), F.countDistinct("l_suppkey").alias("n_distinct")), 4)


@query("""SELECT l_shipmode AS k, round(quantile_cont(l_quantity, 0.05), 6) AS p05, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(median(l_quantity), 6) AS p50, round(quantile_cont(l_quantity, 0.95), 6) AS p95
FROM (SELECT l_linestatus AS l_shipmode, l_quantity FROM lineitem) GROUP BY 1""")
def percentiles(spark, sf):
    q = F.col("l_quantity")
    d = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("k"))
    return rounded(d.agg(F.percentile(q, 0.05).alias("p05"), F.percentile(q, 0.25).alias("p25"), F.median(q).alias("p50"), F.percentile(q, 0.95).alias("p95")))


@query("""WITH c AS (SELECT n_name, p_type, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT n_name, p_type, n FROM c QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY n DESC, p_type) <= 3""")
def top_terms(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    d = d.join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return ranking.top_per_group(d.groupBy("n_name", "p_type").agg(F.count(F.lit(1)).alias("n")), ["n_name"], [F.desc("n"), F.asc("p_type")], 3)


@query("""WITH c AS (SELECT e.label, d.lang, count(*) AS c FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY ALL)
SELECT label, arg_min(lang, (-c, lang)) AS lang, max(c) AS n_top, sum(c)::BIGINT AS n, round(max(c) / sum(c), 6) AS share FROM c GROUP BY 1""")
def purity(spark, sf):
    from ..operators import clustering

    d = table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("doc_id") == F.col("vec_id"))
    return rounded(clustering.majority(d, "label", "lang"))


@query("""WITH c AS (SELECT d.source, e.label, count(*) AS c FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY ALL)
SELECT source, label FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, label) = 1""")
def majority_map(spark, sf):
    d = table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("doc_id") == F.col("vec_id"))
    c = d.groupBy("source", "label").agg(F.count(F.lit(1)).alias("c"))
    return ranking.top_per_group(c, ["source"], [F.desc("c"), F.asc("label")]).select("source", "label")


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n, l_suppkey) AS i FROM c)
SELECT round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini, round(max(n) / sum(n), 6) AS largest, round(min(n) / sum(n), 6) AS smallest FROM r""")
def size_gini(spark, sf):
    return rounded(ranking.gini(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))))


@query("""SELECT user_id % 10 AS seed, event_id % 50 AS epoch, round(arg_max(value, (value, -event_id)), 6) AS best, arg_max(event_id, (value, -event_id)) AS event_id
FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def best_epoch(spark, sf):
    d = table(spark, sf, "events").filter("value is not null").groupBy((F.col("user_id") % 10).alias("seed"), (F.col("event_id") % 50).alias("epoch"))
    order = F.struct(F.col("value"), -F.col("event_id"))
    return rounded(d.agg(F.max_by("value", order).alias("best"), F.max_by("event_id", order).alias("event_id")))


@query("""SELECT event_id % 20 AS epoch, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, bool_and(value IS NOT NULL) AS all_valid, count(value) AS n FROM events GROUP BY 1""")
def curve_by_epoch(spark, sf):
    d = table(spark, sf, "events").groupBy((F.col("event_id") % 20).alias("epoch"))
    v = F.col("value")
    return rounded(d.agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.bool_and(v.isNotNull()).alias("all_valid"), F.count(v).alias("n")))


@query("""SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS types, count(*) AS n FROM part GROUP BY 1""")
def distinct_lists(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(T.pipe_joined(F.array_sort(F.collect_set("p_type"))).alias("types"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 20 AS batch FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""")
def top_orders_in_batches(spark, sf):
    d = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_totalprice")
    rank = F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return d.withColumn("batch", F.floor((rank - 1) / 20).cast("long"))


@query("""SELECT n_regionkey, n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)""")
def region_rollup(spark, sf):
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(d.rollup("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("balance")), 4)
