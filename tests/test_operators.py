"""Closed-form fixtures and invariants of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from setweave.functions import combinatorics as C, numbers as N, text as T, vectors as V
from setweave.operators import clustering, compare, enrichment, evaluation, features, graph, linkpred, ranking, sampling, setsim
from setweave.plans import kg

from .conftest import rows


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_worked_enrichment_example(spark):
    d = spark.createDataFrame([(27, 228, 37, 1643)], "a long, n long, g long, universe long")
    r = enrichment.tested(d).first()
    assert r["er"] == pytest.approx(5.26, abs=0.01)
    assert r["p"] == pytest.approx(1.68e-16, rel=0.01)


def test_log_factorial(spark):
    d = spark.range(0, 4000, 7).select("id", C.log_factorial(F.col("id")).alias("f")).collect()
    assert all(r["f"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-13, abs=1e-12) for r in d)


def test_hypergeometric_sums_to_one(spark):
    r = one(spark, p=C.cdf(F.lit(9).cast("long"), F.lit(50).cast("long"), F.lit(9).cast("long"), F.lit(20).cast("long")), s=C.survival(F.lit(0).cast("long"), F.lit(50).cast("long"), F.lit(9).cast("long"), F.lit(20).cast("long")))
    assert r["p"] == pytest.approx(1) and r["s"] == 1


def test_set_similarity(spark):
    d = spark.createDataFrame([("a", x) for x in (1, 2, 3)] + [("b", x) for x in (2, 3, 4, 5)] + [("c", 9)] * 2, "gs_id string, gene int")
    r = one(spark, j=N.jaccard(F.lit(2), F.lit(3), F.lit(4)), s=N.simpson(F.lit(2), F.lit(3), F.lit(4)), c=N.composite(F.lit(2), F.lit(3), F.lit(4)))
    assert (r["j"], round(r["s"], 6), round(r["c"], 6)) == (0.4, 0.666667, 0.453333)
    assert rows(setsim.overlaps(d.dropDuplicates())) == [("a", "b", 2)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "z")], "a string, b string")
    assert rows(setsim.candidate_overlaps(pairs, d.dropDuplicates())) == [("a", "b", 2), ("a", "c", 0), ("a", "z", 0)]


def test_benjamini_hochberg(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.02, 0.03, 0.04))], "i int, p double")
    assert [round(q, 9) for (q,) in rows(ranking.benjamini_hochberg(d), "q")] == [0.04] * 4


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=20))
def test_q_is_monotone_and_not_below_p(spark, ps):
    d = ranking.benjamini_hochberg(spark.createDataFrame([(p,) for p in ps], "p double")).orderBy("p").collect()
    q = [r["q"] for r in d]
    assert len(d) == len(ps) and q == sorted(q) and all(r["q"] >= r["p"] - 1e-12 for r in d)


def test_text_functions(spark):
    r = one(
        spark, a=T.to_text(F.lit(" NaN ")), b=T.split_values(F.lit(" x; y ;;x")), c=T.split_any(F.lit("Codon, Guide;z")), d=T.clean_text(F.lit("GSE123_Up-regulated 4")),
        e=T.parse_year(F.lit("1999|2001;x")), f=T.parse_year(F.lit("n/a")), g=T.strip_term_suffix(F.lit("cell cycle (GO:0007049)")), h=T.parse_pmids(F.lit("1;2, 1")),
        i=T.safe_float(F.lit("x"), 2.0), j=T.truncated(F.lit("abcdef"), 3), k=T.html_escaped(F.lit("<a&b>")), l=T.strip_quotes(F.lit('"GPL1"')), m=T.split_values(F.lit(None).cast("string")),
    )
    assert tuple(r) == ("", ["x", "y"], ["Codon", "Guide", "z"], "up regulated", 2000.0, None, "cell cycle", ["1", "2"], 2.0, "abc...", "&lt;a&amp;b&gt;", "GPL1", [])


def test_vectors(spark):
    a, b, z = (F.array(*map(F.lit, x)) for x in ((3.0, 4.0), (1.0, 0.0), (0.0, 0.0)))
    r = one(spark, n=V.norm(a), u=V.l2_normalized(a), z=V.l2_normalized(z), c=V.cosine(a, b), o=V.cosine(a, z), w=V.merged(a, b, "weighted", 0.5), k=V.merged(a, b, "concatenate", cut_dim=1))
    assert (r["n"], r["u"], r["z"], r["c"], r["o"], r["w"], r["k"]) == (5.0, [0.6, 0.8], [0.0, 0.0], 0.6, 0.0, [2.0, 2.0], [1.5, 0.5, 0.0])
    assert N.parse_range("2,10-50 step 10") == [2, 10, 20, 30, 40, 50]


def edge_frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "u long, v long, w double")


def node_frame(spark, n):
    return spark.range(n).select("id")


def test_triangle_and_star(spark):
    n, tri = node_frame(spark, 4), edge_frame(spark, [(0, 1), (0, 2), (1, 2)])
    assert rows(graph.triangle_counts(n, tri)) == [(0, 1), (1, 1), (2, 1), (3, 0)]
    assert rows(graph.clustering(n, tri)) == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0)]
    assert rows(graph.weighted_clustering(n, tri)) == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0)]
    assert rows(graph.connected_components(n, tri)) == [(0, 0), (1, 0), (2, 0), (3, 3)]
    assert rows(graph.core_numbers(n, tri)) == [(0, 2), (1, 2), (2, 2), (3, 0)]
    star = edge_frame(spark, [(0, i) for i in range(1, 5)])
    group = lambda d: d.withColumn("group_id", F.lit("g"))
    c = {r["id"]: r for r in graph.centrality(group(star), group(node_frame(spark, 5))).collect()}
    assert (c[0]["degree"], c[0]["betweenness"], c[0]["closeness"], c[1]["betweenness"]) == (1.0, 1.0, 1.0, 0.0)
    assert rows(graph.clustering(node_frame(spark, 5), star), "clustering") == [(0.0,)] * 5


def test_components_of_a_path_and_empty_edges(spark):
    n = 40
    path = edge_frame(spark, [(i, i + 1) for i in range(n - 1)])
    assert {r["component"] for r in graph.connected_components(node_frame(spark, n), path).collect()} == {0}
    assert graph.connected_components(node_frame(spark, 3), path.limit(0)).count() == 3


def test_pagerank_sums_to_one(spark):
    r = graph.pagerank(node_frame(spark, 6), edge_frame(spark, [(0, 1), (1, 2), (3, 1)])).collect()
    assert sum(x["rank"] for x in r) == pytest.approx(1)
    by = {x["id"]: x["rank"] for x in r}
    assert by[1] == max(by.values()) and by[4] == pytest.approx(by[5])


def test_multigraph_is_canonical(spark):
    d = spark.createDataFrame([(1, 2, 1.0), (2, 1, 5.0), (3, 3, 9.0)], "u long, v long, w double")
    assert rows(graph.canonical(d)) == [(1, 2, 5.0)]
    assert rows(graph.with_endpoints(d, spark.createDataFrame([(1,), (3,)], "id long"))) == [(3, 3, 9.0)]


def test_partitions(spark):
    d = spark.createDataFrame([(i % 3, "abc"[i % 3], i % 2, 0) for i in range(60)], "a int, same string, other int, flat int")
    ari = lambda x, y: evaluation.adjusted_rand(d, x, y).first()[0]
    nmi = lambda x, y: evaluation.normalized_mutual_information(d, x, y).first()[0]
    assert ari("a", "same") == 1 and nmi("a", "same") == pytest.approx(1)
    assert abs(ari("a", "other")) < 0.05 and nmi("a", "other") == pytest.approx(0, abs=1e-9)
    assert ari("flat", "flat") == 1


def test_auc_and_precision(spark):
    g = random.Random(3)
    data = [(g.choice([0.1, 0.2, 0.3, 0.4]), g.randint(0, 1)) for _ in range(60)]
    r = evaluation.auc_ap(spark.createDataFrame(data, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / len(pos) / len(neg)
    s, y = np.array([x[0] for x in data]), np.array([x[1] for x in data])
    assert r["auc"] == pytest.approx(auc) == pytest.approx(linkpred.roc_auc(s, y))
    assert r["ap"] == pytest.approx(linkpred.average_precision(s, y))


def test_assignment_is_optimal():
    g = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 3)):
        cost = g.random((n, m))
        got = sum(cost[i, j] for i, j in clustering.assignment(cost))
        small, big = min(n, m), max(n, m)
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert got == pytest.approx(best)


def test_matching_keeps_the_diagonal(spark):
    d = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (1, 0, 1), (1, 1, 5)], "a int, b int, n int")
    assert rows(clustering.matched(d, "a", "b")) == [(0, 0, 5), (1, 1, 5)]


def test_clusterings_find_blobs(spark):
    g = np.random.default_rng(1)
    data = [(i, (g.normal(0, 0.1, 3) + 5 * (i % 3)).tolist(), i % 3) for i in range(45)]
    d = spark.createDataFrame(data, "id int, v array<double>, label int")
    for name in clustering.ALGORITHMS:
        got = clustering.cluster(d, name, 3)
        assert evaluation.adjusted_rand(got, "label", "cluster").first()[0] == 1, name
    with pytest.raises(ValueError):
        clustering.cluster(d, "other", 3)
    assert evaluation.silhouette(d).agg(F.avg("silhouette")).first()[0] > 0.9


def test_empirical_p_and_nulls(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "value double")
    assert enrichment.empirical_p(d, F.lit(2.0)).first()["p"] == 0.75
    assert enrichment.empirical_p(d.limit(0), F.lit(2.0)).first()["p"] is None
    items = spark.createDataFrame([(i, i % 4) for i in range(40)], "k int, c int")
    null = enrichment.permutation_null(items, "k", "c", 3, 1)
    assert rows(null.groupBy("rep", "c").count(), "count") == [(10,)] * 12


def test_redundancy(spark):
    terms = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "cluster int, term string, rank int")
    m = spark.createDataFrame([("a", x) for x in range(10)] + [("b", x) for x in range(9)] + [("c", x) for x in range(20, 25)], "term string, element int")
    assert rows(enrichment.redundancy(terms, m, ["cluster"])) == [(0, "a", "a", False), (0, "b", "a", True), (0, "c", "c", False)]


def test_sampling(spark):
    d = spark.range(100).withColumnRenamed("id", "k")
    a, b = sampling.sample(d, "k", 10, 1), sampling.sample(d.repartition(7), "k", 10, 1)
    assert rows(a) == rows(b) and a.count() == 10
    parts = dict(rows(sampling.split(d, "k", 0.1, 0.2, 3).groupBy("part").count()))
    assert parts == {"test": 10, "val": 20, "train": 70}
    with pytest.raises(ValueError):
        sampling.split(d.limit(2), "k", 0.5, 0.5, 3)
    e = spark.createDataFrame([(0, 1)], "u long, v long")
    n = spark.range(5).select("id", F.col("id").alias("i"))
    neg = rows(sampling.negative_edges(n, e, 6, 3))
    assert len(neg) == 6 and all(u < v and (u, v) != (0, 1) for u, v in neg)


def test_ranks_and_scaling(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (9.0,)], "x double")
    assert rows(ranking.average_rank(d, "x", "r"), "r") == [(1.0,), (2.5,), (2.5,), (4.0,)]
    assert rows(ranking.scaled(d.filter("x = 2"), ["x"])) == [(0.0,), (0.0,)]
    assert ranking.gini(spark.createDataFrame([(5,)] * 4, "n int")).first()["gini"] == pytest.approx(0)
    r = one(spark, m=ranking.normal_quantile(F.lit(0.5)), a=ranking.normal_quantile(F.lit(0.975)), z=ranking.normal_quantile(F.lit(0.01)))
    assert (round(r["m"], 6), round(r["a"], 4), round(r["z"], 4)) == (0.0, 1.96, -2.3263)


def test_features(spark):
    e = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    got = rows(features.zero_filled(spark.createDataFrame([(1,), (2,)], "id int"), e, 2))
    assert got == [(1, [1.0, 2.0], False), (2, [0.0, 0.0], True)]
    blocks = {"text": e, "struct": spark.createDataFrame([(1, [2.0])], "id int, v array<double>")}
    v = features.recipe("text_structlite", blocks, {"struct": 1.0}).first()["v"]
    assert v == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    assert len(features.recipe("random_control", blocks).first()["v"]) == 3
    with pytest.raises(ValueError):
        features.recipe("none", blocks)


def test_runs(spark):
    s = lambda a, b: one(spark, s=compare.status(F.lit(a).cast("double"), F.lit(b).cast("double")))["s"]
    assert [s(1, 1.01), s(1, 1.04), s(1, 1.2), s(None, 1), s(0.001, 0.002)] == ["OK", "WARN", "FAIL", "MISSING", "OK"]
    d = spark.createDataFrame([("base", 1.0, 1.0), ("good", 1.2, 1.0), ("bad", 0.5, None)], "run string, up double, down double")
    board = compare.leaderboard([d.select("run", "up"), d.select("run", "down")], "run", "base", {"up": ("min", 1.0), "down": ("max", 1.1)}, [F.desc("up")])
    assert [r["run"] for r in board.orderBy("place").collect()] == ["good", "base", "bad"]
    assert compare.grid(spark, {"a": [1, 2], "b": ["x", "y"]}, 3).count() == 3
    with pytest.raises(ValueError):
        compare.grid(spark, {"a": []})


def test_knowledge_graph(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    genes = kg.gene_overlap(edge_frame(spark, [(1, 2), (2, 2), (2, 9)]), nodes)
    terms = spark.createDataFrame([(1, "x", 0.01), (2, "x", 0.04), (3, "y", 0.2)], "id long, term string, p double")
    shared = kg.shared_terms(terms, "id", "term", "p", "tf", share=1.0)
    assert rows(shared, "a", "b", "n_shared", "min_pval") == [(1, 2, 1, 0.01)]
    edges, left_out = kg.assemble([genes, shared], nodes)
    assert edges.count() == 2 and rows(left_out) == [("gene_overlap", 0), ("tf", 0)]
    members = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 3)], "group_id string, id long")
    ge = kg.group_edges(edges, members)
    cover = {r["group_id"]: r for r in kg.coverage(members, ge).collect()}
    assert cover["g"]["tf"] == pytest.approx(2 / 3) and cover["h"]["tf"] == 0
    stats = {r["group_id"]: r for r in kg.statistics(members, ge).collect()}
    assert (stats["g"]["n_edges"], stats["g"]["n_components"], stats["h"]["density"]) == (2, 2, 0.0)
    assert rows(kg.only_new(shared, shared)) == []


def test_link_prediction_learns(spark):
    g = np.random.default_rng(2)
    n = 60
    x = np.eye(3)[np.arange(n) % 3] + g.normal(0, 0.1, (n, 3))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if i % 3 == j % 3 and g.random() < 0.3]
    nodes = node_frame(spark, n)
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    run, ids = linkpred.holdout(nodes, f, edge_frame(spark, pairs), config=linkpred.Config(epochs=40, hidden=16, out=8))
    assert run.embedding.shape == (len(ids), 8) and max(r["val_auc"] for r in run.curve) > 0.8


def test_tails_against_exact_sums(spark):
    from math import comb, log

    from setweave.functions import combinatorics as C

    cases = [(60, 20, 15, k) for k in range(0, 16)] + [(3000, 400, 300, k) for k in (0, 1, 20, 40, 41, 80, 299, 300)] + [(30, 25, 20, k) for k in range(14, 21)]
    d = spark.createDataFrame(cases, "n long, a long, b long, x long")
    c = [F.col(k) for k in ("x", "n", "a", "b")]
    for r in d.select("n", "a", "b", "x", C.log_survival(*c).alias("s"), C.log_cdf(*c).alias("c")).collect():
        ways = [comb(r["a"], i) * comb(r["n"] - r["a"], r["b"] - i) if r["b"] - i >= 0 else 0 for i in range(min(r["a"], r["b"]) + 1)]
        total, up, down = sum(ways), sum(ways[r["x"] :]), sum(ways[: r["x"] + 1])
        assert r["s"] == pytest.approx(log(up) - log(total), abs=1e-9, rel=1e-9)
        assert (r["c"] == float("-inf") and not down) or r["c"] == pytest.approx(log(down) - log(total), abs=1e-9, rel=1e-9)


def test_rank_gauss_through_the_quantile_map(spark):
    import numpy as np

    from setweave.operators import ranking

    g = np.random.default_rng(1)
    for n in (40, 1500):
        x = np.round(g.normal(size=n), 2)
        shares = np.linspace(0, 1, min(n, 1000))
        points = np.percentile(x, shares * 100)
        p = 0.5 * (np.interp(x, points, shares) - np.interp(-x, -points[::-1], -shares[::-1]))
        from statistics import NormalDist

        want = [max(-5.19934, min(5.19934, NormalDist().inv_cdf(min(max(v, 1e-7), 1 - 1e-7)))) for v in p]
        d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
        got = [r["y"] for r in ranking.rank_gauss(d, "x", "y").orderBy("id").collect()]
        assert got == pytest.approx(want, abs=1e-4)
    few = ranking.rank_gauss(spark.createDataFrame([(1.0,), (3.0,)], "x double"), "x", "y")
    assert sorted(r["y"] for r in few.collect()) == [-1.0, 1.0]


def test_running_sums_in_ranges(spark):
    from setweave.operators import ranking

    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(2).alias("w"))
    assert all(r["s"] == 2 * (r["v"] + 1) for r in ranking.running(d, "v", {"s": "w"}).collect())


def test_numbers_in_parts(spark):
    from setweave.operators import ranking

    d = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 11 % 500).alias("v"))
    by_value = ranking.numbered(d, [F.col("v")], ranking.range_of(d, "v"))
    assert sorted((r["v"], r["i"]) for r in by_value.collect()) == [(v, v + 1) for v in range(500)]
    for g in range(3):
        own = [r for r in ranking.numbered(d, [F.col("v")], F.floor(F.col("v") / 100), ["g"]).collect() if r["g"] == g]
        assert [r["i"] for r in sorted(own, key=lambda r: r["v"])] == list(range(1, len(own) + 1))
    assert ranking.numbered(d.limit(0), [F.col("v")], F.lit(0)).count() == 0


def test_word_and_character_runs(spark):
    from setweave.operators import evaluation

    d = spark.createDataFrame([(1, "The red fox a"), (2, "red fox"), (3, None), (4, "  ")], "id int, text string")
    w = evaluation.ngram_tfidf(d, stop=["the"], min_df=1)
    terms = {r["term"] for r in w.filter("id = 1").collect()}
    assert {"w:red", "w:fox", "w:red fox", "c: a ", "c: re", "c: red "} <= terms
    assert not {"w:the", "w:the red", "w:a"} & terms and {r["id"] for r in w.select("id").distinct().collect()} == {1, 2}
    length = w.groupBy("id", F.substring("term", 1, 1).alias("part")).agg(F.sum(F.col("w") * F.col("w")).alias("l"))
    assert all(r["l"] == pytest.approx(1) for r in length.collect())
    short = evaluation.ngram_tfidf(d.filter("id = 1"), chars=(3, 5), min_df=1).filter("term = 'c: a '")
    assert short.count() == 1


def test_later_articles_only_add_pairs(spark):
    meta = spark.createDataFrame([(1, "a, b;c"), (2, "a;b"), (3, ""), (4, None)], "gs_id int, pmids string")
    found = spark.createDataFrame([(3, "c"), (3, "a"), (4, "z"), (2, "c")], "gs_id int, pmid string")
    assert rows(kg.costudy(meta), "a", "b", "n_shared") == [(1, 2, 2)]
    assert rows(kg.costudy(meta, found=found), "a", "b", "n_shared") == [(1, 2, 2), (1, 3, 1), (2, 3, 1)]
    named = spark.createDataFrame([(1, "path:x", "X"), (2, "path:x", None), (1, "y", None), (2, "y", None)], "gs_id int, term string, name string")
    (p,) = kg.pathways(named).collect()
    assert (p["shared"], p["names"], p["sources"]) == (["path:x", "y"], ["X", "y"], ["KEGG", "Reactome"])


def test_search_over_a_grid(spark):
    from setweave.plans import study

    def trial(p):
        return spark.createDataFrame([("up", float(p["x"])), ("held", 1.0 if p["y"] == "a" else 2.0)], "metric string, value double")

    base = spark.createDataFrame([("up", 1.0), ("held", 1.0)], "metric string, value double")
    out = study.tune(spark, {"x": [1, 2, 3], "y": ["a", "b"]}, trial, base, {"up": (1.0, True)}, {"held": False})
    best = out.orderBy("place").collect()
    assert [(r["x"], r["y"], r["score"], r["feasible"]) for r in best][:4] == [(3, "a", 2.0, True), (2, "a", 1.0, True), (1, "a", 0.0, True), (3, "b", 2.0, False)]
    runs = spark.createDataFrame([(s, "m", float(v)) for s, v in ((1, 1), (2, 5), (3, 6))] + [(1, "n", None)], "seed int, metric string, value double")
    (m, n) = compare.over_seeds(runs, "m").orderBy("metric").collect()
    assert (m["n"], m["mean"], m["representative"]) == (3, 4.0, 2) and (n["n"], n["mean"], n["representative"]) == (0, None, 2)
