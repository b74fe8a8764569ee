"""Steps that used to write a row, or a copied block, for every pair."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from setweave.functions import combinatorics
from setweave.operators import evaluation, graph, setsim

from .conftest import rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def points(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK_ROWS", 16)
    monkeypatch.setattr(evaluation, "PART_BYTES", 4000)
    x = np.round(np.random.default_rng(5).standard_normal((150, 4)), 1)
    return x, spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, label int")


def test_blocks_are_not_copied_for_pairs(points):
    for d in (evaluation.nearest(points[1], 3), evaluation.silhouette(points[1]), evaluation.pair_cosines(points[1].withColumn("w", F.col("v")))):
        assert "CartesianProduct" in plan(d) and "hashpartitioning(own" not in plan(d)


def test_neighbours_over_parts_of_blocks(points):
    x, d = points
    dist = np.round(-np.sqrt(((x[:, None] - x) ** 2).sum(2)), 9)
    np.fill_diagonal(dist, -np.inf)
    want = [(i, int(j), k + 1) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), -dist[i]))[:3])]
    assert rows(evaluation.nearest(d, 3, metric="euclidean"), "id", "other", "rk") == sorted((i, j, k) for i, j, k in want)


def test_silhouette_over_parts_of_blocks(points, monkeypatch):
    monkeypatch.setattr(evaluation, "MOST_CELLS", 20)
    x, d = points
    dist, label = np.sqrt(((x[:, None] - x) ** 2).sum(2)), np.arange(len(x)) % 3
    mean = np.stack([dist[:, label == c].sum(1) / ((label == c).sum() - (label == c)) for c in range(3)], 1)
    own = mean[np.arange(len(x)), label]
    mean[np.arange(len(x)), label] = np.inf
    b = mean.min(1)
    got = [r[1] for r in rows(evaluation.silhouette(d), "id", "silhouette")]
    assert got == pytest.approx((b - own) / np.maximum(own, b))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_triangles_by_three_groups_of_nodes(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "GROUP_EDGES", 20)
    monkeypatch.setattr(graph, "WEDGES", 50)
    g = np.random.default_rng(3)
    w = {e: g.random() for e in combinations(range(40), 2) if g.random() < 0.3}
    d = spark.createDataFrame([(*e, r) for e, r in w.items()], "u long, v long, r double").select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"), "r")
    want: dict = {}
    for a, b, c in combinations(range(40), 3):
        if (a, b) in w and (b, c) in w and (a, c) in w:
            for i in (a, b, c):
                n, s = want.get(i, (0, 0.0))
                want[i] = n + 1, s + w[a, b] * w[b, c] * w[a, c]
    sums = graph.triangle_sums(d, "r")
    assert "Join" not in plan(sums)
    got = {int(r["id"]): (r["triangles"], r["s"]) for r in sums.collect()}
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_clustering_joins_every_two_suppliers_of_an_order(spark, tmp_path):
    from setweave.catalog import QUERIES

    # one order of three suppliers: a triangle, of which the first line's pairs are but two sides
    lines = [(1, s, k, 8.0) for k, s in enumerate((10, 20, 30), 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10,), (20,), (30,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert rows(QUERIES["avg_clustering"](spark, str(tmp_path))) == [(1.0,)]
    assert rows(QUERIES["weighted_clustering"](spark, str(tmp_path))) == [(10, 1.0), (20, 1.0), (30, 1.0)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_overlaps_by_blocks_of_sets(spark, monkeypatch, kind):
    monkeypatch.setattr(setsim, "BLOCK_SETS", 4)
    monkeypatch.setattr(setsim, "MOST_CELLS", 50)
    g = np.random.default_rng(2)
    sets = {str(k): set(g.integers(0, 12, 4).tolist()) for k in range(30)}
    d = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s], "gs_id string, gene long").select(F.col("gs_id").cast(kind).alias("gs_id"), "gene")
    before = (lambda k: int(k)) if kind == "long" else str
    want = sorted((before(a), before(b), len(sets[a] & sets[b])) for a in sets for b in sets if before(a) < before(b) and sets[a] & sets[b])
    found = setsim.overlaps(d)
    assert "gs_id" not in plan(found).split("FlatMapGroupsInArrow")[0] and "FlatMapGroupsInArrow" in plan(found)
    assert rows(found) == want


def test_statistics_of_batches_are_those_of_rows(spark):
    cells = spark.createDataFrame([(o, u, a, b) for u in (40, 5000) for a in (1, 20, 35) for b in (3, 30) for o in range(max(0, a + b - u), min(a, b) + 1)], "o long, u long, a long, b long")
    o, u, a, b = (F.col(c) for c in "ouab")
    d = cells.withColumn("s", combinatorics.pair_statistics(o, u, a, b)).select(
        "s.*", (-combinatorics.log_pmf(o, u, a, b)).alias("x"), combinatorics.cdf(o - 1, u, a, b).alias("y"),
        (-combinatorics.log_cdf(F.least(a, b) - o, u, a, b)).alias("z"), (-combinatorics.log_survival(o, u, a, b)).alias("w"),
    )
    for r in d.collect():
        assert tuple(r)[:4] == pytest.approx(tuple(r)[4:], rel=1e-9, abs=1e-12)


def test_degrees_of_shared_values_are_counted_without_edges(spark):
    from setweave.plans import kg

    g = np.random.default_rng(4)
    values = spark.createDataFrame([(i, int(v)) for i in range(40) for v in set(g.integers(0, 9, 1 + i % 3).tolist())] + [(3, None)], "id long, v long")
    members = spark.createDataFrame([(p, i) for i in range(40) for p in (f"A{i % 2}", f"B{i % 5}")], "group_id string, id long")
    made = kg.edge_degrees(kg.group_edges(kg.shared_values(values, "id", "v", "mesh"), members))
    counted = kg.shared_degrees(values, "id", "v", "mesh", members)
    assert rows(counted, "group_id", "id", "edge_type", "d") == rows(made, "group_id", "id", "edge_type", "d")


@pytest.mark.parametrize("most", [0, 1000])
def test_cores_without_ranking_every_edge(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_BROADCAST_NODES", most)
    pairs = [*combinations(range(5), 2), (4, 5), (5, 6), (6, 7), (5, 7), (7, 8)]
    d = spark.createDataFrame([(*e, 1.0) for e in pairs], "u long, v long, w double")
    got = rows(graph.core_numbers(spark.range(10), d))
    assert got == [(0, 4), (1, 4), (2, 4), (3, 4), (4, 4), (5, 2), (6, 2), (7, 2), (8, 1), (9, 0)]


def test_training_in_chunks_of_edges(monkeypatch):
    from setweave.operators import linkpred

    g, n = np.random.default_rng(1), 60
    e = np.array([p for p in combinations(range(n), 2) if g.random() < 0.2])
    x, w, held = g.standard_normal((n, 8)), g.random(len(e)), {"val": (e[:30], g.integers(0, n, (30, 2)))}
    run = lambda: linkpred.train(x, e[30:], w[30:], e[30:], held, linkpred.Config(epochs=10, hidden=8, out=4)).curve
    whole = run()
    monkeypatch.setattr(linkpred, "CHUNK", 17)
    for a, b in zip(whole, run(), strict=True):
        assert a == pytest.approx(b)


def test_link_prediction_sees_every_two_suppliers_of_an_order(spark, tmp_path, monkeypatch):
    from setweave.catalog import QUERIES
    from setweave.operators import linkpred

    lines = [(1, s, k, 8.0) for k, s in enumerate((10, 20, 30), 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10,), (20,), (30,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, [1.0, 0.0]) for i in (10, 20, 30)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, row = [], {"epoch": 1, "train_loss": 0.0, "val_auc": 0.5, "val_ap": 0.5, "test_auc": 0.5, "test_ap": 0.5}

    def holdout(nodes, features, edges, config=None):
        seen.extend(rows(graph.canonical(edges), "u", "v"))
        return linkpred.Run(curve=[row]), []

    monkeypatch.setattr(linkpred, "holdout", holdout)
    QUERIES["gnn_linkpred"](spark, str(tmp_path))
    assert seen == [(10, 20), (10, 30), (20, 30)]
