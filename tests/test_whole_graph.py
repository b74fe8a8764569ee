"""Graph queries without SQL read every edge: brute force on the whole graph."""

import duckdb
import numpy as np
import pytest

from setweave.catalog import QUERIES
from setweave.plans.relational_queries import CANON, EDGES

from .oracle import views

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    views(c, SF)
    return c


def adjacency(con):
    near = {i: {} for (i,) in con.execute("SELECT s_suppkey FROM supplier").fetchall()}
    for u, v, w in con.execute(f"WITH {EDGES}, {CANON} SELECT u, v, w FROM c").fetchall():
        near[u][v] = near[v][u] = float(w)
    return near


def test_cores_by_peeling(spark, con):
    near, core, k = {u: set(x) for u, x in adjacency(con).items()}, {}, 0
    while near:
        u = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[u]))
        core[u] = k
        for v in near.pop(u):
            near[v].discard(u)
    assert {r["id"]: r["core"] for r in QUERIES["core_numbers"](spark, SF).collect()} == core


def test_propagation_over_all_edges(spark, con):
    x = {i: np.array(v, float) for i, v in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    near = {u: {v: w for v, w in e.items() if v in x} | {u: 1.0} for u, e in adjacency(con).items() if u in x}
    d = {u: sum(e.values()) for u, e in near.items()}
    want = {u: np.linalg.norm(sum(w / np.sqrt(d[u] * d[v]) * x[v] for v, w in e.items())) for u, e in near.items()}
    got = {r["id"]: r["norm"] for r in QUERIES["sage_propagation"](spark, SF).collect()}
    assert {u: got[u] for u in want} == pytest.approx(want, abs=2e-4)


def test_group_degrees_count_all_edges(spark, con):
    near = adjacency(con)
    nation = dict(con.execute("SELECT s_suppkey, s_nationkey FROM supplier").fetchall())
    want = {}
    for name, of in (("A", {i: n % 4 for i, n in nation.items()}), ("B", {i: i % 4 for i in nation})):
        for u in nation:
            inside = [v for v in nation if v != u and of[v] == of[u]]
            want[f"{name}{of[u]}", u] = sum(v in near[u] or nation[v] == nation[u] for v in inside) / len(inside)
    got = {(r["group_id"], r["id"]): r["degree"] for r in QUERIES["group_centrality"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-5)


