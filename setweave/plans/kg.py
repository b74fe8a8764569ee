"""Knowledge graphs of clusters: relations, assembly, coverage, statistics and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import numbers as N, text as T
from ..operators import clustering, graph, setsim

EDGE_TYPES = ("gene_overlap", "pubmed", "mesh", "pathway", "tf", "go_bp")
#: Columns of an edge; a relation leaves those that it lacks null.
ATTRIBUTES = {"weight": "double", "n_shared": "bigint", "shared": "array<string>", "names": "array<string>", "sources": "array<string>", "min_pval": "double"}


def relation(df: DataFrame, edge_type: str) -> DataFrame:
    """Edges of one type with the common columns."""
    have = set(df.columns)
    return df.select("a", "b", F.lit(edge_type).alias("edge_type"), *[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in ATTRIBUTES.items()])


def gene_overlap(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = edges.filter(F.col("u") != F.col("v"))
    d = graph.with_endpoints(d, nodes)
    return relation(d.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("weight")), "gene_overlap")


def shared_values(values: DataFrame, key: str, value: str, edge_type: str, share: float | None = None) -> DataFrame:
    """Items with common values; ``share`` first drops values that more than that part of the items hold."""
    if share is not None:
        values = setsim.prevalence_limited(values, key, value, share)
    return relation(setsim.shared_value_pairs(values, key, value).withColumn("shared", F.col("values").cast("array<string>")), edge_type)


def shared_terms(terms: DataFrame, key: str, term: str, pval: str, edge_type: str, cutoff: float = 0.05, share: float = 0.8) -> DataFrame:
    """Items with common significant terms, and the least over the terms of the smaller p (1 at most)."""
    d = setsim.prevalence_limited(terms.filter(F.col(pval) <= cutoff), key, term, share)
    least = F.least(F.min(F.least(F.col(f"x.{pval}"), F.col(f"y.{pval}"))), F.lit(1.0)).alias("min_pval")
    return relation(setsim.shared_value_pairs(d, key, term, [least]).withColumn("shared", F.col("values").cast("array<string>")), edge_type)


def costudy(meta: DataFrame, key: str = "gs_id", pmids: str = "pmids", found: DataFrame | None = None) -> DataFrame:
    """Items with a common article; ``found`` (key, pmid) of a later look-up only adds pairs, with one article each (the least)."""
    own = meta.select(key, F.explode(T.parse_pmids(F.col(pmids))).alias("pmid"))
    direct = shared_values(own, key, "pmid", "pubmed_costudy")
    if found is None:
        return direct
    every = shared_values(own.unionByName(found.select(key, F.col("pmid").cast("string").alias("pmid"))), key, "pmid", "pubmed_costudy")
    extra = only_new(every, direct).withColumn("n_shared", F.lit(1).cast("long")).withColumn("shared", F.slice("shared", 1, 1))
    return direct.unionByName(extra)


def named_terms(annotations: DataFrame, edge_type: str, key: str = "gs_id", term: str = "term", name: str = "name") -> DataFrame:
    """Items with common annotations (key, term, name), and the terms' names; a term without a name goes by its id, one with several by the least."""
    called = annotations.groupBy(term).agg(F.coalesce(F.min(name), F.col(term)).alias("_name"))
    d = annotations.select(key, term).join(called, term)
    names = F.array_sort(F.collect_set("x._name")).alias("names")
    return relation(setsim.shared_value_pairs(d, key, term, [names]).withColumn("shared", F.col("values").cast("array<string>")), edge_type)


def pathways(annotations: DataFrame, key: str = "gs_id", term: str = "term", name: str = "name") -> DataFrame:
    """Items with common pathways: ids, names and the databases that they come from."""
    d = named_terms(annotations, "shared_pathway", key, term, name)
    source = lambda t: F.when(t.startswith("path:"), "KEGG").otherwise("Reactome")
    return d.withColumn("sources", F.array_sort(F.array_distinct(F.transform("shared", source))))


def diseases(meta: DataFrame, annotations: DataFrame | None = None, key: str = "gs_id", mesh: str = "mesh_descriptors") -> DataFrame:
    """Items with common diseases; without disease annotations, with common subject headings of the metadata."""
    if annotations is not None:
        return named_terms(annotations, "shared_disease", key)
    headings = meta.select(key, F.explode(T.split_values(F.col(mesh), ";")).alias("term")).withColumn("name", F.col("term"))
    return named_terms(headings, "shared_mesh_term", key)


def only_new(pairs: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs that ``old`` doesn't have yet; what it has isn't added to."""
    return pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")


def assemble(relations: list[DataFrame], nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between nodes, number of edges left out by type)."""
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), relations)
    ids = nodes.select("id")
    kept = every.join(ids, F.col("a") == F.col("id"), "left_semi").join(ids, F.col("b") == F.col("id"), "left_semi")
    all_, own = every.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")), kept.groupBy("edge_type").agg(F.count(F.lit(1)).alias("k"))
    return kept, all_.join(own, "edge_type", "left").select("edge_type", (F.col("n") - F.coalesce("k", F.lit(0))).alias("left_out"))


def groups(assignments: DataFrame, columns: dict[str, str], key: str = "id") -> DataFrame:
    """(group_id, id): clusters of several assignments in one column, such as A0..A9, B0..B9."""
    stacked = ", ".join(f"'{prefix}', {c}" for prefix, c in columns.items())
    d = assignments.select(key, F.expr(f"stack({len(columns)}, {stacked}) as (prefix, label)"))
    return d.filter("label is not null").select(F.concat("prefix", F.col("label").cast("string")).alias("group_id"), F.col(key).alias("id"))


def group_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in a group, once for each group: all groups in one plan."""
    x = members.select("group_id", F.col("id").alias("a"))
    y = members.select("group_id", F.col("id").alias("b"))
    return edges.join(x, "a").join(y, ["group_id", "b"])


def edge_degrees(edges: DataFrame) -> DataFrame:
    """(group_id, id, edge_type, d): edges of each type that a node has in its group."""
    return edges.select("group_id", "edge_type", F.explode(F.array("a", "b")).alias("id")).groupBy("group_id", "id", "edge_type").agg(F.count(F.lit(1)).alias("d"))


def shared_degrees(values: DataFrame, key: str, value: str, edge_type: str, members: DataFrame) -> DataFrame:
    """The same of the edges that ``shared_values`` gives, of which none is made.

    Items with equal sets of values are one class; only classes that share a value are paired, and an item has
    as many edges as the classes beside its own (its own too) have members in its group, less itself.
    """
    own = values.select(F.col(key).alias("id"), F.col(value).alias("_v")).filter("_v is not null").groupBy("id").agg(F.array_sort(F.collect_set("_v")).alias("_s"))
    own = own.withColumn("_c", F.sha2(F.to_json("_s"), 256))
    held = own.select("_c", "_s").dropDuplicates(["_c"]).select("_c", F.explode("_s").alias("_v"))
    near = held.join(held.select(F.col("_c").alias("_o"), "_v"), "_v").select("_c", "_o").distinct()
    inside = members.select("group_id", "id").distinct().join(own.select("id", "_c"), "id")
    size = inside.groupBy("group_id", F.col("_c").alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    d = size.join(near, "_o").groupBy("group_id", "_c").agg((F.sum("_n") - 1).alias("d"))
    return inside.join(d, ["group_id", "_c"]).filter("d > 0").select("group_id", "id", F.lit(edge_type).alias("edge_type"), "d")


def coverage(members: DataFrame, edges: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """group_id, n_nodes, and for each type the share of nodes with an edge of it."""
    return coverage_of(members, edge_degrees(edges), types)


def coverage_of(members: DataFrame, degrees: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """``coverage`` from the nodes' degrees, one row a node and type."""
    n = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    c = degrees.groupBy("group_id").pivot("edge_type", list(types)).agg(F.count(F.lit(1)))
    d = n.join(c, "group_id", "left")
    return d.select("group_id", "n_nodes", *[(F.coalesce(t, F.lit(0)) / F.col("n_nodes")).alias(t) for t in types])


def edge_counts(edges: DataFrame, types: tuple[str, ...] = EDGE_TYPES, by: str = "group_id") -> DataFrame:
    c = edges.groupBy(by).pivot("edge_type", list(types)).agg(F.count(F.lit(1)))
    return c.select(by, *[F.coalesce(t, F.lit(0)).cast("long").alias(f"n_edges_{t}") for t in types])


def edge_counts_of(degrees: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """``edge_counts`` by group from the nodes' degrees: an edge has two ends."""
    c = degrees.groupBy("group_id").pivot("edge_type", list(types)).agg(F.sum("d"))
    return c.select("group_id", *[(F.coalesce(t, F.lit(0)) / 2).cast("long").alias(f"n_edges_{t}") for t in types])


def statistics(members: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, n_nodes, n_edges, density, n_components, mean_degree, average_clustering of the simple graphs.

    Nodes and edges carry their group in the id, so that every group is handled by the same few plans.
    """
    tag = lambda c: F.concat_ws("\x1f", "group_id", F.col(c).cast("string"))
    nodes = members.select(tag("id").alias("id"), "group_id")
    e = graph.simple(edges.select(tag("a").alias("u"), tag("b").alias("v"))).withColumn("w", F.lit(1.0))
    n = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    multi = edges.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_edges"))
    m = e.select(F.split("u", "\x1f")[0].alias("group_id")).groupBy("group_id").agg(F.count(F.lit(1)).alias("m"))
    parts = graph.connected_components(nodes, e).join(nodes, "id").groupBy("group_id").agg(F.countDistinct("component").alias("n_components"))
    near = graph.clustering(nodes, e).join(nodes, "id").groupBy("group_id").agg(F.avg("clustering").alias("average_clustering"))
    d = n.join(multi, "group_id", "left").join(m, "group_id", "left").join(parts, "group_id").join(near, "group_id")
    k, l = F.col("n_nodes"), F.coalesce("m", F.lit(0))  # noqa: E741
    return d.select(
        "group_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), graph.density(k, l).alias("density"), "n_components",
        (2 * l / k).alias("mean_degree"), "average_clustering",
    )


def matched_comparison(assignments: DataFrame, a: str, b: str, metrics: DataFrame, names: list[str], prefixes: tuple[str, str] = ("A", "B")) -> DataFrame:
    """One row a matched pair of clusters: overlap, sizes, and each metric of both with delta and ratio."""
    counts = assignments.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = clustering.matched(counts, a, b)
    size = lambda c, out: assignments.groupBy(c).agg(F.count(F.lit(1)).alias(out))
    d = pairs.join(size(a, "size_a"), a).join(size(b, "size_b"), b)
    d = d.withColumn("a_group", F.concat(F.lit(prefixes[0]), F.col(a).cast("string"))).withColumn("b_group", F.concat(F.lit(prefixes[1]), F.col(b).cast("string")))
    for side in ("a", "b"):
        d = d.join(metrics.select(F.col("group_id").alias(f"{side}_group"), *[F.col(m).alias(f"{m}_{side}") for m in names]), f"{side}_group", "left")
    extra: list[Column] = []
    for m in names:
        x, y = F.col(f"{m}_a"), F.col(f"{m}_b")
        extra += [x, y, (y - x).alias(f"{m}_delta"), F.when(x != 0, y / x).alias(f"{m}_ratio")]
    return d.select("a_group", "b_group", "overlap", N.overlap_pct(F.col("overlap"), F.col("size_a"), F.col("size_b")).alias("overlap_pct"), "size_a", "size_b", *extra)


def regions(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, region: only_a, both or only_b."""
    x, y = a.select("id", F.lit(True).alias("in_a")).distinct(), b.select("id", F.lit(True).alias("in_b")).distinct()
    d = x.join(y, "id", "full")
    return d.select("id", F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "only_a").otherwise("only_b").alias("region"))


def first_edges(edges: DataFrame, order: list[Column]) -> DataFrame:
    """One edge for each undirected pair and type: the first in ``order``."""
    pair = W.partitionBy(F.least("a", "b"), F.greatest("a", "b"), "edge_type").orderBy(*order)
    return edges.withColumn("_r", F.row_number().over(pair)).filter("_r = 1").drop("_r")


def cluster_context(members: DataFrame, edges: DataFrame, meta: DataFrame, terms: DataFrame, n_sets: int = 5, n_terms: int = 10) -> DataFrame:
    """group_id and a prompt: the sets of highest degree and the most frequent terms of each group."""
    return cluster_context_of(members, edge_degrees(edges), meta, terms, n_sets, n_terms)


def cluster_context_of(members: DataFrame, degrees: DataFrame, meta: DataFrame, terms: DataFrame, n_sets: int = 5, n_terms: int = 10) -> DataFrame:
    """``cluster_context`` from the nodes' degrees by type."""
    ends = degrees.groupBy("group_id", "id").agg(F.sum("d").alias("d"))
    d = members.join(ends, ["group_id", "id"], "left").join(meta.select("id", "name"), "id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    rk = F.row_number().over(W.partitionBy("group_id").orderBy(F.desc("d"), "id"))
    top = d.withColumn("r", rk).filter(F.col("r") <= n_sets)
    listed = lambda order, value: F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("x")))), lambda s: s["x"]))
    sets = top.groupBy("group_id").agg(listed("r", T.truncated(F.coalesce("name", F.col("id").cast("string")), 60)).alias("sets"))
    held = members.join(terms.select("id", "term").distinct(), "id").groupBy("group_id", "term").agg(F.count(F.lit(1)).alias("c"))
    rt = F.row_number().over(W.partitionBy("group_id").orderBy(F.desc("c"), "term"))
    best = held.withColumn("r", rt).filter(F.col("r") <= n_terms).groupBy("group_id").agg(listed("r", T.strip_term_suffix(F.col("term").cast("string"))).alias("terms"))
    out = sets.join(best, "group_id", "left")
    return out.select("group_id", F.concat(F.lit("Sets: "), "sets", F.lit(". Terms: "), F.coalesce("terms", F.lit("none"))).alias("prompt"))
