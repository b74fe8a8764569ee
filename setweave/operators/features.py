"""Feature blocks and the recipes that combine them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N, text as T, vectors as V
from . import graph, ranking, sampling


def zero_filled(ids: DataFrame, embeddings: DataFrame, dim: int, key: str = "id", vector: str = "v") -> DataFrame:
    """Every id with its vector, or zeros; ``missing`` tells which."""
    d = ids.select(key).join(embeddings.select(key, vector), key, "left")
    return d.select(key, F.coalesce(V.doubles(F.col(vector)), F.array_repeat(F.lit(0.0), dim)).alias(vector), F.col(vector).isNull().alias("missing"))


def aligned(a: DataFrame, b: DataFrame, ids: DataFrame | None = None, key: str = "id", vector: str = "v") -> DataFrame:
    """key, a, b of ids that both (and ``ids``) have."""
    out = a.select(key, F.col(vector).alias("a")).join(b.select(key, F.col(vector).alias("b")), key)
    return out if ids is None else out.join(ids.select(key), key, "left_semi")


def direction_flags(x: Column) -> list[Column]:
    t = F.lower(T.to_text(x))
    return [(t == "up").cast("double").alias("dir_up"), t.isin("dn", "down").cast("double").alias("dir_dn"), (~t.isin("up", "dn", "down")).cast("double").alias("dir_other")]


def top_values(df: DataFrame, column: str, n: int) -> list[str]:
    """The n most frequent values (ties: first in the alphabet)."""
    return [r[0] for r in df.groupBy(column).count().filter(F.col(column).isNotNull() & (F.col(column) != "")).orderBy(F.desc("count"), column).limit(n).collect()]


def metadata_features(meta: DataFrame, key: str = "gs_id", n_organisms: int = 8) -> DataFrame:
    """key, v: log size, direction, publication, scaled year and organism columns, each z-scored."""
    year = T.parse_year(F.col("pub_years"))
    d = meta.select(
        key,
        F.log1p(F.greatest(T.safe_float(F.col("gs_size")), F.lit(0.0))).alias("size"),
        *direction_flags(F.col("direction")),
        T.safe_float(F.col("pubmed_present")).alias("pubmed"),
        N.scaled_year(year).alias("year"),
        year.isNull().cast("double").alias("no_year"),
        T.to_text(F.col("organism")).alias("organism"),
    )
    names = top_values(d, "organism", n_organisms)
    for i, name in enumerate(names):
        d = d.withColumn(f"organism_{i}", (F.col("organism") == name).cast("double"))
    d = d.drop("organism")
    columns = [c for c in d.columns if c != key]
    return ranking.scaled(d, columns).select(key, F.array(*columns).alias("v"))


def structural_features(nodes: DataFrame, edges: DataFrame, block: str = "basic", how: str = "zscore") -> DataFrame:
    """id, v of graph features: basic (degree, strength, weighted clustering, rank), basic_plus (and core, triangles)."""
    d = graph.degrees(nodes, edges).withColumn("strength", F.log1p("strength")).withColumn("degree", F.log1p("degree"))
    d = d.join(graph.weighted_clustering(nodes, edges), "id").join(graph.pagerank(nodes, edges), "id")
    columns = ["degree", "strength", "clustering", "rank"]
    if block in ("basic_plus", "centrality_plus"):
        d = d.join(graph.core_numbers(nodes, edges), "id").join(graph.triangle_counts(nodes, edges), "id")
        d = d.withColumn("core", F.col("core").cast("double")).withColumn("triangles", F.log1p("triangles"))
        columns += ["core", "triangles"]
    if block == "centrality_plus":
        one = lambda f: f.withColumn("group_id", F.lit(0))
        c = graph.centrality(one(edges), one(nodes), sampled=graph.sample_size(nodes.count())).select("id", "closeness", "betweenness")
        d = d.join(c, "id")
        columns += ["closeness", "betweenness"]
    if how == "rankgauss":
        for c in columns:
            d = ranking.rank_gauss(d, c, f"_{c}").drop(c).withColumnRenamed(f"_{c}", c)
    elif how != "none":
        d = ranking.scaled(d.select("id", *columns), columns, how)
    return graph.cut(d.select("id", F.array(*columns).alias("v")))


RECIPES = {
    "text_only": ("text",),
    "text_meta": ("text", "meta"),
    "text_structlite": ("text", "struct"),
    "text_meta_structlite": ("text", "meta", "struct"),
    "node2vec_only": ("node2vec",),
    "text_node2vec": ("text", "node2vec"),
}
CONTROLS = ("shuffle_control", "random_control")


def recipe(name: str, blocks: dict[str, DataFrame], scales: dict[str, float] | None = None, seed: int = 11) -> DataFrame:
    """id, v: the recipe's blocks (id, v), scaled and joined end to end, rows of unit length.

    shuffle_control deals the vectors of text_structlite over other ids; random_control draws normal
    ones of the same length.  Both follow from the seed and the ids alone.
    """
    if name in CONTROLS:
        base = recipe("text_structlite", blocks, scales, seed)
        if name == "shuffle_control":
            return sampling.permuted(base, "id", "v", seed)
        unit = lambda i, tag: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{tag}"), "id", i)), 1, 8), 16, 10).cast("double") + 1) / (2.0**32 + 1)
        draw = F.transform("v", lambda _, i: F.sqrt(-2 * F.log(unit(i, "r"))) * F.cos(2 * F.pi() * unit(i, "a")))
        return base.select("id", V.l2_normalized(draw).alias("v"))
    if name not in RECIPES:
        raise ValueError(f"unknown recipe {name!r}; one of {', '.join([*RECIPES, *CONTROLS])}")
    parts = RECIPES[name]
    out = None
    for p in parts:
        scaled = V.scaled(V.doubles(F.col("v")), (scales or {}).get(p, 1.0)).alias(p)
        block = blocks[p].select("id", scaled)
        out = block if out is None else out.join(block, "id")
    return out.select("id", V.l2_normalized(F.concat(*parts)).alias("v"))


def hashed_text_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a sentence encoder: signed hashed word counts, of unit length."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")
    sign = lambda w: F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)
    counted = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(words, lambda w: slot(w) == i), F.lit(0.0), lambda s, w: s + sign(w)))
    return V.l2_normalized(counted)


def missing_ids(ids: DataFrame, sources: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(source, key) of the ids that each source lacks."""
    parts = [ids.select(key).distinct().join(d.select(key), key, "left_anti").select(F.lit(name).alias("source"), key) for name, d in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scatter(points: DataFrame, label: str, palette: list[str], key: str = "id", point: str = "p") -> DataFrame:
    """(key, x, y, label, colour): what a scatter plot draws; labels take the palette's colours in turn."""
    colour = F.get(F.array(*map(F.lit, palette)), F.pmod(F.col(label), F.lit(len(palette))).cast("int"))
    return points.select(key, F.col(point)[0].alias("x"), F.col(point)[1].alias("y"), F.col(label).alias("label"), colour.alias("colour"))
