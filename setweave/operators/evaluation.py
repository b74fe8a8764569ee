"""Cluster evaluation: internal indices, agreement of partitions, text coherence."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vectors as V
from . import graph, ranking

#: Rows of a block, about; a task holds a block, what it folds for it, and one block of the others at a time.
BLOCK_ROWS = 512
#: Tasks that the blocks are dealt to, and bytes of the other blocks that one of them reads.
TASKS, PART_BYTES = 96, 64_000_000
#: Cells (row by cluster) that a block's sums may take before they are handed on.
MOST_CELLS = 2_000_000


def _packed(df: DataFrame, columns: list[str], vectors: list[str]) -> DataFrame:
    """(own, columns as lists, vectors as matrices in bytes): rows in blocks by the hash of k, in the order of k."""
    blocks = max(1, -(-df.count() // BLOCK_ROWS))
    kinds = dict(df.dtypes)
    d = df.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    lists = d.groupBy("own").agg(F.collect_list(F.struct(*columns, *vectors)).alias("rows"))  # about BLOCK_ROWS of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, rows in zip(batch.column(0), batch.column(1), strict=True):
                x = rows.values
                x = x.take(pc.sort_indices(x.field("k")))
                parts = [pa.array([own.as_py()], pa.int32())]
                parts += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.field(c)) for c in columns]
                parts += [pa.array([_matrix(x, c).astype(float).tobytes()], pa.binary()) for c in vectors]
                yield pa.RecordBatch.from_arrays(parts, names=["own", *columns, *vectors])

    schema = ", ".join(["own int", *[f"{c} array<{kinds[c]}>" for c in columns], *[f"{c} binary" for c in vectors]])
    return graph.cut(lists.mapInArrow(run, schema).repartition(min(blocks, TASKS)))


def _folded(df: DataFrame, columns: list[str], vectors: list[str], fold: Callable, schema: str) -> DataFrame:
    """``fold`` over every block of rows beside every block, in ``schema``.

    The blocks are written once.  A task reads its own and a part of the others, of PART_BYTES at most, and
    what leaves it is folded over that part: nothing is copied for a pair of blocks, and no pair is shuffled.
    ``fold`` takes a block and the blocks beside it, one at a time, and gives record batches.
    """
    packed = _packed(df, columns, vectors)
    names = [*columns, *vectors]
    held = packed.agg(F.sum(sum((F.length(v) for v in vectors), F.lit(0))).alias("n")).first()["n"] or 0
    others = packed.coalesce(max(1, -(-held // PART_BYTES))).select(F.col("own").alias("_own"), *[F.col(c).alias(f"_{c}") for c in names])

    def block(batch: pa.RecordBatch, i: int, prefix: str) -> dict:
        out = {c: batch.column(prefix + c)[i].values for c in columns}
        n = len(out["k"])
        return out | {v: np.frombuffer(batch.column(prefix + v)[i].as_buffer(), float).reshape(n, -1) for v in vectors}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((batch.column("own")[i].as_py(), batch, i) for batch in batches for i in range(batch.num_rows))
        for own, group in groupby(pairs, key=lambda p: p[0]):  # a task's rows come block by block
            _, batch, i = first = next(group)
            beside = ((batch.column("_own")[i].as_py() == own, block(batch, i, "_")) for _, batch, i in chain([first], group))
            yield from fold(block(batch, i, ""), beside)

    return packed.crossJoin(others.hint("shuffle_replicate_nl")).mapInArrow(run, schema)  # every block beside every block


def _matrix(rows: pa.StructArray, column: str) -> np.ndarray:
    return rows.field(column).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _same(x: pa.Array, y: pa.Array) -> np.ndarray:
    return np.array(x.to_pylist(), object)[:, None] == np.array(y.to_pylist(), object)


def silhouette(df: DataFrame, key: str = "id", vector: str = "v", label: str = "label", metric: str = "euclidean") -> DataFrame:
    """key, silhouette of every row; rows of single-member clusters get 0.

    Cosine needs no pairs: on unit rows, distances to a cluster sum to its size less the product with its
    sum.  Euclidean distances are taken block by block, and summed by cluster before anything is shuffled.
    """
    d = df.select(F.col(key).alias("k"), F.col(label).alias("c"), V.doubles(F.col(vector)).alias("v"))
    mean = _cosine_means(d) if metric == "cosine" else _euclidean_means(d)
    ab = mean.groupBy("k", "c").agg(F.min(F.when(F.col("c") == F.col("o"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("o"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select(F.col("k").alias(key), F.col("c").alias(label), s.alias("silhouette"))


def _cosine_means(d: DataFrame) -> DataFrame:
    """(k, c, o, d): mean cosine distance of each row to the other rows of each cluster."""
    d = d.withColumn("v", V.l2_normalized(F.col("v")))
    long = d.select(F.col("c").alias("o"), F.posexplode("v").alias("i", "x")).groupBy("o", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    sums = long.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"), F.max("n").alias("n"))  # one entry a dimension
    own = (F.col("c") == F.col("o")).cast("int")
    others = F.col("n") - own
    total = others - (V.dot(F.col("v"), F.col("s")) - own * V.dot(F.col("v"), F.col("v")))
    return d.crossJoin(sums).select("k", "c", "o", F.try_divide(total, others).alias("d"))  # a row for each cluster


def _euclidean_means(d: DataFrame) -> DataFrame:
    """(k, c, o, d): mean distance of each row to the other rows of each cluster."""
    kinds = dict(d.dtypes)

    def fold(x: dict, beside: Iterable[tuple[bool, dict]]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for own, y in beside:
            dist = _distances(x["v"], y["v"])
            other = np.ones(dist.shape)
            if own:  # equal keys share a block
                other = (~_same(x["k"], y["k"])).astype(float)
                dist = dist * other
            coded = y["c"].dictionary_encode()
            member = np.eye(len(coded.dictionary))[coded.indices.to_numpy()]
            for c, s, n in zip(coded.dictionary.to_pylist(), (dist @ member).T, (other @ member).T, strict=True):
                sums[c] = (sums[c][0] + s, sums[c][1] + n) if c in sums else (s, n)
            if len(sums) * len(x["k"]) > MOST_CELLS:
                yield from out(x, sums)
                sums = {}
        yield from out(x, sums)

    def out(x: dict, sums: dict) -> Iterator[pa.RecordBatch]:
        for c, (s, n) in sums.items():
            yield pa.RecordBatch.from_arrays([x["k"], x["c"], pa.array([c] * len(s), x["c"].type), pa.array(s), pa.array(n)], names=["k", "c", "o", "d", "n"])

    sums = _folded(d, ["k", "c"], ["v"], fold, f"k {kinds['k']}, c {kinds['c']}, o {kinds['c']}, d double, n double")
    return sums.groupBy("k", "c", "o").agg(F.try_divide(F.sum("d"), F.sum("n")).alias("d"))


def pair_cosines(df: DataFrame, key: str = "id", first: str = "v", second: str = "w") -> DataFrame:
    """(sa, sb): the cosine of every pair of rows in two embeddings, each pair once."""

    def fold(x: dict, beside: Iterable[tuple[bool, dict]]) -> Iterator[pa.RecordBatch]:
        for _, y in beside:
            less = np.array(x["k"].to_pylist(), object)[:, None] < np.array(y["k"].to_pylist(), object)
            sims = [(x[c] @ y[c].T)[less.astype(bool)] for c in ("v", "w")]
            yield pa.RecordBatch.from_arrays([pa.array(s) for s in sims], names=["sa", "sb"])

    d = df.select(F.col(key).alias("k"), *[V.l2_normalized(V.doubles(F.col(c))).alias(n) for c, n in ((first, "v"), (second, "w"))])
    return _folded(d, ["k"], ["v", "w"], fold, "sa double, sb double")


def _long(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(label).alias("c"), F.posexplode(V.doubles(F.col(vector))).alias("i", "x"))


def centroids(df: DataFrame, vector: str = "v", label: str = "label") -> DataFrame:
    """label, centroid (array)."""
    long = df.select(F.col(label).alias("c"), F.posexplode(V.doubles(F.col(vector))).alias("i", "x"))
    mean = long.groupBy("c", "i").agg(F.avg("x").alias("x"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])  # one entry a dimension
    return mean.groupBy("c").agg(packed.alias("centroid")).select(F.col("c").alias(label), "centroid")


def davies_bouldin(df: DataFrame, key: str = "id", vector: str = "v", label: str = "label") -> DataFrame:
    """One row: mean over clusters of the worst (s_i + s_j) / d_ij."""
    c = centroids(df, vector, label).withColumnRenamed(label, "c")
    spread = df.join(c, F.col(label) == F.col("c")).groupBy("c").agg(F.avg(V.distance(V.doubles(F.col(vector)), F.col("centroid"))).alias("s"))
    k = c.join(spread, "c")
    x, y = k.alias("x"), k.alias("y")
    ratio = F.try_divide(F.col("x.s") + F.col("y.s"), V.distance(F.col("x.centroid"), F.col("y.centroid")))
    worst = x.join(y, F.col("x.c") != F.col("y.c")).groupBy(F.col("x.c")).agg(F.max(F.coalesce(ratio, F.lit(0.0))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, key: str = "id", vector: str = "v", label: str = "label") -> DataFrame:
    """One row: between over within sum of squares, each over its degrees of freedom."""
    long = _long(df, key, vector, label)
    cluster = long.groupBy("c", "i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = cluster.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    parts = cluster.join(whole, "i")
    sums = parts.agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("b"), F.sum(F.col("q") - F.col("n") * F.col("m") ** 2).alias("w"), F.countDistinct("c").alias("k"),
        F.max("i").alias("last"), F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"),
    )
    n, k = F.col("n"), F.col("k")
    return sums.select(F.try_divide(F.col("b") * (n - k), F.col("w") * (k - 1)).alias("calinski_harabasz"))


def contingency(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """[by], ari: 1 for equal partitions (also for two that are trivial alike)."""
    by = list(by)
    c = contingency(df, a, b, by)
    rows = c.groupBy(*by, a).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("sa"))
    cols = c.groupBy(*by, b).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("sb"))
    cells = c.groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    d = cells.join(rows, by).join(cols, by) if by else cells.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.coalesce(F.try_divide(F.col("sa") * F.col("sb"), _pairs(F.col("n"))), F.lit(0.0))
    most = (F.col("sa") + F.col("sb")) / 2
    return d.select(*by, F.when(most == expected, 1.0).otherwise(F.try_divide(F.col("s") - expected, most - expected)).alias("ari"))


def normalized_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information over the mean of the entropies; 1 for two trivial partitions."""
    c = contingency(df, a, b)
    total = c.agg(F.sum("n").alias("t"))
    rows, cols = c.groupBy(a).agg(F.sum("n").alias("ra")), c.groupBy(b).agg(F.sum("n").alias("cb"))
    d = c.join(rows, a).join(cols, b).crossJoin(F.broadcast(total))  # one row
    n, t = F.col("n"), F.col("t")
    mi = d.agg(F.sum(n / t * F.log(n * t / (F.col("ra") * F.col("cb")))).alias("mi"))
    ha = rows.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("ra") / t * F.log(F.col("ra") / t))).alias("ha"))
    hb = cols.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("cb") / t * F.log(F.col("cb") / t))).alias("hb"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return mi.crossJoin(ha).crossJoin(hb).select(F.when(mean == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("mi") / mean)).alias("nmi"))


def tfidf(df: DataFrame, key: str = "id", text: str = "text", min_df: int = 2, max_features: int | None = None, stop: list[str] = ()) -> DataFrame:
    """(key, term, w): raw counts times ln((1 + n) / (1 + df)) + 1, rows of unit length.

    Terms are runs of two or more letters or digits in lower case; of ``max_features`` terms the most
    frequent stay (ties: first in the alphabet).  Texts without a term give no rows.
    """
    return _weighted(df, key, _words(F.col(text), stop), min_df, max_features)


def ngram_tfidf(
    df: DataFrame, key: str = "id", text: str = "text", words: tuple[int, int] = (1, 2), chars: tuple[int, int] = (3, 5),
    min_df: int = 2, max_features: int | None = None, stop: list[str] = (),
) -> DataFrame:
    """(key, term, w): weights of word n-grams (terms "w:...") beside those of character n-grams within words ("c:..."), each part of unit length."""
    own = _words(F.col(text), stop)
    runs = F.flatten(F.transform(F.sequence(F.lit(words[0]), F.lit(words[1])), lambda n: _joined_runs(own, n)))
    by_word = _weighted(df, key, runs, min_df, max_features)
    by_char = _weighted(df, key, _chars(F.col(text), *chars), min_df, max_features)
    tagged = lambda d, t: d.withColumn("term", F.concat(F.lit(t), "term"))
    return tagged(by_word, "w:").unionByName(tagged(by_char, "c:"))


def _words(text: Column, stop: list[str] = ()) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words


def _joined_runs(words: Column, n: Column) -> Column:
    """Runs of n words, joined by spaces."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _chars(text: Column, least: int, most: int) -> Column:
    """Runs of ``least`` to ``most`` characters of each word between two spaces; a word that is no longer than a run gives itself, once."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def of(w: Column, n: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, n))
        return F.when((n == least) | (F.length(w) >= n), runs).otherwise(F.array().cast("array<string>"))

    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: of(w, n)))))


def _weighted(df: DataFrame, key: str, terms: Column, min_df: int, max_features: int | None) -> DataFrame:
    """(key, term, w) of arrays of terms."""
    tf = df.select(F.col(key).alias("k"), F.explode(terms).alias("term")).groupBy("k", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).filter(F.col("df") >= min_df)
    if max_features:
        terms = terms.orderBy(F.desc("cf"), "term").limit(max_features)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    idf = terms.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    raw = tf.join(idf, "term").select("k", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, "k").select(F.col("k").alias(key), "term", (F.col("w") / F.col("len")).alias("w"))


def coherence(weights: DataFrame, labels: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """One row: mean cosine of each row with its cluster's centroid, over all rows of ``labels``; a row without terms counts 0.

    With s the sum of a cluster's rows and u that of its rows at unit length, its cosines sum to u . s / |s|:
    no centroid is joined back.
    """
    n = labels.agg(F.count(F.lit(1)).alias("n"))
    length = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    own = weights.join(labels.select(key, label), key).join(length, key)
    sums = own.groupBy(label, "term").agg(F.sum("w").alias("w"), F.sum(F.try_divide(F.col("w"), F.col("len"))).alias("u"))
    total = sums.groupBy(label).agg(F.try_divide(F.sum(F.col("u") * F.col("w")), F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("s")).agg(F.sum("s").alias("s"))
    return total.crossJoin(n).select((F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("coherence"))  # one row each


def nearest(df: DataFrame, k: int, key: str = "id", vector: str = "v", metric: str = "cosine") -> DataFrame:
    """(key, other, sim, rk): the k most similar other rows (ties: least key); ``metric`` cosine, dot or euclidean (sim is then less the distance).

    A task keeps k for each of its rows over all the blocks that it reads; these are ranked at the end, not all pairs.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    v = V.doubles(F.col(vector))
    d = df.select(F.col(key).alias("k"), (V.l2_normalized(v) if metric == "cosine" else v).alias("v"))
    kind, similar = dict(d.dtypes)["k"], METRICS[metric]

    def fold(x: dict, beside: Iterable[tuple[bool, dict]]) -> Iterator[pa.RecordBatch]:
        n = len(x["k"])
        best, bound = None, np.full(n, -np.inf)
        for own, y in beside:
            sim = similar(x["v"], y["v"])
            if not np.isfinite(sim.sum()):
                sim[~np.isfinite(sim)] = -np.inf
            if own:
                sim[_same(x["k"], y["k"])] = -np.inf
            if sim.shape[1] > k:
                at_least = np.partition(sim, -k, axis=1)[:, -k] if best is None else bound
            else:
                at_least = bound
            # a margin beyond the ninth digit, to which similarities are rounded
            i, j = np.nonzero((sim >= np.maximum(at_least, bound)[:, None] - 1e-8) & (sim > -np.inf))
            if not len(i):
                continue
            found = pa.table({"row": i, "less": -np.round(sim[i, j], 9), "other": y["k"].take(pa.array(j))})
            best = found if best is None else pa.concat_tables([best, found])
            best = best.take(pc.sort_indices(best, [("row", "ascending"), ("less", "ascending"), ("other", "ascending")]))
            rows = best["row"].to_numpy()
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            last = place == k - 1
            bound[rows[last]] = -best["less"].to_numpy()[last]
            best = best.filter(pa.array(place < k))
        if best is not None:
            best = best.combine_chunks()
            for part in best.to_batches():
                sim = pa.array(-part["less"].to_numpy() + 0.0)
                yield pa.RecordBatch.from_arrays([x["k"].take(part["row"]), part["other"], sim], names=["k", "other", "sim"])

    found = _folded(d, ["k"], ["v"], fold, f"k {kind}, other {kind}, sim double")
    rk = F.row_number().over(W.partitionBy("k").orderBy(F.desc("sim"), "other"))
    return found.withColumn("rk", rk).filter(F.col("rk") <= k).withColumnRenamed("k", key)


METRICS = {
    "cosine": lambda a, b: a @ b.T,
    "dot": lambda a, b: a @ b.T,
    "euclidean": lambda a, b: -_distances(a, b),
}


def auc_ap(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve (ties count half) and average precision (ties share a threshold)."""
    by = df.groupBy((-F.col(score)).alias("s")).agg(F.sum(label).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    c = ranking.running(by, "s", {"tp": "p", "all": "n"})
    fp_here = F.col("n") - F.col("p")
    sums = c.agg(
        F.sum(fp_here * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("ap"),
        F.sum("p").alias("pos"), F.sum(fp_here).alias("neg"),
    )
    return sums.select(F.try_divide(F.col("area"), F.col("pos") * F.col("neg")).alias("auc"), F.try_divide(F.col("ap"), F.col("pos")).alias("ap"))
