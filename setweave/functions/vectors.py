"""Vector functions on array columns; everything is done in doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(v: Column) -> Column:
    """v over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def scaled(v: Column, c: float) -> Column:
    return F.transform(v, lambda x: x * c)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def merged(a: Column, b: Column, how: str = "weighted", share: float = 0.5, cut_dim: int | None = None, normalize: str = "none") -> Column:
    """Two embeddings as one; ``normalize`` (none, emb1, emb2, both) first gives that side unit length.

    weighted: share * a + (1 - share) * b of whole vectors, null for different lengths.  concatenate:
    share * a, cut to ``cut_dim``, next to (1 - share) * b.  graph_base: b.  density_base: a, cut.
    """
    if normalize not in ("none", "emb1", "emb2", "both"):
        raise ValueError("normalize must be one of none, emb1, emb2, both")
    first = (lambda v: l2_normalized(v)) if normalize in ("emb1", "both") else (lambda v: v)
    short = first(F.slice(a, 1, cut_dim) if cut_dim else a)
    second = l2_normalized(b) if normalize in ("emb2", "both") else b
    ways = {
        "weighted": lambda: F.when(F.size(a) == F.size(b), added(scaled(first(a), share), scaled(second, 1 - share))),
        "concatenate": lambda: F.concat(scaled(short, share), scaled(second, 1 - share)),
        "graph_base": lambda: second,
        "density_base": lambda: short,
    }
    if how not in ways:
        raise ValueError(f"unknown merge {how!r}; one of {', '.join(ways)}")
    return ways[how]()
