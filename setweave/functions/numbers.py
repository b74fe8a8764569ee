"""Scalar numeric functions: set similarity, guarded ratios, weights and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def guarded(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or ``default`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default).cast("double"))


def jaccard(overlap: Column, n1: Column, n2: Column) -> Column:
    return guarded(overlap, n1 + n2 - overlap)


def simpson(overlap: Column, n1: Column, n2: Column) -> Column:
    return guarded(overlap, F.least(n1, n2))


def composite(overlap: Column, n1: Column, n2: Column, alpha: float = 0.8) -> Column:
    """alpha * Jaccard + (1 - alpha) * overlap coefficient."""
    return alpha * jaccard(overlap, n1, n2) + (1 - alpha) * simpson(overlap, n1, n2)


def overlap_pct(overlap: Column, n1: Column, n2: Column) -> Column:
    return F.round(guarded(100 * overlap, F.greatest(n1, n2)), 1)


def weight(w: Column, how: str = "log1p") -> Column:
    """log1p, sqrt or none, of a weight that is at least 0."""
    w = F.greatest(w, F.lit(0.0))
    return {"log1p": F.log1p(w), "sqrt": F.sqrt(w), "none": w}[how]


def scaled_year(year: Column) -> Column:
    return F.coalesce((year - 1990) / 40, F.lit(0.0))


def pair_key(u: Column, v: Column, n: int) -> Column:
    return F.least(u, v) * n + F.greatest(u, v)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce_with_logits(x: Column, y: Column) -> Column:
    """max(x, 0) - x y + log(1 + exp(-|x|))."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def neg_log10(q: Column) -> Column:
    return -F.log10(F.greatest(q, F.lit(1e-300)))


def pct_diff(ref: Column, new: Column) -> Column:
    return F.when(F.abs(ref) < 1e-12, F.abs(new - ref) * 100).otherwise(F.abs(new - ref) / F.abs(ref) * 100)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def parse_range(text: str) -> list[int]:
    """"2,5,10-50 step 10" as a list of numbers."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        span, _, step = part.partition("step")
        low, dash, high = span.strip().partition("-")
        out += range(int(low), int(high) + 1, int(step or 1)) if dash else [int(low)]
    return out
