"""Scalar text functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_text(x: Column) -> Column:
    """Trimmed text; null and any spelling of "nan" become ""."""
    t = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def split_values(x: Column, pattern: str = ";") -> Column:
    """Distinct trimmed non-empty parts, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), pattern), lambda v: F.trim(v)), lambda v: v != ""))


def split_any(x: Column) -> Column:
    """Parts between semicolons, bars, commas and white space."""
    return split_values(x, r"[;|,\s]+")


def primary_value(x: Column) -> Column:
    return F.get(split_any(x), F.lit(0))


def parse_pmids(x: Column) -> Column:
    return split_values(F.translate(x, ";", ","), ",")


def clean_text(x: Column) -> Column:
    """Without GSE accessions and digits; underscores and hyphens as spaces; single-spaced, lower case."""
    t = F.regexp_replace(to_text(x), r"(?i)GSE\d+", " ")
    t = F.regexp_replace(F.translate(t, "_-", "  "), r"\d+", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def concat_nonempty(*columns: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(to_text(c), F.lit("")) for c in columns])


def truncated(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def strip_quotes(x: Column) -> Column:
    return F.btrim(x, F.lit("\"'"))


def strip_term_suffix(x: Column) -> Column:
    """Without a trailing " (GO:0000000)"."""
    return F.regexp_replace(x, r"\s*\(GO:\d+\)\s*$", "")


def parse_year(x: Column) -> Column:
    """Mean of the four-digit tokens of a ; or | list, else null."""
    years = F.filter(F.transform(F.split(F.translate(x, "|", ";"), ";"), lambda v: F.trim(v)), lambda v: v.rlike(r"^\d{4}$"))
    total = F.aggregate(years, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return F.when(F.size(years) > 0, total / F.size(years))


def safe_float(x: Column, default: float = 0.0) -> Column:
    v = F.expr("try_cast(x as double)") if isinstance(x, str) else x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(v)


def pipe_joined(x: Column) -> Column:
    return F.concat_ws("|", x)


def html_escaped(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def first_of(x: Column, n: int) -> Column:
    """The first n entries of a list."""
    return F.slice(x, 1, n)


def formatted(value: Column, name: Column) -> Column:
    """A number as text by its column's name: three digits for shares, four for densities, two and a cross for ratios, else one; a dash for none."""
    share = name.contains("pct") | name.startswith("cov_")
    fine = name.contains("density") | name.contains("clustering")
    text = (
        F.when(share, F.format_string("%.3f", value)).when(fine, F.format_string("%.4f", value))
        .when(name.contains("ratio"), F.format_string("%.2f\u00d7", value)).otherwise(F.format_number(value, 1))
    )
    return F.when(value.isNull() | F.isnan(value), "\u2014").otherwise(text)
