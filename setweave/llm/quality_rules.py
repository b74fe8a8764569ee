"""Quality rules and host verdicts (operator 10), in DataFrame functions only.

Each document is measured in its own row.  Rule failures are then summed by host, each host's
failure rates are shrunk towards the other hosts' with a beta prior that is fitted to those by
moments, and hosts whose shrunk rate is far out in that prior's upper tail lose all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import shared

SYMBOLS = "#*$%&|<>"
#: A host falls beyond the prior's mean and so many of its deviations; but never under the first rate, always over the second.
DEVIATIONS, LEAST_RATE, MOST_RATE = 3.0, 0.25, 0.6
#: Weight of the prior, in documents, where the hosts' rates don't vary enough to fit one.
DEFAULT_WEIGHT = 10.0
#: A hot host's rows are dealt over so many keys in the join.
SALTS = 32


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row.

    A null text counts as empty.  Windows are first compared by 64-bit hash; only texts that have
    two equal hashes compare the windows' words, so a collision can't change a count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), text.alias("text"))
    bare = F.btrim(F.col("text"), F.lit(shared.WHITESPACE))
    d = d.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, shared.WORD_SPLIT)))
    d = d.withColumn("lines", F.filter(F.split(F.col("text"), "\n"), lambda x: F.btrim(x, F.lit(shared.WHITESPACE)) != ""))
    at = lambda i, k: F.get(F.col("words"), i + k)
    d = d.withColumn(
        "hashes",
        F.when(
            F.size("words") >= 5,
            F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    windows = F.transform(F.col("hashes"), lambda _, i: F.struct(F.array_join(F.slice(F.col("words"), i + 1, 5), " ").alias("w"), i.alias("i")))
    beside = lambda a, x, i: F.get(a, i)["w"].eqNullSafe(x["w"])
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    twice = let(
        F.sort_array(windows),
        lambda a: F.filter(a, lambda x, i: (F.when(i > 0, beside(a, x, i - 1)).otherwise(False)) | beside(a, x, i + 1)),
    )
    positions = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = let(
        positions,
        lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b),
    )
    return d.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), shared.WHITESPACE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def rule_columns() -> dict[str, Column]:
    n, r, s = F.col("n_words"), F.col("n_repeat_words"), F.col("n_symbols")
    return {
        "short": n < 10,
        "repeated": 100 * r > 20 * n,
        "symbols": 10 * s > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, host_docs, and for each rule its shrunk rate and limit; ``host_ok`` false if a rate is over its limit.

    A host's prior is fitted to all other hosts, so that a bad one doesn't excuse itself: their mean m
    over documents and the weight m(1-m)/v - 1, v being the variance of their own rates.  A null host
    is a host like any other; a single host is judged by a prior of its own mean.
    """
    rules = rule_columns()
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *[F.sum(c.cast("long")).alias(f"f_{k}") for k, c in rules.items()])
    rate = lambda k: F.col(f"f_{k}") / F.col("host_docs")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("host_docs").alias("docs"),
        *[x for k in rules for x in (F.sum(f"f_{k}").alias(f"a_{k}"), F.sum(rate(k)).alias(f"r_{k}"), F.sum(rate(k) * rate(k)).alias(f"q_{k}"))],
    )
    joined = hosts.crossJoin(F.broadcast(sums))  # one row
    several, out, bad = F.col("hosts") > 1, [], F.lit(False)
    others = F.when(several, F.col("hosts") - 1).otherwise(1)
    for k in rules:
        left = lambda whole, own: F.when(several, F.col(whole) - own).otherwise(F.col(whole))
        m = left(f"a_{k}", F.col(f"f_{k}")) / left("docs", F.col("host_docs"))
        first, second = left(f"r_{k}", rate(k)) / others, left(f"q_{k}", rate(k) * rate(k)) / others
        v = F.greatest(second - first * first, F.lit(0.0))
        weight = F.when((v > 1e-9) & (m * (1 - m) / v > 1), m * (1 - m) / v - 1).otherwise(F.lit(DEFAULT_WEIGHT))
        shrunk = (F.col(f"f_{k}") + m * weight) / (F.col("host_docs") + weight)
        limit = F.least(F.lit(MOST_RATE), F.greatest(F.lit(LEAST_RATE), m + DEVIATIONS * F.sqrt(v)))
        out += [shrunk.alias(f"rate_{k}"), limit.alias(f"limit_{k}")]
        bad = bad | (F.col(f"rate_{k}") > F.col(f"limit_{k}"))
    return joined.select("host", "host_docs", *out).withColumn("host_ok", ~bad)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures, base_failed and kept of every row of ``docs`` (needs doc_id, text and the host column).

    Repeated rows are judged each; an empty table gives an empty one; other columns aren't read.
    """
    rows = shared.materialize(measure(docs, host), "quality")
    bad = host_verdicts(rows).filter(~F.col("host_ok")).select(F.col("host").alias("bad_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("bad_salt"))
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    rules = rule_columns()
    d = rows.withColumn("salt", salt).withColumn("base_failed", rules["short"] | rules["repeated"])
    d = d.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("bad_salt").isNull()).alias("kept"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(shared.read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS win FROM w, unnest(range(1, len(words) - 3)) r(i)),
dup AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, unnest(range(0, 5)) s(k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, host, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2, 10 * n_symbols > n_words AS r3,
             10 * n_dup_lines > 3 * n_lines AS r4 FROM m),
h AS (SELECT host, count(*) AS n, unnest([sum(r1::INT), sum(r2::INT), sum(r3::INT), sum(r4::INT)]) AS f, unnest([1, 2, 3, 4]) AS k FROM r GROUP BY host),
p AS (SELECT h.*, (SELECT sum(f) FROM h o WHERE o.k = h.k AND o.host IS DISTINCT FROM h.host) / (SELECT sum(n) FROM h o WHERE o.k = h.k AND o.host IS DISTINCT FROM h.host) AS others,
             (SELECT var_pop(f / n) FROM h o WHERE o.k = h.k AND o.host IS DISTINCT FROM h.host) AS spread FROM h),
s AS (SELECT host, n, f, coalesce(others, f / n) AS mean, coalesce(spread, 0) AS v FROM p),
bad AS (SELECT DISTINCT host FROM (SELECT *, CASE WHEN v > 1e-9 AND mean * (1 - mean) / v > 1 THEN mean * (1 - mean) / v - 1 ELSE 10 END AS wt FROM s)
        WHERE (f + mean * wt) / (n + wt) > least(0.6, greatest(0.25, mean + 3 * sqrt(v))))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r1 OR r2) AS base_failed,
       NOT (r1 OR r2) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.host IS NOT DISTINCT FROM r.host) AS kept
FROM r
"""
