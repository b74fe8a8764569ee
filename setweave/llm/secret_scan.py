"""Secret scans behind a trigram inverted index (operator 6), in DataFrame functions only.

From the syntax tree of each rule's regular expression a Boolean trigram query is derived: an OR of
literal strings, each an AND of its trigrams.  Postings (trigram, document) are kept for the
trigrams that some query names; intersecting them gives each document's candidate rules, which
alone are then run on it.  A rule without a mandatory trigram runs on every document.
"""

from __future__ import annotations

import itertools
from re import _constants as C, _parser as P

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import shared

# Rule -> (pattern, group whose length counts, least length); the first three are the base.
RULES = {
    "assign": (r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    "google": (r"AIza[A-Za-z0-9_-]{35}", 0, 39),
}
BASE = ("assign", "access", "hex")
#: A literal stretch is cut where it would have more alternatives than this.
MOST_STRINGS = 96


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match satisfies; [] if nothing is mandatory."""
    best: list[frozenset[str]] = []
    for strings in _stretches(P.parse(pattern)):
        if all(len(s) >= 3 for s in strings):
            query = list({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})
            # the stretch whose weakest alternative has the most trigrams prunes best
            if not best or min(map(len, query)) > min(map(len, best)):
                best = query
    return best


def _stretches(tree) -> list[set[str]]:
    """Sets of strings, each set holding one string that occurs in any match."""
    out, now = [], {""}
    for op, arg in tree:
        options = _strings(op, arg)
        if options and len(now) * len(options) <= MOST_STRINGS:
            now = {a + b for a, b in itertools.product(now, options)}
            continue
        out.append(now)
        now = options or {""}
        if not options and op is C.SUBPATTERN:
            out += _stretches(arg[-1])
        elif not options and op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            out += _stretches(arg[2])
    return [*out, now]


def _strings(op, arg) -> set[str] | None:
    """All strings (lower case) that a node matches, or None if they are too many."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        got = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                got.add(chr(x).lower())
            else:
                return None
        return got
    if op is C.SUBPATTERN:
        return _product(arg[-1])
    if op is C.BRANCH:
        parts = [_product(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 1:
        inner = _product(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _product(tree) -> set[str] | None:
    now = {""}
    for op, arg in tree:
        options = _strings(op, arg)
        if options is None or len(now) * len(options) > MOST_STRINGS:
            return None
        now = {a + b for a, b in itertools.product(now, options)}
    return now


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id) for each of ``grams`` that a text holds in lower case: the inverted index."""
    d = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]))
    return d.select("doc_id", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: dict[str, tuple[str, int, int]]) -> DataFrame | None:
    """doc_id and the rules whose trigram query its postings satisfy; None if no rule has a query."""
    queries = {k: trigram_query(r[0]) for k, r in rules.items()}
    rows = [(k, n, g, len(c)) for k, q in queries.items() for n, c in enumerate(q) for g in c]
    if not rows:
        return None
    spark = docs.sparkSession
    clauses = spark.createDataFrame(rows, "rule string, clause int, gram string, needed int")
    index = postings(docs, sorted({r[2] for r in rows}))
    # as many rows as the rules have trigrams, whatever the corpus: bounded, so broadcast
    met = index.join(F.broadcast(clauses), "gram").groupBy("doc_id", "rule", "clause", "needed").agg(F.countDistinct("gram").alias("found"))
    return met.filter(F.col("found") == F.col("needed")).groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """start, end (code points, end exclusive) of the leftmost non-overlapping matches that are long enough.

    Matches are fenced with \\x01, which no pattern can match; one in the text itself becomes \\x02.
    """
    fenced = F.regexp_replace(F.translate(text, "\x01", "\x02"), f"({pattern})", "\x01$1\x01")
    sized = F.length if group == 0 else lambda m: F.length(F.regexp_extract(m, pattern, group))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(state, part):
        end = state["at"] + F.length(part)
        hit = state["inside"] & (sized(part) >= least)
        return F.struct(
            end.alias("at"),
            (~state["inside"]).alias("inside"),
            F.when(hit, F.concat(state["found"], F.array(F.struct(state["at"].alias("start"), end.alias("end"))))).otherwise(state["found"]).alias("found"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("found"))
    found = F.aggregate(F.split(fenced, "\x01"), start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def scan(docs: DataFrame, rules: dict[str, tuple[str, int, int]] | None = None) -> DataFrame:
    """doc_id and one array of (start, end) for each rule, of every row.

    A null text counts as empty; repeated rows and repeated ids are scanned each (their candidate
    rules are pooled, which costs a scan but changes no result); null ids are matched null-safely;
    an empty table gives an empty one; other columns aren't read.
    """
    rules = rules or RULES
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = candidates(d, rules)
    if found is None:
        d = d.withColumn("rules", F.lit(None).cast("array<string>"))
    else:
        found = found.withColumnRenamed("doc_id", "found_id")
        d = d.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    out = []
    for name, (pattern, group, least) in rules.items():
        spans = matches(F.col("text"), pattern, group, least)
        if trigram_query(pattern):
            wanted = F.coalesce(F.array_contains("rules", name), F.lit(False))
            spans = F.when(wanted, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        out.append(spans.alias(name))
    return d.select("doc_id", *out)


def _joined(names: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""
    def labelled(n: int, k: str) -> Column:
        return F.transform(F.col(k), lambda x: F.struct(x["start"].alias("s"), F.lit(n).alias("n"), F.lit(k).alias("k"), x["end"].alias("e")))

    parts = [labelled(n, k) for n, k in enumerate(names)]
    return F.array_join(F.transform(F.sort_array(F.concat(*parts)), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(shared.read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(BASE), 256).alias("base_sha256"),
        _joined(tuple(RULES)).alias("spans"),
    )


def _sql() -> str:
    """The same spans from DuckDB, which runs every rule on every text."""
    rules = [(n, k, p.replace("'", "''"), g, least) for n, (k, (p, g, least)) in enumerate(RULES.items())]
    runs = " UNION ALL ".join(
        f"SELECT rid, {n} AS n, '{k}' AS k, {least} AS least, "
        f"string_split(regexp_replace(text, '({p})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM t WHERE regexp_matches(text, '{p}')"
        for n, k, p, g, least in rules
    )
    sized = " ".join(f"WHEN {n} THEN length(" + (f"regexp_extract(part, '{p}', {g})" if g else "part") + ")" for n, _, p, g, _ in rules)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS text FROM documents),
m AS ({runs}),
e AS (SELECT rid, n, k, least, parts[i] AS part, i, coalesce(list_sum(list_transform(parts[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
      FROM m, unnest(range(1, len(parts) + 1)) r(i)),
f AS (SELECT rid, n, k, s, s + length(part) AS e FROM e WHERE i % 2 = 0 AND CASE n {sized} END >= least),
a AS (SELECT rid, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
        string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, n) FILTER (n < 3) AS base,
        string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, n) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (rid)
"""


SQL = _sql()
