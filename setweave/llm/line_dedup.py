"""Line removal by an exact set-similarity join (operator 4), in DataFrame functions only.

Lines of equal words (A-Z and others in lower case) are one class; of fewer than five words, nothing
else is alike.  A longer line's tokens are its five-word shingles.  Two passes find the lines of Jaccard
0.75 or more.

The first finds the lines that may be alike another, with no shingle computed.  If two lines share a
shingle, one has at most as many distinct grams (runs of GRAM words) that the other lacks as it has such
shingles: each gram before the shared one begins a shingle that the other lacks, each after it ends one,
and by first places no two of these are the same.  Of n shingles a line of a pair has at most n / 4 that
the other lacks.  So in any fixed order of grams, SHARED grams of a pair (one, if a line has too few)
are among the first n / 4 + SHARED of both.  The order takes grams that begin with a long word first,
then goes by hash.  A line of which other lines' first grams hold fewer than SHARED (none, if it has
fewer than n / 4 + SHARED in all) is alike no other.

Only the rest have their shingles computed.  These are ordered by rarity: by how often the first word's
hash bucket occurs in these lines (a shingle is no more frequent than its words), then by hash.  Pairs
meet in the first n - ceil(0.75 n) + SHARED, must also pass the length and positional bounds, and are
then verified on their whole token sets.  A line goes if it is alike an earlier one.

Each line is first held against two others: the one that most often is the earliest of its tokens,
and the one that most often is their hub (the line with the most widely shared tokens, such as the
original of a group of copies).  That settles groups of copies without a row for each pair.  Only
lines that this leaves open meet earlier ones, and only those whose token bitmaps differ in few
enough bits: each differing bit is a token that one of the two lacks, so the bound loses no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import pieces, shared

#: Words of a shingle.
WORDS = 5
#: Words of a gram, at most WORDS, and the letters of a first word that is long.
GRAM = 4
LONG = 6
#: Buckets of the word counts: a table of this many bytes, whatever the corpus.
BUCKETS = 1 << 14
#: Tokens that a pair's prefixes must have in common.
SHARED = 3
#: Longs of a line's token bitmap.
BITMAP = 4
#: Lines of one token, on the side that has fewer, up to which its pairs are made.
FEW = 64
#: Open lines of one token that a task compares with that token's others.
BLOCK = 1000


def _odd(low: Column, *more: str) -> Column:
    """Whether white space is other than one space between words."""
    odd = low.startswith(" ") | low.endswith(" ")
    for c in ("  ", *more):
        odd = odd | low.contains(c)
    return odd


def normal_lines(numbered: DataFrame) -> DataFrame:
    """(id, t) of the lines of (no, text) that have a word: in lower case, words one space apart.

    Documents, then lines, that are so already are spared the pattern.
    """
    others = [c for c in shared.WHITESPACE[1:] if c != "\n"]
    d = numbered.select("no", F.lower("text").alias("low"))
    d = d.select("no", "low", _odd(F.col("low"), " \n", "\n ", *others).alias("odd"))  # on its own, or each line would look through the document
    d = d.select("no", "odd", F.posexplode(F.split("low", "\n")).alias("place", "x"))
    t = F.when(F.col("odd") & _odd(F.col("x"), *others), F.btrim(F.regexp_replace("x", shared.WORD_SPLIT, " "))).otherwise(F.col("x"))
    return d.select(pieces.piece_id(F.col("no"), F.col("place")).alias("id"), t.alias("t")).filter("t <> ''")


def _grams_after(first: str) -> Column:
    """Hashes of the distinct grams of t whose first word is ``first``, in order."""
    pattern = f" (?=({first}{' [^ ]++' * (GRAM - 1)}))"
    found = F.regexp_extract_all(F.concat(F.lit(" "), F.col("t")), F.lit(pattern), 1)
    return F.sort_array(F.array_distinct(F.transform(found, lambda g: F.xxhash64(g))))


def first_grams(lines: DataFrame) -> DataFrame:
    """(id, k, k2, grams, full): a key of 128 bits, the line's first grams (null under WORDS words), and whether they are as many as wanted."""
    n = F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" "), F.lit(""))) + 2 - WORDS  # shingles, repeats counted
    d = lines.select("id", "t", F.xxhash64("t").alias("k"), F.xxhash64(F.lit(WORDS), "t").alias("k2"), F.when(n > 0, F.floor(n / 4).cast("int")).alias("most"))
    d = d.select("*", F.when(F.col("most").isNotNull(), _grams_after(f"[^ ]{{{LONG},}}+")).alias("long"))  # most: grams that a line that is alike can lack
    every = F.concat("long", _grams_after(f"[^ ]{{1,{LONG - 1}}}+"))
    grams = F.slice(F.when(F.size("long") >= F.col("most") + SHARED, F.col("long")).otherwise(every), F.lit(1), F.col("most") + SHARED)
    d = d.select("id", "k", "k2", "most", F.when(F.col("most").isNotNull(), grams).alias("grams"))
    return d.select("id", "k", "k2", "grams", (F.size("grams") == F.col("most") + SHARED).alias("full"))


def may_be_alike(table: DataFrame, copies: DataFrame) -> DataFrame:
    """id of the lines that hold enough grams of other lines; the lines of equal words are left out but for the first."""
    rows = shared.rows_without(table.filter("grams is not null").select("id", "full", "grams"), copies, "id")
    signed = F.when(F.col("full"), F.bitwise_not("id")).otherwise(F.col("id"))  # below 0 if SHARED grams are needed, else one
    rows = rows.select(signed.alias("line"), F.explode("grams").alias("gram"))
    same = Window.partitionBy("gram")  # one exchange; a hot gram's rows are passed through, spilled if need be
    met = rows.select("line", F.min("line").over(same).alias("a"), F.max("line").over(same).alias("b")).filter("a < b")
    held = met.groupBy("line").agg(F.count(F.lit(1)).alias("c")).filter((F.col("line") >= 0) | (F.col("c") >= SHARED))
    return shared.materialize(held.select(F.when(F.col("line") < 0, F.bitwise_not("line")).otherwise(F.col("line")).alias("id")), "open")


def _bucket(word_hash: Column) -> Column:
    return word_hash.bitwiseAND(BUCKETS - 1).cast("int")


def word_classes(lines: DataFrame) -> bytes:
    """For each bucket of words, a byte that grows with the logarithm of its count over these lines."""
    words = lines.select(F.explode(F.split("t", " ")).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.least(F.lit(127), F.round(F.log2(F.count(F.lit(1))) * 3)).cast("int").alias("c"))
    table = bytearray(BUCKETS)
    for row in counts.collect():  # at most BUCKETS rows
        table[row["b"]] = row["c"]
    return bytes(table)


def token_sets(lines: DataFrame, classes: bytes) -> DataFrame:
    """(id, tokens): distinct tokens of every line, rarest first; a token is its class byte and 56 bits of its hash."""
    rarity = F.lit(classes)

    def tokens(words: Column) -> Column:
        def token(i: Column) -> Column:
            own = F.ascii(F.substring(rarity, _bucket(F.get(words, i)) + 1, F.lit(1)).cast("string"))
            h = F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])
            return F.coalesce(F.shiftleft(own.cast("long"), 56).bitwiseOR(h.bitwiseAND((1 << 56) - 1)), F.lit(0).cast("long"))

        made = F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), token)
        return F.when(F.size(words) >= WORDS, made).otherwise(F.array().cast("array<bigint>"))

    hashes = F.transform(F.split("t", " "), lambda w: F.xxhash64(w))
    return lines.select("id", F.sort_array(F.array_distinct(pieces.let(hashes, tokens))).alias("tokens"))


def _least_overlap(n: Column) -> Column:
    """ceil(3n/4): what a line of n tokens has in common with any line that is alike."""
    return F.floor((n * 3 + 3) / 4).cast("int")


def prefixes(sets: DataFrame) -> DataFrame:
    """(id, n, prefix): how many tokens each line has, and the first n - ceil(3n/4) + SHARED of them."""
    n = F.size("tokens")
    length = n - _least_overlap(n) + F.least(F.lit(SHARED), _least_overlap(n))
    return sets.select("id", n.alias("n"), F.slice("tokens", F.lit(1), length).alias("prefix"))


def _can_match(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Length bound, and positional bound: of two lines that share the tokens at ``at`` and ``to``, at most so many more."""
    most = F.least(at, to) + F.least(n - at, m - to)
    return _lengths(n, m) & (7 * most >= 3 * (n + m))


def _lengths(n: Column, m: Column) -> Column:
    return 4 * F.least(n, m) >= 3 * F.greatest(n, m)


def _bitmap(tokens: Column) -> Column:
    """BITMAP longs in which each token sets one bit."""

    def word(w: Column) -> Column:
        own = F.filter(tokens, lambda t: F.pmod(t, F.lit(BITMAP)) == w)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(_bit(t)))

    return F.transform(F.sequence(F.lit(0), F.lit(BITMAP - 1)), word)


def _bit(t: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 8).bitwiseAND(63).cast("int"))


def _few_differ(x: str, y: str, n: Column, m: Column) -> Column:
    """At Jaccard 3/4 or more two sets differ in at most a seventh of their sizes' sum."""
    bits = [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(BITMAP)]
    return 7 * sum(bits[1:], bits[0]) <= n + m


def _most_often(rows: DataFrame) -> DataFrame:
    """(id, x): of the earlier lines x of fitting length that stand beside a line's tokens, the one that does so most often."""
    fit = rows.filter((F.col("id") > F.col("x")) & _lengths(F.col("n"), F.col("m")))
    counts = fit.groupBy("id", "x").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("id").agg(F.max_by("x", F.struct(F.col("c"), -F.col("x"))).alias("x"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """id of the pairs' (x earlier, id) later lines whose token sets have 4 |x & y| >= 3 |x | y|."""
    left, right = sets.select("id", F.col("tokens").alias("s")), sets.select(F.col("id").alias("x"), F.col("tokens").alias("t"))
    both = pairs.join(left, "id").join(right, "x").withColumn("o", F.size(F.array_intersect("s", "t")))
    return shared.materialize(both.filter(7 * F.col("o") >= 3 * (F.size("s") + F.size("t"))).select("id").distinct(), "later")


def _copies(table: DataFrame) -> DataFrame:
    """id of every line whose words an earlier one has, by a 128-bit key."""
    firsts = table.groupBy("k", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    firsts = shared.materialize(firsts, "copied")
    out = shared.materialize(table.select("id", "k", "k2").join(firsts, ["k", "k2"]).filter("id <> first").select("id"), "copies")
    shared.discard(firsts)
    return out


def _lines_of(numbered: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, t) of the lines in ``ids``; texts travel as whole documents, beside the places that are wanted."""
    texts = numbered.join(pieces.places_of(ids).withColumnRenamed("no", "own"), F.col("no") == F.col("own"))
    wanted = pieces.let(F.split(F.lower("text"), "\n"), lambda x: F.transform("places", lambda i: F.struct(i.alias("i"), F.get(x, i).alias("x"))))
    lines = texts.select("no", F.explode(wanted).alias("p")).select(pieces.piece_id(F.col("no"), F.col("p.i")).alias("id"), F.col("p.x").alias("x"))
    return lines.select("id", F.btrim(F.regexp_replace("x", shared.WORD_SPLIT, " ")).alias("t")).distinct()


def later_matches(numbered: DataFrame) -> DataFrame:
    """id of every line of (no, text) that is equal or alike to an earlier one."""
    spark = numbered.sparkSession
    table = shared.materialize(first_grams(normal_lines(numbered)), "grams")
    copies = _copies(table)
    shared.release(spark)
    ids = may_be_alike(table, copies)
    shared.discard(table)
    shared.release(spark)
    lines = shared.materialize(_lines_of(numbered, ids), "line-texts")
    sets = shared.materialize(token_sets(lines, word_classes(lines)), "line-sets")
    shared.discard(ids, lines)
    shared.release(spark)

    rows = prefixes(sets).select("id", "n", F.posexplode("prefix").alias("at", "token"))
    same = Window.partitionBy("token")
    table = rows.select("*", F.min(F.struct("id", "n")).over(same).alias("first"), F.count(F.lit(1)).over(same).alias("c")).filter("c > 1")
    table = shared.materialize(table.select("token", "id", "n", "at", F.col("first.id").alias("x"), F.col("first.n").alias("m"), "c"), "rest")
    shared.release(spark)

    rest = table.select("token", "id", "n", "at")
    wide = table.select("token", "id", "n", F.sum("c").over(Window.partitionBy("id")).alias("w"))
    hubs = wide.select("token", "id", "n", F.max(F.struct("w", (-F.col("id")).alias("x"), F.col("n").alias("m"))).over(same).alias("h"))
    others = shared.materialize(_most_often(hubs.select("id", "n", (-F.col("h.x")).alias("x"), "h.m")), "stars")
    shared.release(spark)
    stars = shared.materialize(_most_often(table), "stars")
    shared.release(spark)
    both = [stars, others]
    stars = stars.unionByName(others).distinct()
    settled = _verified(stars, sets)
    shared.discard(*both)
    shared.release(spark)

    marked = shared.materialize(rest.join(sets.select("id", _bitmap(F.col("tokens")).alias("bits")), "id"), "marked")
    shared.discard(table)
    still = shared.materialize(marked.join(settled, "id", "left_anti"), "still")
    earlier = marked.select("token", *[F.col(a).alias(b) for a, b in EARLIER.items()])
    n, m = F.col("n"), F.col("m")
    meet = (F.col("id") > F.col("x")) & _can_match(n, F.col("at"), m, F.col("to")) & _few_differ("bits", "other", n, m)
    # semi joins: a line of a group meets all its earlier ones, but no row is made of a pair
    later = shared.materialize(_beside(still, earlier, meet), "later")
    sooner = shared.materialize(_beside(earlier, later, meet, "x"), "sooner")
    shared.discard(marked, still)
    shared.release(spark)
    # a token of few lines on one side makes pairs, each verified once; of many on both, lines with their token sets, but no pairs
    sides = later.groupBy("token").agg(F.count(F.lit(1)).alias("a")).join(sooner.groupBy("token").agg(F.count(F.lit(1)).alias("b")), "token")
    crowded = shared.materialize(sides.filter(F.least("a", "b") > FEW).select("token"), "crowded")
    those = sooner.join(crowded, "token", "left_anti").withColumnRenamed("token", "same")
    pairs = later.join(crowded, "token", "left_anti").join(those, (F.col("token") == F.col("same")) & meet).select("id", "x").distinct()
    found = _verified(pairs, sets)
    if not crowded.isEmpty():
        left = later.join(crowded, "token", "left_semi").join(sets.select("id", F.col("tokens").alias("s")), "id")
        right = sooner.join(crowded, "token", "left_semi").join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("t")), "x")
        alike = 7 * F.size(F.array_intersect("s", "t")) >= 3 * (n + m)
        found = found.unionByName(shared.materialize(_beside(left, right, meet & alike).select("id").distinct(), "found"))
    shared.discard(later, sooner, sets)
    shared.release(spark)
    return copies.unionByName(settled).unionByName(found)


#: Names of a line's columns where it is the earlier one of two.
EARLIER = {"id": "x", "n": "m", "at": "to", "bits": "other"}


def _beside(these: DataFrame, those: DataFrame, condition: Column, key: str = "id") -> DataFrame:
    """Rows of ``these`` for which a row of ``those`` with the same token meets the condition.

    A token with more than BLOCK rows of ``these`` has them dealt over several tasks by ``key``, each
    beside all of ``those`` with that token.
    """
    d = those.withColumnRenamed("token", "same")
    hot = these.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK)
    hot = shared.materialize(hot.select("token", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        return these.join(d, (F.col("token") == F.col("same")) & condition, "left_semi")
    names = these.columns
    left = these.join(hot, "token", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.col("parts"))).cast("int"))
    copied = d.join(hot.withColumnRenamed("token", "same"), "same", "left")
    copied = copied.withColumn("own", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return left.join(copied, (F.col("token") == F.col("same")) & (F.col("part") == F.col("own")) & condition, "left_semi").select(*names)


def removed_lines(docs: DataFrame) -> tuple[pieces.Numbers, DataFrame]:
    """The documents' numbers, and (no, places) of the lines that go."""
    numbers = pieces.Numbers(docs)
    return numbers, pieces.places_of(later_matches(numbers.of(docs, "text")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` (the same columns) with the later lines cut out of the text.

    A null text stays null, a text may become empty; blank lines stay; a null doc_id is left whole and
    supplies nothing; rows that share a doc_id are one document given more than once.  An empty table
    gives an empty one.
    """
    numbers, gone = removed_lines(docs)
    d = numbers.beside(docs, gone)
    new = pieces.without_lines(F.col("row.text"), F.col("found.places"))
    return d.select(*[new.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.project(shared.read_table(spark, sf_dir, "documents"), "doc_id", "text")
    numbers, gone = removed_lines(docs)
    text, places = F.col("row.text"), F.col("found.places")
    kept = F.coalesce(pieces.without_lines(text, places), F.lit(""))
    return numbers.beside(docs, gone).select(
        F.col("row.doc_id").alias("doc_id"),
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
        F.when(places.isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_removed"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, i, parts[i] AS line, list_filter(regexp_split_to_array(lower(parts[i]), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) r(i)),
p AS (SELECT array_to_string(words, ' ') AS t, min((doc_id, i)) AS first, any_value(words) AS words FROM l WHERE len(words) > 0 GROUP BY 1),
q AS (SELECT row_number() OVER (ORDER BY first) AS id, * FROM p),
s AS (SELECT DISTINCT id, array_to_string(words[k:k+4], ' ') AS g FROM q, unnest(range(1, len(words) - 3)) r(k)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
m AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
later AS (SELECT DISTINCT b AS id FROM m JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 7 * c >= 3 * (x.n + y.n)),
f AS (SELECT q.t, q.first, later.id IS NOT NULL AS alike FROM q LEFT JOIN later USING (id)),
k AS (SELECT doc_id, i, line, f.t IS NOT NULL AND (alike OR f.first <> (doc_id, i)) AS gone FROM l LEFT JOIN f ON len(words) > 0 AND f.t = array_to_string(words, ' ')),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a USING (doc_id)
"""
