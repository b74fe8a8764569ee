import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside, to clash with them.
EXTRA = ["id", "key", "n", "words", "lines", "host", "salt", "component", "kept", "b", "rules", "tokens", "g", "pos", "items", "_places", "found_id", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def make(spark, texts, start=0):
    """A documents table from texts, or (doc_id, text) pairs; every other column is null or clashes."""
    pairs = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, None if k % 2 else "h", None, *["x"] * len(EXTRA)) for k, (i, t) in enumerate(pairs)], SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n, words=WORDS):
    g = random.Random(seed)
    return " ".join(g.choice(words) + str(g.randint(0, 40)) for _ in range(n))


def edited(text, seed, changes):
    g, w = random.Random(seed), text.split(" ")
    for _ in range(changes):
        w[g.randrange(len(w))] = f"new{g.randint(0, 10**6)}"
    return " ".join(w)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    long = prose(1, 30_000)
    texts = [
        (0, None), (1, ""), (2, "   \t\n "), (3, long), (4, long), (4, long), (5, "one two three"), (6, "one two three"), (None, "no id here at all today"), (None, None),
        (7, "\x01\x02 café 日本 \U0001f600 ▁ end\n\n\nlast line of five words"), (8, "a" * 50_000), (9, "x " * 20_000), (10, "\n".join(["same line of just six words"] * 50)),
        (-5, prose(2, 80)), (2**62, edited(prose(2, 80), 3, 2)),
    ]
    return make(spark, texts).cache()


@pytest.fixture(scope="session")
def sf(tmp_path_factory, spark, odd):
    """A folder with the odd documents as its documents table."""
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3, 0, 1), (5, 1, None), (7, None, 0), (8, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three"), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="session")
def empty(tmp_path_factory, spark, odd):
    path = str(tmp_path_factory.mktemp("empty"))
    odd.filter(F.lit(False)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path
