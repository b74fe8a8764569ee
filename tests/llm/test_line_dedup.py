"""Lines that may be alike another: found before any shingle is computed, and none is missed."""

import random

import pytest

from setweave.llm import line_dedup

from .conftest import edited, make, prose
from .test_texts import brute_lines


def varied(seed):
    """Lines beside copies cut at either end or in the middle, with words swapped, changed or repeated."""
    g = random.Random(seed)
    lines = []
    for k in range(24):
        words = prose(100 * seed + k, g.choice([5, 6, 8, 9, 12, 20, 33, 60]), ["a", "of", "the", "longer", "wordlike"]).split(" ")
        lines.append(" ".join(words))
        cut = len(words) // 4 + g.randint(-1, 1)
        lines += [" ".join(words[max(0, cut) :]), " ".join(words[: len(words) - max(0, cut)]), edited(" ".join(words), k, 1)]
        half = len(words) // 2
        lines += [" ".join(words[half:] + words[:half]), " ".join([*words, *words[:3]]), " ".join(words[:4] * 5)]
    g.shuffle(lines)
    lines += ["one\t two  THREE four five six", "one two three four five six", "ΑΣ ΟΔΟΣ of the five İ", "ας οδος of the five i̇", "a a a a a", "a a a a a a"]
    return [(i, "\n".join(lines[i::40])) for i in range(40)]


@pytest.mark.parametrize("few", [64, 0])
def test_no_match_is_missed(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)  # 0: every token is crowded
    pairs = varied(few + 1)
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(make(spark, pairs)).collect()} == brute_lines(pairs)


def test_shingles_are_computed_only_for_lines_that_may_be_alike(spark, monkeypatch):
    seen, plain = [], line_dedup.token_sets

    def spy(lines, *rest):
        seen.append(lines.count())
        return plain(lines, *rest)

    monkeypatch.setattr(line_dedup, "token_sets", spy)
    base = prose(1, 40)
    pairs = [(i, prose(50 + i, 40)) for i in range(30)] + [(40, base), (41, edited(base, 2, 1)), (42, base)]
    assert line_dedup.deduplicate(make(spark, pairs)).filter("text = ''").count() == 2
    assert seen == [2]
