import random

import numpy as np
import pytest

from setweave.llm import suffix_dedup as S

from .conftest import make


def brute(pairs, length):
    seen, out = set(), {}
    for i, t in sorted(pairs):
        raw = (t or "").encode()
        cover = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                cover[p : p + length] = True
            seen.add(w)
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~cover])
    return out


def texts():
    g = random.Random(7)
    base = "".join(g.choice("abcd ") for _ in range(300))
    out = [base, base, "ab" * 60, "x" * 90, "é" * 40]
    for _ in range(40):
        t = "".join(g.choice("abcd ") for _ in range(g.randint(0, 200)))
        a = g.randrange(280)
        cut = base[a : a + g.randint(5, 60)]
        out.append(t + cut + t[::-1] + (cut if g.random() < 0.3 else ""))
    out += [base[50:90] + chr(97 + k % 26) * 3 + base[100:140] for k in range(30)] + [None, ""]
    g.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("length", "gram", "batch", "hot"), [(20, 8, 2048, 10**6), (20, 8, 3, 4), (20, 8, 5, 0), (12, 5, 7, 10**6)])
def test_against_all_windows(spark, monkeypatch, length, gram, batch, hot):
    pairs = texts()
    docs = make(spark, pairs).repartition(5)
    runs = S.repeated_runs(docs, length, gram, batch, hot)
    got = {}
    for r in S._with_runs(docs, runs).collect():
        starts, ends = S.merged(np.array([x["start"] for x in r["runs"] or []], int), np.array([x["end"] for x in r["runs"] or []], int))
        got[r["doc_id"]] = S._kept(bytes(r["b"]), starts, ends)
    assert got == brute(pairs, length)


def test_hashes_by_doubling():
    raw = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    for n in (1, 2, 3, 7, 11, 13):
        h = S.rolling(raw, n)
        seen = {}
        for i in range(len(raw) - n + 1):
            assert seen.setdefault(bytes(raw[i : i + n]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


def test_every_window_holds_a_chosen_suffix():
    raw = np.frombuffer(bytes(random.Random(1).choices(b"ab c", k=3000)), np.uint8)
    at, _ = S.chosen(raw, 40, 12)
    for p in range(len(raw) - 39):
        assert ((at >= p) & (at + 12 <= p + 40)).any()


def test_family_levels():
    f, every = S.Family(), set()
    g = np.random.default_rng(1)
    for _ in range(50):
        keys = np.unique(g.integers(0, 5000, 40).astype(np.uint64))
        assert (f.holds(keys) == np.array([k in every for k in keys.tolist()])).all()
        f.add(keys)
        every |= set(keys.tolist())
    assert len(f.levels) <= 12 and all(len(a) >= 2 * len(b) for a, b in zip(f.levels, f.levels[1:], strict=False))


def test_odd_rows(spark, odd):
    got = {}
    for r in S.deduplicate(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [len(x["kept"]) for x in got[3]] != [0] and all(len(x["kept"]) == 0 for x in got[4])
    assert got[0][0]["kept"] == b"" and bytes(got[5][0]["kept"]) == b"one two three"
    assert bytes(got[8][0]["kept"]) == b"a" and bytes(got[9][0]["kept"]) == b"x "  # covered from the second start on


def test_given_twice_is_no_repeat_of_itself(spark):
    t = "".join(random.Random(2).choices("abcdefgh ", k=400))
    got = [bytes(r["kept"]) for r in S.deduplicate(make(spark, [(1, t), (1, t)])).collect()]
    assert got == [t.encode()] * 2


def test_given_twice_with_an_inner_repeat(spark):
    """Both rows in one task: the later copy inside the text goes, the first one stays."""
    r = "".join(random.Random(3).choices("abcdefgh ", k=300))
    t = r + "zz" + r
    got = [bytes(x["kept"]) for x in S.deduplicate(make(spark, [(1, t), (1, t)]).coalesce(1)).collect()]
    assert got == [brute([(1, t)], 100)[1]] * 2
