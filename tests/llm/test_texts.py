"""Decontamination, SentencePiece, lines, paragraphs and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from setweave.llm import decontaminate as D, line_dedup, paragraph_dedup, pieces, sentencepiece_codec as P

from ..conftest import rows
from .conftest import edited, make, prose


def plain_tiles(a, b, least):
    """Greedy string tiling by comparing all pairs of places, again and again."""
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return total
        k, i, j = best
        used_a[i : i + k], used_b[j : j + k] = [True] * k, [True] * k
        total += k


def test_tiles_against_plain_tiling():
    g = random.Random(3)
    for _ in range(60):
        a = [g.randint(1, 4) for _ in range(g.randint(1, 25))]
        b = [g.randint(1, 5) for _ in range(g.randint(0, 40))] + a[5:15] + a[:5]
        k = min(3, len(a))
        assert sum(t[2] for t in D.tiles(np.array(a), np.array(b), 3)) == plain_tiles(a, b, k)


def test_reordered_passages_are_found(spark):
    item = prose(1, 40)
    w = item.split(" ")
    shuffled = " ".join([*w[20:30], "and", *w[:10], "then", *w[30:]])
    docs = make(spark, [f"{prose(2, 50)} {item.upper()} {prose(3, 9)}", f"{prose(4, 30)}\n{shuffled}", " ".join(w[:12]), prose(5, 200), None, "tiny item only"])
    bench = spark.createDataFrame([(7, item), (8, "Tiny item, only!"), (9, None), (10, "..."), (7, item), (7, prose(9, 40))], "item_id long, text string")
    for size in (D.BLOCK_BYTES, 100):
        got = {r["doc_id"]: [(x["item_id"], round(x["coverage"], 2)) for x in r["items"]] for r in D.contamination(docs, bench, block_bytes=size).collect()}
        assert got == {0: [(7, 1.0)], 1: [(7, 0.75)], 2: [], 3: [], 4: [], 5: [(8, 1.0)]}
    assert rows(D.drop_contaminated(docs, bench), "doc_id") == [(2,), (3,), (4,)]
    assert rows(D.drop_contaminated(docs, bench, 100), "doc_id") == [(2,), (3,), (4,)]
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 6


def test_decontamination_against_plain_tiling(spark):
    """The whole query beside a plain tiling of every document with every item."""
    sf = "/root/testdata/sf0.001"
    read = lambda name, key: [(r[key], D.bare_tokens(r["text"])) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    items, want = [x for x in read("benchmark", "item_id") if x[1]], {}
    for doc, tokens in read("documents", "doc_id"):
        own, found = set(zip(*(tokens[k:] for k in range(D.MIN_MATCH)))), {}
        for item, words in items:
            if own & set(zip(*(words[k:] for k in range(D.MIN_MATCH)))):
                share = plain_tiles(words, tokens, min(D.MIN_MATCH, len(words))) / len(words)
                if share >= D.COVERAGE:
                    found[item] = max(share, found.get(item, 0))
        want[doc] = (bool(found), round(max(found.values(), default=0.0), 6), ",".join(map(str, sorted(found))))
    got = {r["doc_id"]: (r["contaminated"], r["max_coverage"], r["item_ids"]) for r in D.op7_decontamination(spark, sf).collect()}
    assert got == want and any(x[0] for x in want.values())


def test_exact_as_the_library(spark):
    import hashlib

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in P.op9_sentencepiece(spark, "/root/testdata/sf0.01").collect():
        ids = lib.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("text", ["", " ", "a", " a  b ", "▁x ▁", "café 日本\U0001f600\x00", "<s> </s>", "a\n\n\tb", prose(1, 200)])
def test_spans_tile_the_source(text):
    own = P.codec(P.default_model())
    ids = own.encode([text])[0]
    starts, ends = own.spans(text, np.array(ids))
    raw = text.encode()
    assert starts[0] == 0 and ends[-1] == len(raw) and (starts[1:] == ends[:-1]).all() and (ends >= starts).all()
    for i, s, e in zip(ids[1:-1], starts[1:-1], ends[1:-1], strict=True):
        piece = own.lib.id_to_piece(i)
        if not piece.startswith("<0x"):
            assert raw[s:e].decode().replace(" ", "▁") in (piece, piece[1:])


def compiled(rules):
    """A compiled character map (double-array trie and replacements) of {key: replacement}, built by first fit."""
    import struct

    trie, blob = {}, b""
    for key, value in sorted(rules.items()):
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node["end"] = len(blob)
        blob += value + b"\0"
    units, used = {0: 0}, {0}

    def place(node, at):
        labels = [0] * ("end" in node) + [b for b in node if b != "end"]
        base = next(x for x in range(1, 1 << 16) if (at ^ x) not in (0,) and all((at ^ x ^ c) not in used for c in labels))
        units[at] = units.get(at, 0) | base << 10 | (256 if "end" in node else 0)
        used.update(at ^ base ^ c for c in labels)
        for c in labels:
            if c == 0:
                units[at ^ base] = node["end"] | 1 << 31
            else:
                units[at ^ base ^ c] = c
        for c in labels:
            if c:
                place(node[c], at ^ base ^ c)

    place(trie, 0)
    size = (max(units) // 256 + 2) * 256  # the library takes whole blocks
    return struct.pack(f"<I{size}I", 4 * size, *(units.get(i, 0) for i in range(size))) + blob


RULES = {"\ufb01".encode(): b"fi", "\uff21".encode(): b"A", "\u00e9".encode(): b"e", "e\u0301".encode(): "\u00e8".encode(), b"\t": b" ", "\u200b".encode(): b"", b"ab": b"x", b"abc": b"yz"}


def mapped_codec(tmp_path, **changes):
    """The public model with a compiled map and other rules of its normaliser; the library reads the same file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(P.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = compiled(RULES)
    for k, v in changes.items():
        setattr(proto.normalizer_spec, k, v)
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return path


@pytest.mark.parametrize("changes", [{}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}])
def test_compiled_map_against_the_library(spark, tmp_path, changes):
    """Whole documents through the longest-prefix walk: every piece's span holds what the library made the piece of."""
    path = mapped_codec(tmp_path, **changes)
    own = P.Codec(path)
    assert own.normalize.map.units
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += ["ﬁn Ａb abcd abc ab é e\u0301 \t x\u200by  z ", "", " ", "\u200b", "日本 ab"]
    for text in texts:
        out, source = own.normalize(text.encode())
        pieces_ = own.lib.encode(text, out_type=str)
        ids = own.encode([text])[0]
        plain = out.decode()
        known = b"".join(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.encode() for p in pieces_)
        assert known.decode() == plain
        assert len(source) == len(out) + 1 and (np.diff(source) >= 0).all() and source[-1] == len(text.encode())
        starts, ends = own.spans(text, np.array(ids))
        assert (starts[2:] == ends[1:-1]).all() and ends[-1] == len(text.encode())
        width = np.cumsum([0, *(1 if re.fullmatch("<0x[0-9A-F]{2}>", p) else len(p.encode()) for p in pieces_)])
        assert (starts[1:-1] == source[width[:-1]]).all()  # a replacement that is split belongs to the piece of its end


def test_short_cut_equals_the_walk():
    own = P.codec(P.default_model()).normalize
    walk = P.OffsetNormalizer.__new__(P.OffsetNormalizer)
    walk.map, walk.prefix, walk.squeeze, walk.space = P.CharacterMap(compiled({b"\xff\xfe": b"q"})), own.prefix, own.squeeze, own.space
    for text in ("a", " a  b ", "é 日本\U0001f600 ▁", prose(1, 50)):
        (a, x), (b, y) = own(text.encode()), walk(text.encode())
        assert a == b and (x == y).all()


def test_codec_rows(spark):
    d = P.encode_documents(make(spark, [None, "", "a b"]), P.default_model())
    got = {r["doc_id"]: r for r in d.collect()}
    assert got[0]["ids"] == got[1]["ids"] == [1, 2] and got[2]["decoded"] == "a b" and got[2]["ends"][-1] == 3
    back = P.round_trip(make(spark, [None, " x  y"]), P.default_model())
    assert rows(back, "doc_id", "text") == [(0, None), (1, " x  y")]


def alike(x, y):
    s, t = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.lower().split(), y.lower().split()))
    return bool(t) and 4 * len(s & t) >= 3 * len(s | t)


def brute_lines(pairs):
    seen, exact, out = [], [], {}
    for i, t in sorted(pairs):
        keep = []
        for line in (t or "").split("\n"):
            words = line.lower().split()
            if words:
                if words in exact or (len(words) >= 5 and any(alike(line, x) for x in seen)):
                    seen.append(line)
                    continue
                exact.append(words)
                seen.append(line)
            keep.append(line)
        out[i] = "\n".join(keep)
    return out


def test_lines_against_all_pairs(spark):
    g = random.Random(5)
    base = [prose(k, g.randint(5, 60)) for k in range(10)]
    lines = base + [edited(g.choice(base), k, g.randint(0, 3)) for k in range(60)] + ["short line", "Short  LINE ", "one", "", "  ", base[0].upper(), f" {base[1]}\t"]
    pairs = [(i, "\n".join(g.choice(lines) for _ in range(g.randint(1, 5)))) for i in range(40)] + [(50, None)]
    docs = make(spark, pairs)
    got = line_dedup.deduplicate(docs)
    want = brute_lines(pairs)
    assert {r["doc_id"]: r["text"] or "" for r in got.collect()} == want
    assert docs.columns == got.columns


def test_hot_tokens_are_split(spark, monkeypatch):
    """Lines with one shared token too many, dealt over several tasks, lose no match."""
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    g = random.Random(6)
    base = [prose(k, 24) for k in range(3)]
    pairs = [(i, edited(g.choice(base), 10 * i, g.randint(0, 4))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(make(spark, pairs)).collect()}
    assert got == brute_lines(pairs)


def test_passages_keep_the_first(spark):
    p, q = (prose(k, 60).replace("4 ", "4. ") for k in (1, 2))
    inside = f"{prose(7, 9)} {p} {prose(8, 30)}"
    pairs = [(0, f"{p}\n{q}"), (1, f"{p}\nshort\n{prose(3, 20)}"), (2, q), (3, None), (None, p), (4, "short\nshort"), (5, inside)]
    out = paragraph_dedup.deduplicate(make(spark, pairs))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == make(spark, []).columns
    assert got[0] == pairs[0][1] and got[1] == f"short\n{prose(3, 20)}" and got[4] == "short\nshort"
    assert got[2] == "" and got[3] is None and got[None] == p
    assert len(got[5]) < len(inside) - len(p) / 2 and got[5].startswith(prose(7, 9)) and got[5].endswith(prose(8, 30)[-40:])


def test_segments_by_words_are_those_of_the_pattern():
    g = random.Random(2)
    for _ in range(300):
        line = "".join(g.choice(["a", "bb. ", "c ", "d! ", " ", "\t", "e.f ", "é? ", ". "]) for _ in range(g.randint(0, 120)))
        want = [p.encode().split() for p in paragraph_dedup._SEGMENT.findall(line)]
        assert [w for w in want if w] == paragraph_dedup.word_segments(line.encode().split())
        assert paragraph_dedup.count_segments(f"{line}\n{line}") == 2 * len(want)


def test_ids_outside_the_packed_room(spark):
    p, q = prose(1, 30), prose(2, 30)
    docs = make(spark, [(2**62, f"{p}\n{q}"), (-7, f"x\n{p}"), (3, p), (2**50, q)])
    for operator in (line_dedup, paragraph_dedup):
        left = {r["doc_id"]: r["text"] for r in operator.deduplicate(docs).collect()}
        assert left == {-7: f"x\n{p}", 3: "", 2**50: q, 2**62: ""}
    assert rows(pieces.Numbers(docs).of(docs, "text"), "no") == [(0,), (1,), (2,), (3,)]


def test_native_operators_use_no_python(spark):
    from setweave.llm import shared

    plans = []
    keep = shared.materialize

    def spy(df, label):
        plans.append(df._jdf.queryExecution().toString())
        return keep(df, label)

    line_dedup.shared.materialize, old = spy, keep
    try:
        out = line_dedup.op4_line_dedup(spark, "/root/testdata/sf0.001")
    finally:
        line_dedup.shared.materialize = old
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 5 and not any(re.search("Python|Pandas|Arrow(Eval|Map)", p) for p in plans)


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Every stage, on its own input, against a plain version of it."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from setweave.llm import toxicity

    from .test_near_dedup import brute

    sf = "/root/testdata/sf0.001"
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        after_df = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in after_df.collect()}
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            scores = dict(zip(before, toxicity._scorer(model)(list(before.values())), strict=True))
            assert set(after) == {i for i, s in scores.items() if s < 0.5}
        elif name == "line_dedup":
            assert {i: r["text"] for i, r in after.items()} == brute_lines(before.items())
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near_dedup":
            assert set(after) == {i for i, _, _, kept in brute(list(before.items())) if kept}
        elif name == "decontamination":
            items = [D.bare_tokens(t) for _, t in bench]
            hit = {i for i, t in before.items() if any(2 * sum(x[2] for x in _named_tiles(a, D.bare_tokens(t))) >= len(a) for a in items if a)}
            assert set(after) == set(before) - hit
        else:
            assert {i: r["decoded"] for i, r in after.items()} == before and all(r["n_tokens"] == len(r["ids"]) for r in after.values())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after_df.columns == names
        docs = after_df
    assert rows(corpus_pipeline.run(spark, sf), "doc_id", "n_tokens") == rows(docs, "doc_id", "n_tokens")


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_removed", F.lit(1)).withColumn("places", F.lit(2))
    none = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, none, empty).count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.run(spark, empty).count() == 0


def _named_tiles(a, b):
    number = {}
    ids = lambda x: np.array([number.setdefault(w, len(number) + 1) for w in x], int)
    return D.tiles(ids(a), ids(b))
