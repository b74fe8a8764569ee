import zlib

import numpy as np
import pytest

from setweave.llm import toxicity as T

from .conftest import make, prose


def test_gradients(monkeypatch):
    """Back-propagation against differences, in double precision, with ragged windows."""
    g = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in T.fresh(3).items() if k != "E"}
    h, t, b = T.HIDDEN, 5, 4
    x = g.normal(0, 1, (2, t, b, 3 * h))
    mask = np.ones((t, b))
    mask[3:, 1] = mask[:, 2] = 0
    dl = g.normal(0, 1, b)
    monkeypatch.setattr(np, "float32", np.float64)
    _, tape = T.forward(p, x[0], x[1], mask, True)
    grad = T.backward(p, dl, mask, tape)

    def loss():
        return float((T.forward(p, x[0], x[1], mask)[0] * dl).sum())

    for name in ("Uf", "Ub", "A", "v", "out", "bias"):
        for _ in range(4):
            at = tuple(g.integers(0, s) for s in p[name].shape)
            old, eps = p[name][at], 1e-6
            p[name][at] = old + eps
            up = loss()
            p[name][at] = old - eps
            down = loss()
            p[name][at] = old
            assert grad[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-4, abs=1e-6), name
    for name, k in (("xf", 0), ("xb", 1)):
        at = (1, 1, 5)
        old, eps = x[k][at], 1e-6
        x[k][at] = old + eps
        up = loss()
        x[k][at] = old - eps
        down = loss()
        x[k][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-4, abs=1e-6)


def test_fast_scores_are_the_network_s():
    p = T.fresh(5)
    texts = ["", "one", prose(1, 10), prose(2, 32), prose(3, 33), prose(4, 500)]
    for text, got in zip(texts, T.Scorer(p)(texts), strict=True):
        ids = np.array([T.features(w) for w in T.words_of(text)], np.int64).reshape(-1, T.N_FEATURES)
        logits = []
        for s, n in T.windows_of(len(ids)):
            x = p["E"][ids[s : s + n]].sum(1)[:, None] if n else np.zeros((1, 1, T.DIM), np.float32)
            m = np.full((max(n, 1), 1), float(n > 0), np.float32)
            logits.append(T.forward(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], m)[0][0])
        assert got == pytest.approx(T.sigmoid(np.logaddexp.reduce(logits)), rel=1e-3, abs=1e-5)


def test_windows_cover_everything():
    for n in (0, 1, T.WINDOW, T.WINDOW + 1, 100, 1000):
        cut = T.windows_of(n)
        assert {i for s, k in cut for i in range(s, s + k)} == set(range(n))
        assert all(a + T.STRIDE == b for (a, _), (b, _) in zip(cut, cut[1:], strict=False))


def test_small_cache_scores_alike(monkeypatch):
    p, texts = T.fresh(6), [prose(k, 300) for k in range(6)]
    whole = T.Scorer(p)(texts)
    monkeypatch.setattr(T, "CACHE_WORDS", 50)
    monkeypatch.setattr(T, "CHUNK_TOKENS", 200)
    assert T.Scorer(p)(texts) == pytest.approx(whole, rel=1e-5)


def test_held_out_accuracy(spark):
    """Whole labelled tables: learnt from the rows that aren't held out, measured on those that are."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = T.op3_toxicity(spark, sf).join(labels, "doc_id").collect()
    assert docs.count() == 10_000
    held = [r for r in scored if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    s, y = np.array([r["score"] for r in held]), np.array([r["toxic"] for r in held])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc > 0.93 and (s[y == 1] >= 0.5).mean() > 0.8 and (s[y == 0] >= 0.5).mean() < 0.03


def test_one_class_or_no_labels(spark):
    docs = make(spark, ["a b", "c d", None])
    for labels in ([], [(0, 0), (1, 0)], [(1, None)]):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert T.keep_clean(docs, model).count() == 3
    assert T.keep_clean(docs, model).columns == docs.columns


def test_texts_are_learnt_whole(spark):
    """What is toxic lies beyond the first 1,024 words of every toxic text."""
    texts = [prose(k, 1300) + (" vile scum" if k % 2 else " kind folk") + prose(k + 50, 20) for k in range(40)]
    docs, labels = make(spark, texts), spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    kept = {r["doc_id"]: r["text"] for r in T.training_rows(docs, labels).collect()}
    assert kept and all(texts[k] == t for k, t in kept.items())


def test_slices_of_a_batch_train_alike(monkeypatch):
    texts, labels = [prose(k, 40 * k) + " vile" * (k % 2) for k in range(1, 13)], [k % 2 for k in range(1, 13)]
    monkeypatch.setattr(T, "BATCH_WINDOWS", 20)
    monkeypatch.setattr(T, "EPOCHS", 1)
    whole = T.train(texts, labels)
    monkeypatch.setattr(T, "SLICE_WINDOWS", 7)
    for k, x in T.train(texts, labels).items():
        assert x == pytest.approx(whole[k], abs=2e-3), k
