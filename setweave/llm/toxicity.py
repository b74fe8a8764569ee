"""Toxicity scores (operator 3): a bidirectional GRU with attention pooling, in numpy.

A token's input is the sum of hashed embeddings of the whole word and of its leading and trailing
characters.  Texts are cut into overlapping windows that together hold every token; each window is
read in both directions, its states are pooled by attention into a logit, and a text's score is the
logistic of its windows' log-sum-exp, so one toxic window is enough in a text of any length.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

WINDOW, STRIDE = 32, 16
#: Windows of training stand side by side: every token once, at half the cost of overlapping ones.
TRAIN_STRIDE = 32
BUCKETS, DIM, HIDDEN = 1 << 16, 8, 8
PREFIXES, SUFFIX = (4, 5, 6, 7), 4  # in UTF-8 bytes
#: Bound of the training sample: labelled rows of each class, whose texts are read whole.
MOST_OF_A_CLASS = 2000
EPOCHS, BATCH_WINDOWS, RATE = 8, 384, 0.01
#: Windows that a training step holds the states of at once; a batch with more is read twice, in slices.
SLICE_WINDOWS = 2048
STRIP = b".,;:!?|#*$%&\"'()[]<>-_=+/"
CACHE_WORDS = 100_000
CHUNK_TOKENS = 150_000
#: Arrays are filled up to whole blocks, so that a window's result doesn't depend on those beside it.
BLOCK_WINDOWS, LANES, DIGITS = 1024, 256, 7


#: A word of more characters than the first counts as several tokens of the second.
LONG_WORD, PART = 48, 16


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if words and len(max(words, key=len)) > LONG_WORD:
        return [p for w in words for p in ([w] if len(w) <= LONG_WORD else [w[k : k + PART] for k in range(0, len(w), PART)])]
    return words


def features(word: str) -> list[int]:
    """Buckets of the word and of its characters at both ends (always the same count)."""
    raw = word.encode("utf-8", "replace")
    bare, crc, last = raw.strip(STRIP) or raw, zlib.crc32, BUCKETS - 1
    return [crc(bare) & last, *[crc(bare[:n], n) & last for n in PREFIXES], crc(bare[-SUFFIX:], 1) & last]


N_FEATURES = 2 + len(PREFIXES)


def windows_of(n: int, stride: int = STRIDE) -> list[tuple[int, int]]:
    """(start, length) of windows that cover n tokens; one empty window for none."""
    if n <= WINDOW:
        return [(0, n)]
    return [(s, min(WINDOW, n - s)) for s in range(0, n - WINDOW + stride, stride)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(seed: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    w = lambda *s: (g.standard_normal(s) * 0.3).astype(np.float32)
    h = HIDDEN
    return {
        "E": (g.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32),
        "Wf": w(DIM, 3 * h), "Uf": w(h, 3 * h), "bf": np.zeros(3 * h, np.float32),
        "Wb": w(DIM, 3 * h), "Ub": w(h, 3 * h), "bb": np.zeros(3 * h, np.float32),
        "A": w(2 * h, h), "v": w(h), "out": w(2 * h), "bias": np.full(1, -3, np.float32),
    }


def gru(x: np.ndarray, U: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, batch, H) for projected inputs x (time, batch, 3H); a masked step holds the state."""
    t, b, h3 = x.shape
    n = h3 // 3
    h, states, tape = np.zeros((b, n), np.float32), np.empty((t, b, n), np.float32), []
    for i in range(t):
        hu = h @ U
        zr = sigmoid(x[i, :, : 2 * n] + hu[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[i, :, 2 * n :] + r * hu[:, 2 * n :])
        m = mask[i][:, None] * z
        new = h + m * (c - h)
        if keep:
            tape.append((h, z, r, c, hu[:, 2 * n :]))
        states[i] = h = new
    return states, tape


def gru_back(d: np.ndarray, U: np.ndarray, mask: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and U for gradients d of the states."""
    t, b, n = d.shape
    dx, dU, dh = np.zeros((t, b, 3 * n), np.float32), np.zeros_like(U), np.zeros((b, n), np.float32)
    for i in range(t - 1, -1, -1):
        h, z, r, c, hc = tape[i]
        m = mask[i][:, None]
        dh = dh + d[i]
        dz = dh * m * (c - h) * z * (1 - z)
        dc = dh * m * z * (1 - c * c)
        dr = dc * hc * r * (1 - r)
        dx[i] = np.concatenate([dz, dr, dc], 1)
        g = np.concatenate([dz, dr, dc * r], 1)
        dU += h.T @ g
        dh = dh * (1 - m * z) + g @ U.T
    return dx, dU


def forward(p: dict, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Window logits. xf, xb: projected inputs in reading order (time, batch, 3H)."""
    f, tf = gru(xf, p["Uf"], mask, keep)
    b, tb = gru(xb[::-1], p["Ub"], mask[::-1], keep)
    s = np.concatenate([f, b[::-1]], 2)
    q = np.tanh(s @ p["A"])
    e = q @ p["v"] + (mask - 1) * 1e4
    a = np.exp(e - e.max(0))
    a = a / a.sum(0)
    pooled = (a[:, :, None] * s).sum(0)
    empty = mask.sum(0) == 0
    logits = np.where(empty, 0, pooled @ p["out"]) + p["bias"][0]
    return logits, (s, q, a, pooled, tf, tb, empty) if keep else None


def backward(p: dict, dlogit: np.ndarray, mask: np.ndarray, tape) -> dict[str, np.ndarray]:
    s, q, a, pooled, tf, tb, empty = tape
    g = {"bias": dlogit.sum(keepdims=True)}
    d = np.where(empty, 0, dlogit).astype(np.float32)
    g["out"] = pooled.T @ d
    dpool = d[:, None] * p["out"]
    ds = a[:, :, None] * dpool
    da = (s * dpool).sum(2)
    de = a * (da - (a * da).sum(0))
    g["v"] = np.einsum("tb,tbh->h", de, q)
    dq = de[:, :, None] * p["v"] * (1 - q * q)
    g["A"] = np.einsum("tbs,tbh->sh", s, dq)
    ds = ds + dq @ p["A"].T
    n = HIDDEN
    g["xf"], g["Uf"] = gru_back(ds[:, :, :n], p["Uf"], mask, tf)
    xb, g["Ub"] = gru_back(ds[::-1, :, n:], p["Ub"], mask[::-1], tb)
    g["xb"] = xb[::-1]
    return g


def _ids(words: list[str]) -> np.ndarray:
    """Features of words (words, N_FEATURES), in two bytes each."""
    parts = [np.array([features(w) for w in words[k : k + 8192]], np.uint16) for k in range(0, len(words), 8192)]
    return np.concatenate(parts) if parts else np.empty((0, N_FEATURES), np.uint16)


def train(texts: list[str], labels: list[int], seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over mini-batches of texts; classes are weighted to equal mass."""
    p = fresh(seed)
    if len(set(labels)) < 2:
        p["out"][:] = 0
        p["bias"][:] = 3 if labels and labels[0] else -3
        return p
    g = np.random.default_rng(seed)
    ids = [_ids(words_of(t)) for t in texts]
    share = np.mean(labels)
    weight = np.where(np.array(labels) == 1, min(0.5 / share, 4), 0.5 / (1 - share))
    first, second = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - 0.8 * epoch / EPOCHS)
        part, size = [], 0
        for i in g.permutation(len(texts)):
            part.append(i)
            size += len(windows_of(len(ids[i]), TRAIN_STRIDE))
            if size >= BATCH_WINDOWS:
                step += 1
                _update(p, [ids[i] for i in part], np.array([labels[i] for i in part]), weight[part], first, second, step, rate, g)
                part, size = [], 0
    return p


def _update(p, docs, y, weight, first, second, step, rate, g) -> None:
    cut = [(k, s, n) for k, d in enumerate(docs) for s, n in windows_of(len(d), TRAIN_STRIDE)]
    of = np.array([k for k, _, _ in cut])
    # some whole-word inputs are left out, so that the model also learns from characters
    whole = g.random((WINDOW, len(cut))) < 0.7
    slices = [slice(k, k + SLICE_WINDOWS) for k in range(0, len(cut), SLICE_WINDOWS)]
    once = _read(p, docs, cut, whole, True) if len(slices) == 1 else None
    logits = once[0] if once else np.concatenate([_read(p, docs, cut[at], whole[:, at], False)[0] for at in slices])
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, of, logits)
    e = np.exp(logits - top[of])
    total = np.zeros(len(docs))
    np.add.at(total, of, e)
    score = sigmoid(top + np.log(total))
    ddoc = (score - y) * weight / len(docs)
    dlogit = (ddoc[of] * e / total[of]).astype(np.float32)
    grads: dict[str, np.ndarray] = {}
    words: dict[str, list] = {"rows": [], "de": []}
    for at in slices:
        own, rows, de = _gradients(p, dlogit[at], *(once or _read(p, docs, cut[at], whole[:, at], True))[1:])
        grads = {k: grads[k] + d if grads else d for k, d in own.items()}
        words["rows"].append(rows)
        words["de"].append(de)
    for k, d in grads.items():
        _adam(p, k, slice(None), d, first, second, step, rate)
    rows, where = np.unique(np.concatenate(words["rows"]), return_inverse=True)
    de = np.zeros((len(rows), DIM), np.float32)
    np.add.at(de, where, np.concatenate(words["de"]))
    _adam(p, "E", rows, de, first, second, step, rate)


def _read(p, docs, cut, whole, keep) -> tuple:
    """Logits of the windows in ``cut``, and what their gradients need."""
    feats, mask = np.zeros((WINDOW, len(cut), N_FEATURES), np.int64), np.zeros((WINDOW, len(cut)), np.float32)
    for j, (k, s, n) in enumerate(cut):
        feats[:n, j], mask[:n, j] = docs[k][s : s + n], 1
    on = np.ones(feats.shape, np.float32)
    on[:, :, 0] = whole
    x = (p["E"][feats] * on[..., None]).sum(2)
    logits, tape = forward(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], mask, keep)
    return logits, feats, mask, on, x, tape


def _gradients(p, dlogit, feats, mask, on, x, tape) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the weights, and the rows of E that the windows hold with theirs."""
    grads = backward(p, dlogit, mask, tape)
    dxf, dxb = grads.pop("xf"), grads.pop("xb")
    flat = x.reshape(-1, DIM)
    grads["Wf"], grads["Wb"] = flat.T @ dxf.reshape(-1, 3 * HIDDEN), flat.T @ dxb.reshape(-1, 3 * HIDDEN)
    grads["bf"], grads["bb"] = dxf.sum((0, 1)), dxb.sum((0, 1))
    dx = (dxf @ p["Wf"].T + dxb @ p["Wb"].T) * mask[:, :, None]
    rows, where = np.unique(feats, return_inverse=True)
    de = np.zeros((len(rows), DIM), np.float32)
    np.add.at(de, where.reshape(-1), (dx[:, :, None, :] * on[..., None]).reshape(-1, DIM))
    return grads, rows, de


def _adam(p, k, at, d, first, second, step, rate) -> None:
    first[k][at] = 0.9 * first[k][at] + 0.1 * d
    second[k][at] = 0.999 * second[k][at] + 0.001 * d * d
    p[k][at] -= rate * (first[k][at] / (1 - 0.9**step)) / (np.sqrt(second[k][at] / (1 - 0.999**step)) + 1e-8)


class Scorer:
    """Scores of texts; a word's projected input is computed once while it stays in the cache.

    Arrays are laid out as (unit, window), so that each step works on whole contiguous rows.  Gates
    use sigmoid(x) = (1 + tanh(x / 2)) / 2, with the halving folded into the weights.
    """

    def __init__(self, p: dict[str, np.ndarray]):
        half = np.repeat(np.float32([0.5, 0.5, 1]), HIDDEN)
        self.E, self.A, self.v, self.out, self.bias = p["E"], p["A"].T.copy(), p["v"], p["out"], float(p["bias"][0])
        self.W = [p["Wf"] * half, p["Wb"] * half]
        self.b = [p["bf"] * half, p["bb"] * half]
        self.U = [np.ascontiguousarray((p["Uf"] * half).T), np.ascontiguousarray((p["Ub"] * half).T)]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = [np.zeros((1024, 3 * HIDDEN), np.float32) for _ in range(2)]

    def _inputs(self, words: list[str]) -> np.ndarray:
        known = self.index.keys()
        new = list(set(words) - known)
        if len(self.index) + len(new) > CACHE_WORDS and self.index:
            self._forget()
            new = list(set(words))
        at = len(self.index)
        if at + len(new) > len(self.rows[0]):
            room = max(at + len(new), 2 * len(self.rows[0])) - len(self.rows[0])
            self.rows = [np.concatenate([r, np.zeros((room, 3 * HIDDEN), np.float32)]) for r in self.rows]
        for k in range(0, len(new), 8192):
            part = new[k : k + 8192]
            x = np.zeros((-(-len(part) // LANES) * LANES, DIM), np.float32)
            x[: len(part)] = self.E[np.array([features(w) for w in part])].sum(1)
            for r, W, b in zip(self.rows, self.W, self.b, strict=True):
                r[at + k : at + k + len(part)] = (x @ W + b)[: len(part)]
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> list[float]:
        out: list[float] = []
        part: list[list[str]] = []
        size = 0
        for t in texts:
            part.append(words_of(t))
            size += len(part[-1])
            if size >= CHUNK_TOKENS:
                out += self._score(part)
                part, size = [], 0
        return out + (self._score(part) if part else [])

    def _score(self, docs: list[list[str]]) -> list[float]:
        ids = self._inputs([w for d in docs for w in d])
        starts = np.cumsum([0, *map(len, docs)])
        cut = np.array([(starts[k] + s, n) for k, d in enumerate(docs) for s, n in windows_of(len(d))])
        logits = np.full(len(cut), self.bias)
        order = np.argsort(cut[:, 1], kind="stable")
        order = order[np.searchsorted(cut[order, 1], 1) :]
        for k in range(0, len(order), BLOCK_WINDOWS):
            rows = order[k : k + BLOCK_WINDOWS]
            full = np.append(rows, np.repeat(rows[-1:], BLOCK_WINDOWS - len(rows)))
            logits[rows] = self._windows(ids, *cut[full].T)[: len(rows)]
        counts = [len(windows_of(len(d))) for d in docs]
        return np.round(sigmoid(np.logaddexp.reduceat(logits, np.cumsum([0, *counts[:-1]]))), DIGITS).tolist()

    def _windows(self, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        steps, h2 = np.arange(n.max())[:, None], 2 * HIDDEN
        inside = steps < n
        at = ids[np.where(inside, steps + start, start)]
        ragged, mask = n.min() < n.max(), inside.astype(np.float32)
        states = np.empty((len(at), h2, len(n)), np.float32)
        for way, (U, rows) in enumerate(zip(self.U, self.rows, strict=True)):
            h = np.zeros((HIDDEN, len(n)), np.float32)
            for i in range(len(at)) if way == 0 else range(len(at) - 1, -1, -1):
                x, hu = np.ascontiguousarray(rows[at[i]].T), U @ h
                zr = x[:h2]
                zr += hu[:h2]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                c = hu[h2:]
                c *= zr[HIDDEN:]
                c += x[h2:]
                np.tanh(c, out=c)
                c -= h
                c *= zr[:HIDDEN]
                if ragged:
                    c *= mask[i]
                h += c
                states[i, way * HIDDEN : (way + 1) * HIDDEN] = h
        e = np.tensordot(self.v, np.tanh(self.A @ states), (0, 1))
        if ragged:
            e += (mask - 1) * 1e4
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        return (a * np.tensordot(self.out, states, (0, 1))).sum(0) + self.bias


@functools.lru_cache(maxsize=2)
def _scorer(blob: bytes) -> Scorer:
    p = pickle.loads(blob)
    return Scorer({k: x.astype(np.float32) for k, x in p.items()})


def pack(p: dict[str, np.ndarray]) -> bytes:
    return pickle.dumps({k: x.astype(np.float16) if k == "E" else x for k, x in p.items()})


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, whole text, toxic of a sample of bounded rows: per class the MOST_OF_A_CLASS labelled rows of least hash of doc_id.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out.  A text given twice counts twice.
    """
    lab = shared.project(labels, "doc_id", "toxic").dropna().filter(~held_out())
    keys = [
        lab.filter(F.col("toxic") == c).select("doc_id", F.lit(c).alias("toxic"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(MOST_OF_A_CLASS)
        for c in (0, 1)
    ]
    sample = keys[0].unionByName(keys[1]).select("doc_id", "toxic")  # bounded by the limit: 2 * MOST_OF_A_CLASS rows of two numbers
    return shared.project(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in training_rows(docs, labels).collect())
    return pack(train([r[2] for r in rows], [int(r[1]) for r in rows]))


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, score of every row: whole texts, in all overlapping windows.

    A null or empty text gets the score of no words; repeated rows get equal scores; an empty table
    gives an empty one; columns other than doc_id and text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored(batches, 1, model):
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


#: Rows whose texts are turned into Python strings at once, of a batch that may hold many.
SLICE_ROWS = 256


def _scored(batches: Iterator[pa.RecordBatch], column: int, model: bytes) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their scores.  What a task has cached goes at its end, as its worker lives on."""
    scorer = _scorer(model)
    for b in batches:
        for k in range(0, b.num_rows, SLICE_ROWS):
            part = b.slice(k, SLICE_ROWS)
            yield part, pa.array(scorer([t or "" for t in part.column(column).to_pylist()]), pa.float64())
    scorer._forget()
    pa.default_memory_pool().release_unused()


def keep_clean(docs: DataFrame, model: bytes, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (all columns) whose score is under ``threshold``."""
    import pyarrow.compute as pc

    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored(batches, column, model):
            yield batch.filter(pc.less(scores, threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, shared.read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL = None  # a trained network; tests measure its accuracy on held-out rows
