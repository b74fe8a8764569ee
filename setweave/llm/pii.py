"""Personal data (operator 5): base rules, plus spans that boosted trees accept.

High-recall generators propose overlapping spans of more forms than the base rules know, looser forms
of the base kinds among them.  Gradient boosted trees, grown here in numpy, score a span from its format
and its context.  They learn from contexts of the documents: the surroundings of base spans and of other
words of a bounded sample, in which a span is replaced by one of another form, right or perturbed.  Scores
are calibrated (monotonically) on contexts of other documents, and a threshold for each kind keeps
``PRECISION`` there.  Base spans always stay; of overlapping proposals the best-scored one does.
"""

from __future__ import annotations

import functools
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone", "obfuscated_email", "local_phone", "iban", "ssn", "loose_email", "intl_phone", "loose_card")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a number that doesn't fit from the start of its digits fits from none of them
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Forms beyond the base; each may match where no such thing is meant, which the trees decide.
GENERATORS = {
    "obfuscated_email": re.compile(r"[A-Za-z0-9._%+-]{2,40} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,40}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,20}){1,3}", re.I),
    "local_phone": re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "loose_email": re.compile(r"[A-Za-z0-9._%+-]{2,40} ?@ ?[A-Za-z0-9-]{2,40}(?: ?\. ?[A-Za-z0-9-]{2,20}){1,3}"),
    "intl_phone": re.compile(r"(?<![0-9A-Za-z+(.-])(?<![0-9] )00[1-9][0-9]{0,2}(?:[ ./-]?[0-9]{2,4}){2,5}(?![ ./-]?[0-9])"),
    "loose_card": re.compile(r"(?<![0-9])[0-9]{4}(?:([._/])[0-9]{4}){3}(?![0-9])"),
}
#: What a text must hold for a kind to be looked for.
NEEDS = {k: re.compile("[0-9]") for k in GENERATORS} | {"obfuscated_email": re.compile(r"(?:\bdot\b|\(dot\)|\[dot\])", re.I), "loose_email": re.compile("@"), "intl_phone": re.compile("00[1-9]")}
CUES = {
    "obfuscated_email": ("mail", "contact", "write", "reach"),
    "local_phone": ("phone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "loose_email": ("mail", "contact", "write", "reach"),
    "intl_phone": ("phone", "call", "tel", "fax", "mobile"),
    "loose_card": ("card", "visa", "pay", "credit"),
}
CONTEXT = 24
PRECISION = 0.98
#: Documents (those of least hash of doc_id) whose contexts the trees learn from; read whole.
SAMPLE_DOCS = 600
EXAMPLES, TREES, DEPTH, RATE, BINS = 4200, 40, 3, 0.2, 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_ok(span: str) -> bool:
    flat = span.replace(" ", "")
    if not 15 <= len(flat) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the leftmost e-mails, read from each @ outwards: what comes before it can only grow to the left."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _part(digits: str) -> bool:
    """At most 255, with any number of zeros before it."""
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted; cheap tests first skip texts that can't match."""
    out = [(start, 0, end) for start, end in _emails(text)]
    if re.search("[0-9]", text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_part, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, str, int]]:
    """Every extent from every start of each kind, overlapping ones too; the scores choose among them."""
    out = []
    for kind, pattern in GENERATORS.items():
        if NEEDS[kind].search(text):
            out += [(start, kind, end) for start, end in _extents(pattern, text)]
    return out


def _extents(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """(start, end) of the leftmost matches, of matches that start at a word inside one, and of all that end sooner, at a word's end."""
    found = {(m.start(), m.end()) for m in pattern.finditer(text)}
    at = 0
    while m := pattern.search(text, at):
        start, at = m.start(), m.start() + 1
        if (start, m.end()) not in found and text[start - 1 : start].isalnum() and text[start].isalnum():
            continue
        found.add((start, m.end()))
        ends = (e for e in range(start + 1, m.end()) if text[e - 1].isalnum() and not text[e].isalnum())
        found |= {(start, e) for e in ends if pattern.fullmatch(text, start, e)}
    return sorted(found)


def describe(text: str, start: int, kind: str, end: int) -> list[float]:
    """Format and context of a proposed span, as numbers."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    digits = _digits(span)
    area = digits[:3]
    mail = kind in ("obfuscated_email", "loose_email")
    return [
        list(GENERATORS).index(kind),
        len(span),
        len(digits),
        len(set(digits)),
        sum(c.isupper() for c in span),
        sum(c in " .-()" for c in span),
        float(any(c in before for c in CUES[kind])),
        float(any(c in after for c in CUES[kind])),
        float(any(c in before for k, cues in CUES.items() if not set(cues) & set(CUES[kind]) for c in cues)),
        float(iban_ok(span)) if kind == "iban" else float(luhn(digits)) if kind == "loose_card" else -1.0,
        float(area not in ("", "000", "666") and area < "900" and digits[3:5] != "00" and digits[5:] != "0000") if kind == "ssn" else -1.0,
        float(area[:1] > "1" and digits[3:4] > "1") if kind == "local_phone" else -1.0,
        float("(at)" in span or "[at]" in span) if kind == "obfuscated_email" else -1.0,
        float(bool(re.search(r"(?:com|org|net|edu|de|fr|es|io)$", span, re.I))) if mail else -1.0,
        float(bool(re.search(r"(?:no|nr|id|ref|order|version|part|item|serial)[.:# ]*$", before))),
        float(before[-1:].isalnum()) + 2 * float(after[:1].isalnum()),
    ]


class Trees:
    """Gradient boosting on the logistic loss; regression trees over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees: list[dict] = []
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, DEPTH)
            self.trees.append(tree)
            f += RATE * self._tree(tree, x)

    def _grow(self, x, g, h, rows, cuts, depth):
        value = g[rows].sum() / (h[rows].sum() + 1)
        best = (1e-3, None, None)
        if depth and len(rows) >= 20:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for j, edges in enumerate(cuts):
                col = x[rows, j]
                for c in edges:
                    left = col <= c
                    if 5 <= left.sum() <= len(rows) - 5:
                        a, b = rows[left], rows[~left]
                        gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - whole
                        if gain > best[0]:
                            best = (gain, j, c)
        if best[1] is None:
            return {"value": value}
        left = x[rows, best[1]] <= best[2]
        return {"column": best[1], "cut": best[2], "low": self._grow(x, g, h, rows[left], cuts, depth - 1), "high": self._grow(x, g, h, rows[~left], cuts, depth - 1)}

    def _tree(self, tree, x):
        if "value" in tree:
            return np.full(len(x), tree["value"])
        return np.where(x[:, tree["column"]] <= tree["cut"], self._tree(tree["low"], x), self._tree(tree["high"], x))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + RATE * sum(self._tree(t, x) for t in self.trees))))


#: Surroundings for where a sample has too few: an empty table, or texts of a few words.
SPARE = [("and the next is ", " for all of them"), ("see ", "."), ("on page ", ", as before")]


def contexts_of(texts: list[str], seed: int) -> dict[str, list[tuple[str, str]]]:
    """(before, after) of the base spans of texts (by kind), and of a few other words of each ("other")."""
    g, out = random.Random(seed), {k: [] for k in (*BASE, "other")}
    around = lambda t, a, b: (t[max(0, a - CONTEXT) : a], t[b : b + CONTEXT])
    for t in texts:
        spans = base_spans(t)
        for start, kind, end in spans:
            out[KINDS[kind]].append(around(t, start, end))
        for _ in range(4 if t else 0):
            gap = t.find(" ", g.randrange(len(t)))
            if gap >= 0 and not any(a - CONTEXT <= gap <= b + CONTEXT for a, _, b in spans):
                out["other"].append((t[max(0, gap - CONTEXT) : gap + 1], t[gap : gap + CONTEXT]))
    return out


#: The base kind whose surroundings a kind is set into.
LIKE = {"obfuscated_email": "email", "loose_email": "email", "local_phone": "phone", "intl_phone": "phone", "loose_card": "card", "iban": "card", "ssn": "phone"}


def examples(n: int, seed: int, contexts: dict[str, list[tuple[str, str]]] | None = None) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, 1 if the span is personal, its start, its end): spans made by rule, right or perturbed, in ``contexts``."""
    g, contexts = random.Random(seed), contexts or {}
    word = lambda: "".join(g.choice("abcdefghiklmnoprstuvw") for _ in range(g.randint(2, 9)))
    num = lambda k: "".join(g.choice("0123456789") for _ in range(k))

    def iban(valid: bool) -> str:
        head, n = g.choice([("BE", 12), ("NL", 14), ("DE", 18), ("GB", 18), ("ES", 20), ("FR", 23)])
        body = num(n)
        check = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
        flat = f"{head}{check if valid else (check + g.randint(1, 80)) % 97:02d}{body}"
        return flat if g.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))

    def card(valid: bool) -> str:
        d = num(15)
        d = next(d + c for c in "0123456789" if luhn(d + c) == valid)
        return g.choice("._/").join(d[i : i + 4] for i in range(0, 16, 4))

    def make(kind: str, good: bool) -> str:
        if kind == "iban":
            return iban(good) if good or g.random() < 0.5 else f"{word()[:2].upper():A<2}{num(2)}{num(4)}{num(4)}"
        if kind == "ssn":
            return f"{g.randint(100, 665)}-{g.randint(10, 99)}-{g.randint(1000, 9999)}" if good else f"{g.choice(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}"
        if kind == "loose_card":
            return card(good)
        if kind == "intl_phone":
            return f"00{g.randint(1, 99)} {num(3)} {num(3)} {num(g.randint(2, 4))}" if good else f"00{g.randint(1, 9)}{num(g.choice([4, 5, 6, 14]))}"
        if kind == "local_phone":
            if good:
                a, b, c = f"{g.randint(2, 9)}{num(2)}", f"{g.randint(2, 9)}{num(2)}", num(4)
                return g.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])
            return g.choice(["{} {} {}", "{}-{}-{}"]).format(f"{g.choice('01')}{num(2)}", f"{g.choice('01')}{num(2)}", num(4))
        ends = ["com", "org", "net", "de", "fr"]
        if kind == "loose_email":
            return f"{word()}{num(g.randint(0, 2))} @ {word()}.{g.choice(ends)}" if good else f"{word()} @ {word()} . {word()}"
        if good:
            at, dot = g.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot")])
            return f"{word()}{num(g.randint(0, 2))} {at} {word()} {dot} {g.choice(ends)}"
        return f"{word()} at {word()} dot {word()}"

    out = []
    while len(out) < n:
        kind, good = g.choice(list(GENERATORS)), g.random() < 0.5
        near, far = contexts.get(LIKE[kind]) or [], contexts.get("other") or SPARE
        # what is right stands where its like stands, or after a cue; what is perturbed stands anywhere
        before, after = g.choice(near if near and g.random() < (0.6 if good else 0.3) else far)
        if good and g.random() < 0.7:
            before = f"{before.rstrip()} {g.choice(CUES[kind])} "
        elif not good and g.random() < 0.5:
            before = f"{before.rstrip()} {g.choice(['ref', 'order no.', 'version', 'item'])} "
        span = make(kind, good)
        before = before if before.endswith((" ", "\n", ":", "")) and not before[-1:].isalnum() else before + " "
        after = after if not after[:1].isalnum() else " " + after
        out.append((before + span + after, kind, int(good), len(before), len(before) + len(span)))
    return out


def calibrated(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores from the least up, and for each the share of right ones, made monotone by pooling neighbours that fall."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # [sum, count]
    for v in y[order].tolist():
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b = pools.pop(), pools.pop()
            pools.append([a[0] + b[0], a[1] + b[1]])
    return scores[order], np.repeat([s / c for s, c in pools], [int(c) for _, c in pools])


def _described(made: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, right or not, kind and example of every proposal of its kind in the examples."""
    x, y, kinds, of = [], [], [], []
    for i, (text, kind, good, first, last) in enumerate(made):
        for start, k, end in proposals(text):
            if k == kind and start < last and end > first:
                x.append(describe(text, start, k, end))
                y.append(bool(good) and (start, end) == (first, last))  # another extent of a right span isn't one
                kinds.append(k)
                of.append(i)
    return np.array(x), np.array(y, float), np.array(kinds), np.array(of)


class Detector:
    """The trees, each kind's threshold, and how it does on documents that it didn't learn from."""

    def __init__(self, texts: list[str]):
        learn, hold = [t for i, t in enumerate(texts) if i % 3], [t for i, t in enumerate(texts) if i % 3 == 0]
        x, y, _, _ = _described(examples(EXAMPLES, 11, contexts_of(learn, 1)))
        self.trees = Trees(x, y)
        x, y, kinds, _ = _described(examples(EXAMPLES // 2, 12, contexts_of(hold, 2)))
        scores, self.limits = self.trees(x), {}
        for k in GENERATORS:
            s, share = calibrated(scores[kinds == k], y[kinds == k])
            good = np.flatnonzero(share >= PRECISION)
            self.limits[k] = float(s[good[0]]) if len(good) else 1.1
        self.measured = self.measure(examples(EXAMPLES // 2, 13, contexts_of(hold, 3)))

    def measure(self, made: list) -> dict[str, tuple[float, float]]:
        """kind -> (precision, recall) of what is taken from examples."""
        hits = {k: [0, 0, 0] for k in GENERATORS}
        for text, kind, good, first, last in made:
            got = {(s, e) for s, k, e in self.added(text, base_spans(text)) if KINDS[k] == kind}
            hits[kind][0] += bool(good) and (first, last) in got
            hits[kind][1] += len(got)
            hits[kind][2] += good
        return {k: (a / b if b else 1.0, a / c if c else 1.0) for k, (a, b, c) in hits.items()}

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Proposals over their kind's threshold, best first, that overlap no base span and none that was taken before."""
        found = proposals(text)
        if not found:
            return []
        scores = self.trees(np.array([describe(text, *f) for f in found]))
        taken, out = np.array([(s, e) for s, _, e in base]).reshape(-1, 2), []
        for score, (start, kind, end) in sorted(zip(scores, found, strict=True), key=lambda x: (-x[0], x[1])):
            if score >= self.limits[kind] and not ((end > taken[:, 0]) & (start < taken[:, 1])).any():
                taken = np.append(taken, [(start, end)], 0)
                out.append((start, KINDS.index(kind), end))
        return out

    def find(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans of a text: (start, kind, end) in code points, sorted."""
        base = base_spans(text)
        return base, sorted(base + self.added(text, base))


def fit(docs: DataFrame) -> bytes:
    """A detector that has learnt from the SAMPLE_DOCS documents of least hash (of doc_id, then of the text); repeated rows count once."""
    d = shared.project(docs, "doc_id", "text").filter("text is not null").select("text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    keys = d.select("h", "t").orderBy("h", "t").limit(SAMPLE_DOCS).distinct()  # texts aren't sent for rows that don't win
    rows = d.join(F.broadcast(keys), ["h", "t"]).groupBy("h", "t").agg(F.min("text").alias("text")).orderBy("h", "t").collect()
    return pickle.dumps(Detector([r["text"] for r in rows]))


@functools.lru_cache(maxsize=2)
def _detector(model: bytes) -> Detector:
    return pickle.loads(model)


def detect(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, spans (array of kind, start, end, base) of every row.

    A null text counts as empty; repeated rows are read each; an empty table gives an empty one;
    columns other than doc_id and text aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_detector = _detector(model)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, every = own_detector.find(text or "")
                own = set(base)
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": (s, k, e) in own} for s, k, e in every])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(text: str, model: bytes, mark: str = "[{}]") -> str:
    """``text`` with every span replaced by its kind; overlapping spans become one mark."""
    out, at = [], 0
    for start, kind, end in _detector(model).find(text)[1]:
        if start >= at:
            out += [text[at:start], mark.format(KINDS[kind].upper())]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents")
    found = detect(docs, fit(docs))
    order = lambda only_base: F.sort_array(
        F.transform(
            F.filter("spans", lambda x: x["base"]) if only_base else F.col("spans"),
            lambda x: F.struct(x["start"], F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("n"), x["kind"].alias("k"), x["end"]),
        )
    )
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: (x["kind"] == kind) & x["base"])).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(order(True)), 256).alias("base_sha256"), text(order(False)).alias("spans"))


SQL = None  # boosted trees; tests hold the base spans against a plain reading of the rules
