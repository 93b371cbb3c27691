r"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, overlapping ones too: what looks like an address with ``@`` or a spelt-out
"at", three or more numbers with dots, other marks or a spelt-out "dot" between, and runs of seven or more digits with
marks between, once as a card and once as a phone. Features of format (lengths, digits, groups, checks that hold) and of context (the characters around, words
like "phone" before) go to boosted trees of two splits, one model for all kinds, fitted by gradient steps on the logistic loss.

There are no labelled spans, so the model learns from the strict patterns: candidates that hold a strict match of
their kind are positive, and so are copies of those with the format disturbed (no plus sign, "at" for ``@``, other
marks or "dot" between numbers); the other candidates are negative, and so are broken copies of positive ones (an IP
address that lacks a number or has one that is too large, a card number with another last digit). Documents are split by a hash: trees see one part, and on
the other a threshold for each kind is calibrated, the least score at which at least ``PRECISION`` of the candidates
are positive; a kind without one, or with fewer than ``LEAST`` positive candidates there, adds nothing. Selected candidates are added where they overlap no other span of their
kind; strict matches always stay.

Fitting takes all texts: their examples, as levels of features, are counted once, and gradients are summed over these counts on
the cluster. ``train`` with a number of documents fits on a drawn sample instead, whose kinds count by the inverse of the share drawn.
Spans are looked for in all whole texts.
Null text counts as empty and has no spans; rows that repeat get equal spans; extra columns are ignored; an empty
table gives an empty result. An address is found from its ``@``, and digits from the start of their run; spans are
compared with their neighbours only, in order of place. Time is about linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import scratch
from edgeloom.llm.rows import mapped, of_texts

KINDS = ("email", "ip", "card", "phone")
OF_KIND = 400
LEAST = 20
LONGEST = 1 << 20
TREES, RATE = 40, 0.3
PRECISION = 0.98
#: Levels of a feature: level k ends at CUTS[k]; LEVELS are values within them. UNIT of a sum of gradients, and steps of a threshold's logit.
CUTS = np.array([*(k - 0.5 for k in range(25)), 28.5, 32.5, 40.5, 64.5, 128.5, 255.5])
LEVELS = np.append(CUTS, CUTS[-1] + 1)
UNIT, STEP = 1 << 20, 64

#: The strict patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a match never starts within digits: it takes them all or fails for all
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]")
#: The generators' wider patterns.
SPELT_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:[\[({<]at[\])}>]| at )\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({<]dot[\])}>]\s?| dot )[A-Za-z0-9-]{1,63})+")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:[.,:_][0-9]{1,4}){2,8}")
SPELT_DOT = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:[-,:_]|\s?[\[({]?(?:\.|dot)[\])}]?\s?)[0-9]{1,3}){3}(?![0-9])")
NUMBERS = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().0-9/_-]{5,40})[0-9](?![0-9])")
WORDS = {k: re.compile(w, re.I) for k, w in {"email": r"mail|contact|write", "ip": r"\bip\b|host|addr|server", "card": r"card|visa|credit|pay|karte|carte|tarjeta", "phone": r"phone|tel|call|fax|mobil|ruf"}.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def strict(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strict patterns: leftmost, not overlapping within a kind, by kind and start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGITS.search(text) is None:
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


def candidates(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans, the strict ones among them, in order."""
    out = list(found)
    if "at" in text:
        out += [("email", m.start(), m.end()) for m in SPELT_AT.finditer(text)]
    if DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in DOTTED.finditer(text)]
        out += [("ip", m.start(), m.end()) for m in SPELT_DOT.finditer(text)]
        for m in NUMBERS.finditer(text):
            n = sum(map(m[0].count, "0123456789"))
            out += [("phone", m.start(), m.end())] * (7 <= n <= 16) + [("card", m.start(), m.end())] * (12 <= n <= 20)
    return sorted(set(out))


class Spans:
    """Spans of one kind that don't overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.spans = sorted(spans)

    def overlaps(self, a: int, z: int) -> bool:
        at = bisect_left(self.spans, (a, a))
        return at < len(self.spans) and self.spans[at][0] < z or at > 0 and a < self.spans[at - 1][1]

    def within(self, a: int, z: int) -> tuple[int, int] | None:
        """The first span that a..z holds."""
        at = bisect_left(self.spans, (a, 0))
        return self.spans[at] if at < len(self.spans) and self.spans[at][1] <= z else None

    def add(self, a: int, z: int) -> None:
        insort(self.spans, (a, z))


def by_kind(found: list[tuple[str, int, int]]) -> dict[str, Spans]:
    return {k: Spans([(a, z) for kind, a, z in found if kind == k]) for k in KINDS}


def features(kind: str, s: str, before: str, after: str) -> list[float]:
    """Of the span s; before: some of the text before it, after: what follows."""
    digits = re.sub("[^0-9]", "", s)
    groups = re.findall("[0-9]+", s)
    marks = re.sub("[A-Za-z0-9]", "", s)
    return [
        float(KINDS.index(kind)), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(marks), len(set(marks)),
        float(s.startswith("+")), float("(" in s), float("@" in s), float(" at " in s or "at]" in s or "at)" in s), s.count("."), s.count("-"), s.count(" "),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(before[-1:].isalnum()), float(before[-1:] in ("", " ", "\n", "\t")), float(after.isalnum()), float(after in ("", " ", "\n", ".", ",", "\t")),
        float(bool(WORDS[kind].search(before))), float(digits[:1] or -1), len(s.rpartition(".")[2]), float("dot" in s),
    ]


def _around(text: str, a: int, z: int) -> tuple[str, str]:
    return text[max(0, a - 30) : a], text[z : z + 1]


def disturbed(kind: str, s: str, i: int) -> str | None:
    """A positive span in another format; i picks which."""
    if kind == "email":
        return s.replace("@", (" at ", " [at] ", "(at)")[i % 3])
    if kind == "ip":
        return s.replace(".", ("[.]", " . ", " dot ", ",", "-", "(dot)")[i % 6])
    if kind == "phone":
        return (s.lstrip("+"), s.replace(" ", "-"), s.replace(" ", "."), s.replace("(", "").replace(")", ""), re.sub(r"^\+[0-9]{1,3}\s+", "", s))[i % 5]
    if kind == "card" and " " not in s and "-" not in s:
        return (" " if i % 2 else "-").join(s[k : k + 4] for k in range(0, len(s), 4))
    return None


def broken(kind: str, s: str, i: int) -> str | None:
    """What looks like a positive span and is none; i picks which."""
    if kind == "ip":
        first, _, rest = s.partition(".")
        return rest if i % 2 else f"{300 + i % 700}.{rest}"
    if kind == "card":
        return s[:-1] + str((int(s[-1]) + 1 + i % 9) % 10)
    return None


def examples(text: str, salt: int) -> list[tuple[list[float], int]]:
    found = strict(text)
    own, out = by_kind(found), []
    for k, a, z in candidates(text, found):
        hit, around = own[k].within(a, z), _around(text, a, z)
        out.append((features(k, text[a:z], *around), int(hit is not None)))
        if hit == (a, z) and (s := disturbed(k, text[a:z], salt + a)):
            out.append((features(k, s, *around), 1))
        if hit == (a, z) and (s := broken(k, text[a:z], salt + a)):
            out.append((features(k, s, *around), 0))
    return out


@dataclass
class Model:
    """trees: (feature, cut, then for each side feature, cut and two leaves); thresholds by kind."""

    start: float = -9.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, c, left, right in self.trees:
            low = x[:, f] <= c
            for side, (g, d, a, b) in ((low, left), (~low, right)):
                out[side] += np.where(x[side, g] <= d, a, b)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _split(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[int, float, float]:
    """Feature, cut and gain of the best split of rows with gradients g and curvatures h."""
    best, whole = (0, np.inf, 0.0), g.sum() ** 2 / (h.sum() + 1)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        at = np.searchsorted(c, x[:, f], "left")  # x <= c[k] where at <= k
        gl, hl = np.cumsum(np.bincount(at, g, len(c) + 1))[:-1], np.cumsum(np.bincount(at, h, len(c) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
        if gain.max() > best[2] + 1e-12:
            best = (f, float(c[gain.argmax()]), float(gain.max()))
    return best


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """calibrate: which rows the trees don't see, for the thresholds. weight: of the rows in those; all alike without."""
    m = Model()
    tx, ty = x[~calibrate], y[~calibrate]
    if not len(ty) or ty.min() == ty.max():
        return m
    m.start = float(np.log(ty.mean() / (1 - ty.mean())))
    cuts = [(u[1:] + u[:-1]) / 2 if len(u := np.unique(np.quantile(tx[:, f], np.linspace(0, 1, 33)))) > 1 else np.empty(0) for f in range(x.shape[1])]
    raw = np.full(len(ty), m.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = ty - p, p * (1 - p)
        f, c, gain = _split(tx, cuts, g, h)
        if gain <= 1e-9:
            break
        low, sides = tx[:, f] <= c, []
        for side in (low, ~low):
            k, d, _ = _split(tx[side], cuts, g[side], h[side])
            under = tx[side, k] <= d
            sides.append((k, d, *(float(RATE * g[side][w].sum() / (h[side][w].sum() + 1)) for w in (under, ~under))))
        m.trees.append((f, c, *sides))
        raw = m.raw(tx)
    s, cy, w = m.scores(x[calibrate]), y[calibrate], np.ones(calibrate.sum()) if weight is None else weight[calibrate]
    for k, kind in enumerate(KINDS):
        own = (x[calibrate][:, 0] == k) & (w > 0)
        order = np.argsort(-s[own], kind="stable")
        right = np.cumsum((w * cy)[own][order]) / np.cumsum(w[own][order])
        ends = np.append(np.diff(s[own][order]) != 0, True) if own.any() else np.empty(0, bool)  # equal scores stand or fall together
        good = np.flatnonzero(ends & (right >= PRECISION))
        if len(good) and cy[own].sum() >= LEAST:
            m.thresholds[kind] = float(s[own][order][good[-1]])
    return m


def _kinds(texts: list) -> list:
    """The kinds of each text's strict matches, a bit for each."""
    return [[sum({1 << KINDS.index(k) for k, _, _ in strict(t or "")}) for t in texts]]


def _drawn(some: DataFrame, most: int, each: int) -> dict[int, list[float]]:
    """The documents to learn from, and what each weighs in calibrating each kind: 0 where it was drawn for other kinds only."""
    ids, _ = scratch.save(of_texts(some, {"kinds": pa.int32()}, lambda: _kinds).groupBy("doc_id").agg(F.bit_or("kinds").alias("kinds")), "kinds")
    has = lambda k: F.col("kinds").bitwiseAND(F.lit(1 << k)) != 0
    total, *of = ids.agg(F.count(F.lit(1)), *(F.count_if(has(k)) for k in range(len(KINDS)))).first()
    first = lambda rows, n: rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n).collect()
    base = {r["doc_id"]: r["kinds"] for r in first(ids, most)}
    own = [{r["doc_id"]: r["kinds"] for r in first(ids.where(has(k)), each)} for k in range(len(KINDS))]
    out: dict[int, list[float]] = {i: [1.0] * len(KINDS) for i in base}
    for i in {i for rows in own for i in rows} - set(base):
        out[i] = [0.0] * len(KINDS)
    for k, rows in enumerate(own):
        if set(rows) <= set(base):
            continue  # the base has as many
        others = sum(not kinds >> k & 1 for kinds in base.values())
        for i in out:
            if i in rows:
                out[i][k] = of[k] / len(rows)  # the base's documents of the kind come first among them
            elif i in base:
                out[i][k] = (total - of[k]) / others
    return out


def _histograms(rows: DataFrame, model: Model, at: tuple[int, float] | None = None) -> np.ndarray:
    """Of rows(x, y, n), gradients and curvatures by feature and level; with a split, of each of its sides. Summed in whole units, so in any order alike."""

    def run(x: pa.Array, y: pa.Array, n: pa.Array) -> list:
        codes = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1)
        v, y, n = LEVELS[codes], y.to_numpy(), n.to_numpy()
        p = model.scores(v)
        sums = [np.rint((y - p) * n * UNIT), np.rint(p * (1 - p) * n * UNIT)]
        sides = [np.ones(len(v), bool)] if at is None else [v[:, at[0]] <= at[1], v[:, at[0]] > at[1]]
        out = [[[np.bincount(codes[side, j], s[side], len(LEVELS)) for j in range(codes.shape[1])] for s in sums] for side in sides]
        return [[np.array(out).tobytes()]]

    got = mapped(rows.select("x", "y", "n"), {"h": pa.binary()}, lambda: run, size=1 << 16).collect()
    return sum(np.frombuffer(r["h"]) for r in got).reshape(1 if at is None else 2, 2, -1, len(LEVELS)) / UNIT


def _cut(hist: np.ndarray) -> tuple[int, float, float, float, float]:
    """Feature, cut and gain of the best split by a histogram, and the leaves of its sides."""
    (g, h), (sg, sh) = np.cumsum(hist, 2)[:, :, :-1], hist[:, 0].sum(1)
    gain = g**2 / (h + 1) + (sg - g) ** 2 / (sh - h + 1) - sg**2 / (sh + 1)
    f, k = np.unravel_index(gain.argmax(), gain.shape)
    if gain[f, k] <= 1e-9:
        return 0, np.inf, 0.0, float(RATE * sg / (sh + 1)), 0.0
    return int(f), float(CUTS[k]), float(gain[f, k]), float(RATE * g[f, k] / (h[f, k] + 1)), float(RATE * (sg - g[f, k]) / (sh - h[f, k] + 1))


def vectors(docs: DataFrame) -> DataFrame:
    """held, x (a byte for each feature, its level), y, n: the examples of all texts, equal ones counted."""

    def run(helds: pa.Array, salts: pa.Array, texts: pa.Array) -> list:
        n: Counter = Counter()
        for held, salt, text in zip(helds.to_pylist(), salts.to_pylist(), texts.to_pylist(), strict=True):
            if own := examples(text, salt):
                codes = np.searchsorted(CUTS, np.array([v for v, _ in own])).astype(np.uint8)
                n.update((held, c.tobytes(), y) for c, (_, y) in zip(codes, own, strict=True))
        return [[held for held, _, _ in n], [x for _, x, _ in n], [y for _, _, y in n], list(n.values())]

    hashed = lambda seed, m: F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(m))
    rows = docs.where("text is not null").select((hashed(4, 3) == 0).alias("held"), hashed(5, 1 << 30).alias("salt"), "text")
    each = mapped(rows, {"held": pa.bool_(), "x": pa.binary(), "y": pa.int32(), "n": pa.int64()}, lambda: run)
    return each.groupBy("held", "x", "y").agg(F.sum("n").alias("n"))


def train_on_all(docs: DataFrame) -> Model:
    """The trees of the texts that are not held out, and thresholds of all that are: a pass over the texts, then sums over their counted vectors for each level of a tree."""
    rows, where = scratch.save(vectors(docs), "vectors")
    seen, m = rows.where("not held"), Model()
    total, right = seen.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
    if not total or right in (0, total):
        return m
    m.start = float(np.log(right / (total - right)))
    for _ in range(TREES):
        f, c, gain, _, _ = _cut(_histograms(seen, m)[0])
        if gain <= 1e-9:
            break
        m.trees.append((f, c, *((j, d, a, b) for j, d, _, a, b in map(_cut, _histograms(seen, m, (f, c))))))

    def run(x: pa.Array, y: pa.Array, n: pa.Array) -> list:
        v = LEVELS[np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1)]
        return [[round(k) for k in v[:, 0] - 0.5], [int(s) for s in np.floor(m.raw(v) * STEP)], y, n]

    steps = mapped(rows.where("held").select("x", "y", "n"), {"kind": pa.int32(), "step": pa.int32(), "y": pa.int32(), "n": pa.int64()}, lambda: run, size=1 << 16)
    got = steps.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("right")).collect()
    for k, kind in enumerate(KINDS):
        own = sorted(((r["step"], r["n"], r["right"]) for r in got if r["kind"] == k), reverse=True)
        n, right = (np.cumsum([r[i] for r in own]) for i in (1, 2))
        if len(own) and right[-1] >= LEAST and len(good := np.flatnonzero(right >= PRECISION * n)):
            m.thresholds[kind] = float(1 / (1 + np.exp(-own[good[-1]][0] / STEP))) - 1e-12
    scratch.drop(docs.sparkSession, where)
    return m


def train(docs: DataFrame, most: int | None = None, each: int = OF_KIND) -> Model:
    """Of all documents; with most, of that many and ``each`` more of each kind."""
    if most is None:
        return train_on_all(docs)
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null").where(F.octet_length("text") <= LONGEST)
    some = rows.where(F.col("text").rlike(r"@|[0-9][^A-Za-z]{5}[0-9]| at .{1,60} dot "))
    drawn = _drawn(some, most, each)
    ids = docs.sparkSession.createDataFrame([(i,) for i in drawn], "__id long")
    held = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(3)) == 0

    def run(ids: pa.Array, helds: pa.Array, texts: pa.Array) -> list:
        every = [examples(t, i) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
        return [ids, helds, [np.array([v for v, _ in e]).tobytes() for e in every], [np.array([v for _, v in e], float).tobytes() for e in every]]

    got = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    got = mapped(got.select("doc_id", held.alias("held"), "t.text"), {"doc_id": pa.int64(), "held": pa.bool_(), "x": pa.binary(), "y": pa.binary()}, lambda: run).where("length(y) > 0")
    got = sorted(got.collect(), key=lambda r: r["doc_id"])
    if not got:
        return Model()
    y = [np.frombuffer(r["y"]) for r in got]
    x = [np.frombuffer(r["x"]).reshape(len(v), -1) for r, v in zip(got, y, strict=True)]
    weight = [np.array(drawn[r["doc_id"]])[v[:, 0].astype(int)] for r, v in zip(got, x, strict=True)]
    return fit(np.concatenate(x), np.concatenate(y), np.repeat([r["held"] for r in got], [len(v) for v in y]), np.concatenate(weight))


def spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Strict spans, and all spans."""
    found = strict(text)
    own, every = by_kind(found), list(found)
    more = [(k, a, z) for k, a, z in candidates(text, found) if k in model.thresholds and not own[k].overlaps(a, z)]
    if more:
        s = model.scores(np.array([features(k, text[a:z], *_around(text, a, z)) for k, a, z in more]))
        for score, (k, a, z) in sorted(zip(s, more, strict=True), key=lambda v: (-v[0], v[1])):
            if score >= model.thresholds[k] and not own[k].overlaps(a, z):
                own[k].add(a, z)
                every.append((k, a, z))
    key = lambda c: (KINDS.index(c[0]), c[1])
    return sorted(found, key=key), sorted(every, key=key)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with [kind] for each span, or for spans that overlap the first one's kind."""
    out, at = [], 0
    for k, a, z in sorted(found, key=lambda c: (c[1], -c[2])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the strict spans, as are the counts), spans for each row of docs(doc_id, text)."""
    model = train(docs)
    said = lambda c: ",".join(f"{k}:{a}:{z}" for k, a, z in c)

    def run(texts: list) -> list:
        rows = []
        for text in texts:
            base, every = spans(text or "", model)
            rows.append((*(sum(c[0] == k for c in base) for k in KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(every)))
        return [list(c) for c in zip(*rows, strict=True)]

    fields = {f"n_{k}": pa.int64() for k in KINDS} | {"base_sha256": pa.string(), "spans": pa.string()}
    return of_texts(docs, fields, lambda: run)
