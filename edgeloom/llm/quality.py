"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, a label is the bag's. Every passage (``PASSAGE`` bytes of the text, the rest at the
end a shorter one) is described by what it holds alone: how often its lowered words and its pairs of bytes fall into
each of ``BUCKETS`` hashed buckets, shares of character classes, lengths of words, and repetition within it. A learned
embedding of all these with tanh units encodes it. Gated attention, softmax of w . (tanh(V h) * sigmoid(U h)) over the
passages, gives weights; the weighted sum of the encodings goes to a logistic unit. All is learnt together from document
labels, by Adam on batches of documents, from fixed starting values and in a fixed order, so a model depends on its
sample only.

The model is fitted on all passages of at most ``MAX_TRAIN`` labelled documents (smallest hashes of doc_id), fewer where
those would have more than about ``MAX_PASSAGES`` passages in all; documents of more than ``LONGEST`` passages aren't
learnt from. Scores use all passages of the whole text, ``BLOCK`` at a time, so that a text of any length needs no more
than the text itself. Only text and labels count.

Null or empty text is one passage without characters and has a score; labels that are null or neither 0 nor 1 are not
learnt from, of several labels of a document the smallest counts, of several texts the one of the smallest hash; where
all labels learnt from are alike, or there are none, every score is their mean (1 with none). Rows with null doc_id are
scored and not learnt from; rows that repeat get equal scores; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.rows import bound_batches, of_texts, remainder

PASSAGE = 512
MAX_TRAIN = 4000
MAX_PASSAGES = 40_000
LONGEST = 4096
BLOCK = 512
BUCKETS = 256
HIDDEN, GATE = 12, 8
THRESHOLD = 0.3
#: Character classes of bytes: lower, upper, digit, space, line end, sentence marks, brackets and quotes, other marks, beyond ASCII, control.
CLASSES = 10
WIDTH = 2 * BUCKETS + CLASSES + 5


def _class_of() -> np.ndarray:
    out = np.full(256, 9, np.uint8)
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".,;:!?", b"()[]{}<>\"'`", b"#$%&*+-/=@\\^_|~", range(128, 256))):
        out[list(chars)] = k
    return out


CLASS_OF = _class_of()
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


def passages(size: int) -> np.ndarray:
    """Where the passages of a text of so many bytes start; a last one under a quarter of a passage joins the one before."""
    starts = np.arange(0, max(1, size), PASSAGE)
    return starts[:-1] if len(starts) > 1 and size - starts[-1] < PASSAGE // 4 else starts


def features(raw: bytes, starts: np.ndarray, end: int) -> np.ndarray:
    """A row for each passage of raw that starts there, the last one going up to end."""
    a, n = int(starts[0]), len(starts)
    if not raw:
        return np.zeros((1, WIDTH), np.float32)
    part, ends = np.frombuffer(raw, np.uint8)[a:end], np.append(starts[1:], end)
    size = (ends - starts).astype(np.float32)
    own = np.repeat(np.arange(n), ends - starts)
    cls = CLASS_OF[part]
    counts = np.bincount(own * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES)
    turns = np.bincount(own[1:], (cls[1:] != cls[:-1]) & (own[1:] == own[:-1]), minlength=n)
    low = LOWER[part]
    same = own[1:] == own[:-1]
    pairs = ((low[:-1] * np.uint32(2654435761) + low[1:] * np.uint32(40503)) >> np.uint32(7)) % np.uint32(BUCKETS)
    pairs = np.bincount((own[1:] * BUCKETS + pairs)[same], minlength=n * BUCKETS).reshape(n, BUCKETS)
    split = [raw[x:z].lower().split() for x, z in zip(starts, ends)]
    many = np.array([len(w) for w in split])
    hashed = np.fromiter((h for w in split for h in map(zlib.crc32, w)), np.uint32, int(many.sum())) % np.uint32(BUCKETS)
    words = np.bincount(np.repeat(np.arange(n), many) * BUCKETS + hashed, minlength=n * BUCKETS).reshape(n, BUCKETS)
    breaks = counts[:, 3] + counts[:, 4]
    fresh = [len(set(w)) / max(1, len(w)) for w in split]
    lines = [raw[x:z].split(b"\n") for x, z in zip(starts, ends)]
    unlike = [len(set(x)) / len(x) for x in lines]
    return np.column_stack([
        words / np.sqrt(np.maximum(many, 1))[:, None], pairs / np.sqrt(size)[:, None],
        counts / size[:, None], turns / size, size / PASSAGE, (size - breaks) / (breaks + 1) / 10, fresh, unlike,
    ]).astype(np.float32)


def bag(text: bytes | None) -> np.ndarray:
    """All passages at once: for texts that are learnt from."""
    raw = text or b""
    return features(raw, passages(len(raw)), len(raw))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """mean and scale of the features, then the layers; constant: the score of all where nothing could be learnt."""

    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, text: bytes | None) -> float:
        """Sums over blocks of passages, with the largest attention so far taken out."""
        if self.constant is not None:
            return self.constant
        w, raw = self.layers, text or b""
        starts, top, total, z = passages(len(raw)), -np.inf, 0.0, np.zeros(HIDDEN)
        for at in range(0, len(starts), BLOCK):
            own = starts[at : at + BLOCK]
            x = features(raw, own, len(raw) if at + BLOCK >= len(starts) else int(starts[at + BLOCK]))
            h = np.tanh(((x - self.mean) / self.scale) @ w["e"] + w["eb"])
            a = (np.tanh(h @ w["v"]) * _sigmoid(h @ w["u"])) @ w["w"]
            high = max(top, float(a.max()))
            now, keep = np.exp(a - high), np.exp(top - high)
            top, total, z = high, total * keep + float(now.sum()), z * keep + now @ h
        return float(_sigmoid(z / total @ w["o"] + w["ob"][0]))


def gradient(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss over bags of so many rows of x, and its derivatives."""
    starts = np.cumsum(np.append(0, sizes[:-1]))
    h = np.tanh(x @ w["e"] + w["eb"])
    t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    a = (t * g) @ w["w"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
    a /= np.repeat(np.add.reduceat(a, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = _sigmoid(z @ w["o"] + w["ob"])
    dz = (p - labels) / len(labels)
    spread = np.repeat(dz[:, None] * w["o"], sizes, axis=0)  # by the encoding's weighted sum, to each passage
    da = (spread * h).sum(1)
    da = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    dt, dg = da[:, None] * w["w"] * g * (1 - t**2), da[:, None] * w["w"] * t * g * (1 - g)
    dh = (spread * a[:, None] + dt @ w["v"].T + dg @ w["u"].T) * (1 - h**2)
    loss = -float(np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-12)))
    return loss, {"e": x.T @ dh, "eb": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ da, "o": z.T @ dz, "ob": dz.sum(keepdims=True)}


def start(width: int, seed: int = 5) -> dict[str, np.ndarray]:
    rnd = np.random.RandomState(seed)
    draw = lambda *shape: rnd.normal(0, 1 / np.sqrt(shape[0]), shape)
    return {"e": draw(width, HIDDEN), "eb": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "w": draw(GATE), "o": draw(HIDDEN), "ob": np.zeros(1)}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 14, size: int = 128, rate: float = 0.02, decay: float = 1e-3) -> Model:
    if len(set(labels)) < 2:
        return Model(np.zeros(1), np.ones(1), {}, float(np.mean(labels)) if len(labels) else 1.0)
    every = np.concatenate(bags)
    mean, scale = every.mean(0, dtype=np.float64).astype(every.dtype), (every.std(0, dtype=np.float64) + 0.02).astype(every.dtype)
    del every
    w, rnd, step = start(len(mean)), np.random.RandomState(6), 0
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for epoch in range(epochs):
        order = rnd.permutation(len(bags))
        for at in range(0, len(order), size):
            own = order[at : at + size]
            x = (np.concatenate([bags[i] for i in own]) - mean) / scale
            _, grad = gradient(w, x, np.array([len(bags[i]) for i in own]), labels[own])
            step += 1
            now = rate * (1 - epoch / epochs)
            for k in w:
                g = grad[k] + decay * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                w[k] = w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_passages: int = MAX_PASSAGES) -> Model:
    """From the labels(doc_id, quality) of documents whose crc32(doc_id as text) mod 5 is not 0, at most ``most``, smallest hashes of doc_id first.

    Documents are taken while their passages are at most so many, one at least.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(remainder(F.col("doc_id"), 5) != 0)
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("int").alias("__quality"))
    known = known.orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(2 * most)  # some labels may have no document
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    mark = F.xxhash64("text").alias("h")
    there = docs.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("__id", "__quality", mark, F.octet_length(raw).alias("size")).where(F.col("size") <= LONGEST * PASSAGE)
    there = there.groupBy("__id", "__quality").agg(F.min(F.struct("h", "size")).alias("t"))
    there = there.select("__id", "__quality", F.greatest(F.ceil(F.col("t.size") / PASSAGE), F.lit(1)).alias("n")).orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(most).collect()
    upto = np.cumsum([r["n"] for r in there])
    label = {r["__id"]: r["__quality"] for k, r in enumerate(there) if k == 0 or upto[k] <= most_passages}
    chosen = docs.sparkSession.createDataFrame([(i,) for i in label], "__id long")
    found = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("__id", mark, raw.alias("raw")).where(F.octet_length("raw") <= LONGEST * PASSAGE)
    rows = found.groupBy("__id").agg(F.min(F.struct("h", "raw")).alias("t")).select("__id", "t.raw").collect()
    rows.sort(key=lambda r: r["__id"])
    return fit([bag(bytes(r["raw"])) for r in rows], np.array([label[r["__id"]] for r in rows], float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text). held_out: not learnt from, whether labelled or not."""
    model = train(docs, labels)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = of_texts(rows, {"score": pa.float64()}, lambda: lambda texts: [[model.score(t) for t in texts]])
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose texts score THRESHOLD or more, with all their columns."""
    model = train(docs, labels)
    bound_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return docs.where(score(docs["text"].cast("binary")) >= THRESHOLD)
