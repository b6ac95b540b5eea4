"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (whole text; the last one shorter).  Each passage is encoded by
what its words look like (shares of capitals, digits, symbols and marks, word lengths, repeats, line breaks, a signed hash of
its words into 16 sums).  A tanh layer, then gated attention a ~ softmax(w . (tanh(V h) * sigmoid(U h))) learned from the document labels
alone, weighs the passages; the weighted passage is scored by a logistic unit.  Trained in numpy by Adam.

Bounds (parameters): at most ``sample`` labelled rows, those with the smallest hash of doc_id; a fifth of them
calibrates: the logit is shifted so that the cut with the best balanced accuracy scores 0.3.  Scoring reads every whole text where it lies;
nothing is shuffled but the sample.

Defined results: empty and null texts are one passage of zero words and get a score like any other; null doc_ids are
never learnt from and are scored (held_out false); repeated rows score equally; of several labels of a doc_id the greatest counts; with fewer than 8 labelled rows, or only one label, every score
is 0.5; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import SPACE, crc_mod, prefix_hash, slices, span_hash, text_buffer, word_spans

PASSAGE = 64
HASHED = 16
N_FEATURES = 15 + HASHED
CUT = 0.3


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.float64)
    t[list(chars)] = 1
    return t


CLASSES = (_table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789"), _table(b"#*$%&<>"), _table(b"|"), _table(b"!?"), _table(b".,;:"), _table(bytes(range(128, 256))))


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features by passage, and the row offsets of the passages; every row has one at least."""
    start, end, by_row = word_spans(buf, off)
    n_rows = len(off) - 1
    words = np.diff(by_row)
    count = np.maximum(1, -(-words // PASSAGE))
    p_off = np.concatenate([[0], np.cumsum(count)])
    p = np.arange(p_off[-1])
    row = np.repeat(np.arange(n_rows), count)
    first = by_row[row] + (p - p_off[row]) * PASSAGE
    last = np.minimum(first + PASSAGE, by_row[row + 1])
    n = np.maximum(last - first, 0)
    some = n > 0
    x = np.zeros((len(p), N_FEATURES), np.float32)
    if len(start):
        from_, to = start[np.minimum(first, len(start) - 1)], end[np.maximum(last - 1, 0)]
        from_, to = np.where(some, from_, 0), np.where(some, to, 0)
        size = np.maximum(to - from_, 1)
        for k, t in enumerate(CLASSES):
            c = np.concatenate([[0], np.cumsum(t[buf])])
            x[:, k] = (c[to] - c[from_]) / size
        breaks = np.concatenate([[0], np.cumsum(buf == 10)])
        x[:, 8] = (breaks[to] - breaks[from_]) / np.maximum(n, 1)
        blank = np.concatenate([[0], np.cumsum(SPACE[buf])])
        x[:, 9] = (size - (blank[to] - blank[from_])) / np.maximum(n, 1) / 8
        h = span_hash(prefix_hash(buf), start, end)
        same = np.zeros(len(h) + 1)
        same[2:] = np.cumsum(h[1:] == h[:-1])
        x[:, 10] = (same[last] - same[np.minimum(first + 1, last)]) / np.maximum(n - 1, 1)
        of = np.repeat(p, n)
        pair = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        x[:, 11] = np.bincount((pair[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(p)) / np.maximum(n, 1)
        head = (buf[start] >= 65) & (buf[start] <= 90)
        heads = np.concatenate([[0], np.cumsum(head)])
        x[:, 12] = (heads[last] - heads[first]) / np.maximum(n, 1)
        tail = CLASSES[3][buf[end - 1]] + CLASSES[5][buf[end - 1]]
        tails = np.concatenate([[0], np.cumsum(tail)])
        x[:, 13] = (tails[last] - tails[first]) / np.maximum(n, 1)
        bucket, sign = (h % np.uint64(HASHED)).astype(np.int64), 1 - 2 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.int64)
        sums = np.bincount(of * HASHED + bucket, weights=sign.astype(float), minlength=len(p) * HASHED)
        x[:, 15:] = sums.reshape(-1, HASHED) / np.sqrt(np.maximum(n, 1))[:, None] / 4
    x[:, 14] = np.log1p(n) / 4
    return x, p_off


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, off[:-1], axis=0)


class Mil:
    """Encoder W, gates V and U, attention w, logistic unit o."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"W": n(N_FEATURES, hidden), "b": np.zeros(hidden), "V": n(hidden, gate), "U": n(hidden, gate), "w": n(gate, 1)[:, 0], "o": n(hidden, 1)[:, 0], "c": np.zeros(1)}
        self.mean, self.scale, self.shift = np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.0
        self.trained = False

    def forward(self, x: np.ndarray, off: np.ndarray):
        p = self.p
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, off[:-1])[row])
        a = e / sums(e, off)[row]
        z = sums(a[:, None] * h, off)
        return row, h, t, g, a, z, z @ p["o"] + p["c"][0]

    def gradient(self, x: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        row, h, t, g, a, z, logit = self.forward(x, off)
        dl = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / weight.sum()
        dz = dl[:, None] * p["o"]
        dh = a[:, None] * dz[row]
        da = (h * dz[row]).sum(1)
        de = a * (da - sums(a * da, off)[row])
        dt, dg = de[:, None] * p["w"] * g, de[:, None] * p["w"] * t
        dt, dg = dt * (1 - t * t), dg * g * (1 - g)
        dh = dh + dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - h * h)
        return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "o": z.T @ dl, "c": np.array([dl.sum()])}

    def fit(self, x: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                take = np.concatenate([np.arange(off[r], off[r + 1]) for r in rows])
                o = np.concatenate([[0], np.cumsum(off[rows + 1] - off[rows])])
                grad = self.gradient(x[take], o, y[rows], weight[rows])
                step += 1
                for k in self.p:
                    d = grad[k] + 1e-5 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.p[k] = self.p[k] - rate * (0.5 ** (epoch / 15)) * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.trained = True

    def logits(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, off)[-1] + self.shift

    def score(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not self.trained or len(off) < 2:
            return np.full(len(off) - 1, 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(x, off), -40, 40)))


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best balanced accuracy, in the middle of its gap."""
    order = np.argsort(logit)
    s, t = logit[order], y[order] > 0
    gain = np.concatenate([[t.sum() / max(t.sum(), 1)], (t.sum() - np.cumsum(t)) / max(t.sum(), 1) + np.cumsum(~t) / max((~t).sum(), 1)])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(best[len(best) // 2])
    return float(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)


def learn(known: DataFrame, label: str, sample: int, passages_of=passages) -> Mil:
    """Train on ``known`` (doc_id, text, label)."""
    rows = known.select("doc_id", "text", label)

    def encode(batches):
        for b in batches:
            buf, off = text_buffer(b.column(1))
            out = []
            for i, j in slices(off, 1 << 22):
                x, p_off = passages_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                out += [x[p_off[k] : p_off[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(encode, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    model = Mil()
    y = np.array(got["y"].to_pylist(), float)
    if len(y) < 8 or y.min() == y.max():
        return model
    bags = [np.frombuffer(v, np.float32).reshape(-1, N_FEATURES) for v in got["x"].to_pylist()]
    test = np.arange(len(y)) % 5 == 0
    pack = lambda ks: (np.concatenate([bags[k] for k in ks]).astype(float), np.concatenate([[0], np.cumsum([len(bags[k]) for k in ks])]))
    train = np.flatnonzero(~test)
    if y[train].min() == y[train].max():
        train = np.arange(len(y))
    x, off = pack(train)
    model.fit(x, off, y[train])
    held = np.flatnonzero(test) if test.any() and y[test].min() < y[test].max() else train
    x, off = pack(held)
    model.shift = float(np.log(CUT / (1 - CUT))) - best_cut(model.logits(x, off), y[held])
    return model


def classify(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``.  ``labels``: doc_id, label; the caller keeps held-out rows away from it."""
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label")
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    model = learn(known, "label", sample)
    docs = docs.drop("score", "predicted")
    schema = T.StructType(docs.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column(b.schema.get_field_index("text")))
            s = [model.score(*passages(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in slices(off, 1 << 22)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = classify(docs, labels)
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
