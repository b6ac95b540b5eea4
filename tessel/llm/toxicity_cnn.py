"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of learned rows for the hash of the whole word and of its first 4 to 7 bytes (shorter words: the
whole word again), so endings do not hide a stem.  Filters of widths 1, 2 and 3 words slide over the whole text; each filter's largest
response in the document (max pooling) feeds a logistic unit.  Trained in numpy by Adam; max pooling sends gradients to at most
one place per filter and document.

Thresholds are calibrated by language: on all labelled rows that were not trained on (a fifth of the sample and whatever is outside it), the logit with the best F1
among the documents of each language that the text itself shows (votes of common words, never the lang column), all documents where a
language has fewer than 20 toxic ones.  They come from distributed counts of logits in steps of 1/1024.  The logit is shifted so that this threshold scores 0.7.

Bounds (parameters): training on at most ``sample`` labelled rows, those with the smallest hash of doc_id.  Scoring
reads every whole text where it lies, once for the thresholds and once for the result; no text is shuffled but the sample's.

Defined results: empty and null texts have no words and get the score of an empty pool; repeated rows score equally; of several labels of a doc_id the greatest counts;
null doc_ids are never learnt from; with fewer than 8 labelled rows, or only one label, every score is 0; extra columns pass through.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import LOWER, crc_mod, give_back, map_arrow, mix64, prefix_hash, slices, span_hash, text_buffer, word_spans

TABLE_BITS = 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
HEADS = (4, 5, 6, 7)
CUT = 0.7
STEPS = 1024
COMMON = (
    ("the", "and", "of", "to", "in", "that", "is", "with", "was", "are"),
    ("der", "die", "und", "das", "von", "nicht", "mit", "auf", "ist", "zu"),
    ("le", "la", "et", "les", "des", "du", "que", "dans", "est", "une"),
    ("el", "los", "las", "que", "de", "y", "su", "para", "con", "del"),
)
SCALAR = {4: 0x51ED270B, 5: 0x3C6EF372, 6: 0x1B873593, 7: 0x2545F491, 0: 0x9E3779B1}


def one_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0])


VOTES = tuple(np.sort(np.array([one_hash(w) for w in words], np.uint64)) for words in COMMON)


def word_ids(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words x 5) embedding rows, row offsets, language by row (index in COMMON).  Trailing ASCII punctuation is no part of a word."""
    buf = LOWER[buf]
    start, end, by_row = word_spans(buf, off)
    if not len(start):
        return np.zeros((0, 1 + len(HEADS)), np.int32), by_row, np.zeros(len(off) - 1, np.int64)
    for _ in range(4):
        last = buf[end - 1]
        end = end - ((end - start > 1) & (last < 127) & ~((last >= 97) & (last <= 122)) & ~((last >= 48) & (last <= 57)))
    h = prefix_hash(buf)
    whole = span_hash(h, start, end)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    ids = np.empty((len(start), 1 + len(HEADS)), np.int32)
    ids[:, 0] = mix64(whole + np.uint64(SCALAR[0])) & mask
    for k, n in enumerate(HEADS):
        part = span_hash(h, start, np.minimum(start + n, end))
        ids[:, k + 1] = mix64(part + np.uint64(SCALAR[n])) & mask
    votes = []
    for words in VOTES:
        at = np.minimum(np.searchsorted(words, whole), len(words) - 1)
        c = np.concatenate([[0], np.cumsum(words[at] == whole)])
        votes.append(c[by_row[1:]] - c[by_row[:-1]])
    return ids, by_row, np.argmax(np.stack(votes), axis=0)


class Cnn:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.1, (1 << TABLE_BITS, DIM)).astype(np.float32)
        self.W = [rng.normal(0, 0.5 / np.sqrt(DIM * w), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.o = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.shift = np.zeros(len(COMMON))
        self.trained = False
        self.learnt: list = []

    def embed(self, ids: np.ndarray) -> np.ndarray:
        x = self.E[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x = x + self.E[ids[:, k]]
        return x

    def responses(self, x: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
        """Responses of the filters of one width at each word, -1 where the window leaves the document."""
        w = WIDTHS[k]
        n = len(x)
        r = np.full((n, FILTERS), -1, np.float32)
        if n >= w:
            y = sum(x[j : n - w + 1 + j] @ self.W[k][j * DIM : (j + 1) * DIM] for j in range(w)) + self.b[k]
            r[: n - w + 1] = np.maximum(y, 0)
        for j in range(1, w):
            at = off[1:] - j
            r[at[at >= off[:-1]]] = -1
        return r

    def pooled(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(off[1:] > off[:-1])
        out = np.zeros((len(off) - 1, len(WIDTHS) * FILTERS), np.float32)
        if len(full):
            for k in range(len(WIDTHS)):
                m = np.maximum.reduceat(self.responses(x, off, k), off[full], axis=0)
                out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(m, 0)
        return out

    def logits(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.pooled(self.embed(ids), off) @ self.o + self.c[0]

    def score(self, ids: np.ndarray, off: np.ndarray, lang: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(off) - 1)
        z = self.logits(ids, off).astype(float) + self.shift[lang]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, ids: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int = 9, batch: int = 64, rate: float = 0.01, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        dense = [*self.W, *self.b, self.o, self.c]
        m, v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
        em, ev = np.zeros_like(self.E), np.zeros_like(self.E)
        step = 0
        for epoch in range(epochs):
            lr = rate * 0.5 ** (epoch / 6)
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                take = np.concatenate([np.arange(off[r], off[r + 1]) for r in rows])
                if not len(take):
                    continue
                o = np.concatenate([[0], np.cumsum(off[rows + 1] - off[rows])])
                w_ids = ids[take]
                x = self.embed(w_ids)
                full = np.flatnonzero(o[1:] > o[:-1])
                pool = np.zeros((len(rows), len(WIDTHS) * FILTERS), np.float32)
                best = np.zeros((len(rows), len(WIDTHS) * FILTERS), np.int64)
                for k in range(len(WIDTHS)):
                    r = self.responses(x, o, k)
                    top = np.maximum.reduceat(r, o[full], axis=0)
                    row_of = np.repeat(np.arange(len(full)), np.diff(o)[full])
                    at = np.where(r == top[row_of], np.arange(len(x))[:, None], len(x))
                    best[full, k * FILTERS : (k + 1) * FILTERS] = np.minimum.reduceat(at, o[full], axis=0)
                    pool[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
                drop = (rng.random(pool.shape) > 0.2) / np.float32(0.8)
                z = (pool * drop) @ self.o + self.c[0]
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                dp = d[:, None] * self.o * drop * (pool > 0)
                grads = []
                e_rows, e_grad = [], []
                gb = []
                for k, w in enumerate(WIDTHS):
                    r, f = np.nonzero(dp[:, k * FILTERS : (k + 1) * FILTERS])
                    g = dp[r, k * FILTERS + f].astype(np.float32)
                    at = best[r, k * FILTERS + f]
                    gw = np.zeros_like(self.W[k])
                    for j in range(w):
                        block = np.zeros((FILTERS, DIM), np.float32)
                        np.add.at(block, f, g[:, None] * x[at + j])
                        gw[j * DIM : (j + 1) * DIM] = block.T
                        e_rows.append(w_ids[at + j])
                        e_grad.append(g[:, None] * self.W[k][j * DIM : (j + 1) * DIM].T[f])
                    grads.append(gw + 1e-5 * self.W[k])
                    gb.append(np.bincount(f, weights=g, minlength=FILTERS).astype(np.float32))
                grads += [*gb, (pool * drop).T @ d + 1e-4 * self.o, np.array([d.sum()], np.float32)]
                step += 1
                for p, g, mm, vv in zip(dense, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    p -= lr * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-7)
                er, eg = np.concatenate(e_rows), np.concatenate(e_grad)
                if len(er):
                    u, inv = np.unique(er.ravel(), return_inverse=True)
                    g = np.zeros((len(u), DIM), np.float32)
                    np.add.at(g, inv.ravel(), np.repeat(eg, er.shape[1], axis=0))
                    em[u] += 0.1 * (g - em[u])
                    ev[u] += 0.01 * (g * g - ev[u])
                    self.E[u] -= lr * em[u] / (np.sqrt(ev[u] / (1 - 0.99**step)) + 1e-7)
        self.trained = True


def f1_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the gap below it."""
    order = np.argsort(-z)
    s, hits = z[order], np.cumsum(y[order] > 0)
    f = 2 * hits / (np.arange(1, len(s) + 1) + max((y > 0).sum(), 1))
    k = int(np.argmax(f))
    return float(s[k] - 0.5 if k == len(s) - 1 else (s[k] + s[k + 1]) / 2)


def learn(known: DataFrame) -> Cnn:
    """Train on doc_id, text, label, in one task: the sample is bounded, and only the model comes to the driver."""

    def encode(batches):
        for b in batches:
            buf, off = text_buffer(b.column(1))
            out, langs = [], []
            for i, j in slices(off, 1 << 22):
                ids, rows, lang = word_ids(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                out += [ids[rows[k] : rows[k + 1]].astype(np.uint16).tobytes() for k in range(j - i)]
                langs.append(lang)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(out, pa.binary()), pa.array(np.concatenate(langs) if langs else np.zeros(0, np.int64)).cast(pa.int32())], names=["doc_id", "y", "x", "lang"])

    def train(batches):
        some = [b for b in batches if len(b)]
        model = fitted(pa.Table.from_batches(some)) if some else Cnn()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], names=["model"])

    encoded = map_arrow(known.select("doc_id", "text", "label"), encode, "doc_id long, y int, x binary, lang int")
    found = map_arrow(encoded.repartition(1), train, "model binary").first()
    model = Cnn()
    vars(model).update(pickle.loads(found["model"]) if found else {})
    return model


def fitted(got: pa.Table) -> Cnn:
    """The model trained on doc_id, y, x (words), lang of the sample; rows of one id in the order of their words."""
    order = pc.sort_indices(got, [("doc_id", "ascending"), ("y", "ascending"), ("x", "ascending")]).to_numpy()
    y, lang, names = np.asarray(got["y"])[order].astype(float), np.asarray(got["lang"])[order], np.asarray(got["doc_id"])[order].tolist()
    model = Cnn()
    if len(y) < 8 or y.min() == y.max():
        return model
    words = got["x"].cast(pa.large_binary()).combine_chunks()  # all rows' words stay in one buffer; only what is trained on is copied
    del got
    give_back()
    width = 1 + len(HEADS)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] // (2 * width)
    every = np.frombuffer(words.buffers()[2] or b"", np.uint16).reshape(-1, width)

    def pack(ks):
        rows = order[ks]
        return np.concatenate([every[at[r] : at[r + 1]] for r in rows.tolist()]), np.concatenate([[0], np.cumsum(at[rows + 1] - at[rows])])

    test = np.arange(len(y)) % 5 == 0
    if y[test].min() == y[test].max() or y[~test].min() == y[~test].max():
        test = np.ones(len(y), bool)
        train = np.arange(len(y))
    else:
        train = np.flatnonzero(~test)
    ids, off = pack(train)
    model.fit(ids, off, y[train])
    model.learnt = [names[k] for k in train.tolist()]
    held = np.flatnonzero(test)
    ids, off = pack(held)
    z = model.logits(ids, off).astype(float)
    base = np.log(CUT / (1 - CUT))
    for k in range(len(COMMON)):
        mine = lang[held] == k
        mine = mine if (y[held][mine] > 0).sum() >= 20 else np.ones(len(held), bool)
        model.shift[k] = base - f1_cut(z[mine], y[held][mine])
    return model


def calibrate(model: Cnn, docs: DataFrame, labels: DataFrame) -> None:
    """Thresholds by language over every labelled row that was not trained on; ``learn``'s stay where these show one label only."""

    def count(batches):
        for b in batches:
            b = b.filter(pc.invert(pc.is_in(b.column(0), value_set=pa.array(model.learnt, b.column(0).type))))
            buf, off = text_buffer(b.column(1))
            step, langs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in slices(off, 1 << 21):
                ids, rows, lang = word_ids(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                step.append(np.floor(np.clip(model.logits(ids, rows).astype(float), -40, 40) * STEPS).astype(np.int64))
                langs.append(lang)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(langs)), pa.array(np.concatenate(step))], names=["doc_id", "lang", "step"])

    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    seen = map_arrow(docs.where("doc_id is not null").select("doc_id", "text"), count, "doc_id long, lang long, step long").join(known, "doc_id")
    got = seen.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0).alias("hits")).toArrow()
    lang, step, n, hits = (np.array(got[c].to_pylist(), np.int64) for c in ("lang", "step", "n", "hits"))
    if not 0 < hits.sum() < n.sum():
        return
    for k in range(len(COMMON)):
        mine = lang == k
        mine = mine if hits[mine].sum() >= 20 else np.ones(len(lang), bool)
        model.shift[k] = np.log(CUT / (1 - CUT)) - counted_cut(step[mine], n[mine], hits[mine])


def counted_cut(step: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """``f1_cut`` on counts by step."""
    s = np.unique(step)[::-1]
    at = np.searchsorted(-s, -step)
    n, hits = np.bincount(at, n, len(s)), np.bincount(at, hits, len(s))
    k = int(np.argmax(2 * np.cumsum(hits) / (np.cumsum(n) + max(hits.sum(), 1))))
    return float(s[k] / STEPS - 0.5 if k == len(s) - 1 else (s[k] + s[k + 1] + 1) / (2 * STEPS))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``.  ``labels``: doc_id, label; the caller keeps held-out rows away from it."""
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label")
    model = learn(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most ``sample`` rows of two numbers
    if model.trained:
        calibrate(model, docs, labels)
    docs = docs.drop("score", "predicted")
    schema = T.StructType(docs.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column(b.schema.get_field_index("text")))
            s = [model.score(*word_ids(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in slices(off, 1 << 21)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[f.name for f in schema.fields])

    return map_arrow(docs, run, schema)


def known_labels(labels: DataFrame) -> DataFrame:
    """The rows that op6 may learn from."""
    return labels.where(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").alias("label"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = classify(docs, known_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
