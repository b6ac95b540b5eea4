"""Quality rules: an isolation forest over rule statistics.

Rule statistics of a whole text (words are ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words; from them the shares that the forest splits on: characters a word, symbols, capitals and marks a
character.  A forest of random trees is grown on labelled rows that the base rules pass, each tree on ``tree_rows`` drawn rows as the
method has it; a document's score is 2^(-mean path length / expected length), so that what random splits
isolate early scores high.  The threshold comes from all labelled rows that the base rules pass, counted by score in BINS bins: the one
with the best balanced accuracy among those that keep at least ``keep`` of the good ones.

Bounds (parameters): ``trees`` x ``tree_rows``; the driver holds twice that many rows of FEATURES numbers, drawn from all by a hash of
doc_id.  Everything else covers all rows.  Texts are read twice (for the labelled rows' features, then for the results) and not shuffled;
the features are, once.

Defined results: null and empty texts have no words and fail the base rules; null doc_ids pass; repeated rows score
equally; of several labels of a doc_id the greatest counts; without any labelled rows the threshold is 1 (the base rules alone decide); extra columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import materialize, release

BLANK = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = 4
BINS = 1 << 14


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 5-word window that occurs twice or more, the first occurrence included."""
    n = len(words) - 4
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == n:
        return 0
    often = Counter(windows)
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + 5 - max(until, i)
            until = i + 5
    return covered


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts, and the features that the forest splits on."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    dup = len(lines) - len(set(lines))
    rep = repeat_words(words)
    c = max(chars, 1)
    upper = (len(raw) - len(raw.translate(None, UPPER))) / c
    marks = (text.count("!") + text.count("?")) / c
    f = (chars / max(n, 1), symbols / c, upper, marks)
    return (n, chars, symbols, dup, rep), f


def grow(x: np.ndarray, trees: int, rows: int, seed: int) -> tuple[np.ndarray, ...]:
    """Isolation trees as arrays by tree and node: feature (-1: leaf), cut, and path length at a leaf.  Children of i: 2i+1, 2i+2."""
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(rows, 2))))
    size = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, size), -1, np.int64), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, rng.permutation(len(x))[:rows])]
        while todo:
            node, d, idx = todo.pop()
            lo, hi = (x[idx].min(0), x[idx].max(0)) if len(idx) else (np.zeros(x.shape[1]),) * 2
            open_ = np.flatnonzero(hi > lo)
            if d == depth or len(idx) <= 1 or not len(open_):
                length[t, node] = d + expected(len(idx))
                continue
            f = int(rng.choice(open_))
            at = rng.uniform(lo[f], hi[f])
            feature[t, node], cut[t, node] = f, at
            left = x[idx, f] < at
            todo += [(2 * node + 1, d + 1, idx[left]), (2 * node + 2, d + 1, idx[~left])]
    return feature, cut, length


def expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation(x: np.ndarray, forest: tuple[np.ndarray, ...], rows: int) -> np.ndarray:
    """Anomaly score in 0..1 of each row of x."""
    feature, cut, length = forest
    total = np.zeros(len(x))
    at_row = np.arange(len(x))
    for f, c, h in zip(feature, cut, length, strict=True):
        node = np.zeros(len(x), np.int64)
        while True:
            k = f[node]
            inner = k >= 0
            if not inner.any():
                break
            right = x[at_row, np.maximum(k, 0)] >= c[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        total += h[node]
    return np.exp2(-total / len(feature) / max(expected(rows), 1e-9))


def bin_of(score: np.ndarray) -> np.ndarray:
    """Bin k holds scores in (k / BINS, (k + 1) / BINS], and 0 in the first."""
    return np.clip(np.ceil(score * BINS).astype(np.int64) - 1, 0, BINS - 1)


def cut_off(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """Of the numbers of good and bad rows by bin, reject above it: best balanced accuracy among bin ends that keep at least ``keep`` of the good rows."""
    if not good.any() or not bad.any():
        return 1.0
    at = np.flatnonzero(good + bad)
    kept, out = np.cumsum(good)[at] / good.sum(), 1 - np.cumsum(bad)[at] / bad.sum()
    value = np.where(kept >= keep, kept + out, -1)
    return float((at[int(np.argmax(value))] + 1) / BINS) if value.max() > 1 else 1.0


def calibrate(score: np.ndarray, good: np.ndarray, keep: float) -> float:
    at = bin_of(score)
    return cut_off(*(np.bincount(at[x], minlength=BINS) for x in (good, ~good)), keep)


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """good and the features x0.. of every labelled row that the base rules pass; no text is shuffled."""
    known = labels.where("good is not null and doc_id is not null").groupBy("doc_id").agg(F.max("good").cast("int").alias("good"))

    def measure(batches):
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            n = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
            f = np.array([r[1] for r in rows], float).reshape(-1, FEATURES)
            b = pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, k]) for k in range(FEATURES))], names=["doc_id", *(f"x{k}" for k in range(FEATURES))])
            yield b.filter(pa.array(~base_failed(n)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"x{k} double" for k in range(FEATURES)))
    return rows.join(known, "doc_id")


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def judge(docs: DataFrame, labels: DataFrame, trees: int = 100, tree_rows: int = 512, keep: float = 0.975, seed: int = 7) -> DataFrame:
    """``docs`` with the five counts, base_failed, anomaly (double) and kept.  ``labels``: doc_id, good (1 or 0)."""
    xs = [f"x{k}" for k in range(FEATURES)]
    passed = materialize(measured(docs, labels))
    n = passed.count()
    threshold, forest = 1.0, None
    if n >= 8:
        # What the trees draw their rows from: all rows, or where they are many, about twice the rows that all trees draw together.
        share = min(1.0, 2 * trees * tree_rows / n)
        x = passed.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select(*xs).toArrow()
        x = np.stack([x[c].to_numpy() for c in xs], 1)
        forest = grow(x[np.lexsort(x.T)], trees, tree_rows, seed)

        def scores(batches):
            total = np.zeros((2, BINS), np.int64)
            for b in batches:
                at = bin_of(isolation(np.stack([b.column(k).to_numpy() for k in range(FEATURES)], 1), forest, tree_rows))
                good = b.column(FEATURES).to_numpy() != 0
                for k, mine in enumerate((~good, good)):
                    total[k] += np.bincount(at[mine], minlength=BINS)
            k, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(total[k, at])], names=["good", "bin", "n"])

        by = passed.select(*xs, "good").mapInArrow(scores, "good long, bin long, n long").groupBy("good", "bin").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros((2, BINS), np.int64)
        total[by["good"].to_numpy(), by["bin"].to_numpy()] = by["n"].to_numpy()
        threshold = cut_off(total[1], total[0], keep)
    release(passed)
    names = [*COUNTS, "base_failed", "anomaly", "kept"]
    docs = docs.drop(*names)
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for b in batches:
            rows = [statistics(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
            f = np.array([r[1] for r in rows], float).reshape(-1, FEATURES)
            score = isolation(f, forest, tree_rows) if forest is not None and len(f) else np.zeros(len(f))
            failed = base_failed(counts)
            new = [pa.array(counts[:, i]) for i in range(5)] + [pa.array(failed), pa.array(score), pa.array(~failed & (score <= threshold))]
            yield pa.RecordBatch.from_arrays(list(b.columns) + new, names=[x.name for x in schema.fields])

    return docs.mapInArrow(run, schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    return judge(docs, labels).drop("text")
