"""SimHash near-dedup: pivot distance tables over 64-bit fingerprints.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, 3-word shingles with repeats (fewer words: the whole
sequence; none: fingerprint zero), XXH64 with seed 42 each; a bit is set where over half the hashes set it.

Linking, exact for ``reach`` or fewer differing bits: the Hamming distances of each distinct fingerprint to reference fingerprints
(pivots) are its coordinates; by the triangle inequality two linked fingerprints differ by at most ``reach`` in every
coordinate.  The first coordinates, as many as the number of fingerprints asks for, are cut into cells of
``WIDTH``; a fingerprint within ``reach`` above a cell's lower edge is entered in the cell below as well, so each linked pair meets
in a cell.  In a cell, pairs are discarded by the largest difference of further coordinates and survivors verified
on the fingerprints.  A cell emits a spanning forest of its links, never its pairs.  A cell over ``most``
fingerprints is dealt out as pairs of its parts.  Components are then taken over the links.

Equal fingerprints are one row from the start (a partial aggregation), so groups of copies cost one comparison.

Defined results: null and empty texts have fingerprint zero and link like any other; component_id is the smallest doc_id
reachable, its own for a lone document; documents without doc_id belong to their fingerprint's component, null when it has no
doc_id at all; repeated rows give equal rows; extra columns pass through ``near_duplicates``, save one named component_id, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import hold, map_arrow, materialize, min_label_components, mix64, n_parts

SHINGLE = 3
WIDTH = 8
CHECKS = 12
SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, hash64) -> int:
    """``hash64(bytes, seed)``: XXH64."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) < SHINGLE:
        h = np.array([hash64(b" ".join(w), 42)], np.uint64)
    else:
        h = np.array([hash64(a + b" " + b + b" " + c, 42) for a, b, c in zip(w, w[1:], w[2:], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(h)).astype(np.uint64) << SHIFTS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches):
        import xxhash

        for b in batches:
            fp = np.array([fingerprint(t, xxhash.xxh64_intdigest) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def pivots(n: int, seed: int = 2024) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def enter_cells(fp: np.ndarray, grid: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, cell) with every cell that it is entered in."""
    who, cell = np.arange(len(fp)), np.zeros(len(fp), np.uint64)
    for k, pivot in enumerate(grid):
        d = np.bitwise_count(fp ^ pivot).astype(np.int64) + (3 * k) % WIDTH
        box, low = d // WIDTH, d % WIDTH < reach
        at = low[who]
        boxes = np.concatenate([box[who], box[who][at] - 1])
        cell = np.concatenate([cell, cell[at]])
        who = np.concatenate([who, who[at]])
        cell = mix64(cell * np.uint64(31) + (boxes + 2).astype(np.uint64))
    return who, cell


def links_in_cell(fp: np.ndarray, rep: np.ndarray, table: np.ndarray, reach: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among a cell's fingerprints, as pairs of representatives.  table: distances to the check pivots."""
    m = len(fp)
    left, right = [], []
    for i in range(0, m, block):
        a = slice(i, min(m, i + block))
        far = np.abs(table[0, a, None] - table[0, None, i:]) <= reach
        far &= np.abs(table[1, a, None] - table[1, None, i:]) <= reach
        x, y = np.nonzero(far)
        x, y = x + i, y + i
        ok = x < y
        x, y = x[ok], y[ok]
        for c in range(2, len(table), 2):
            ok = np.maximum(np.abs(table[c, x] - table[c, y]), np.abs(table[c + 1, x] - table[c + 1, y])) <= reach
            x, y = x[ok], y[ok]
        ok = np.bitwise_count(fp[x] ^ fp[y]) <= reach
        left.append(x[ok])
        right.append(y[ok])
    x, y = np.concatenate(left), np.concatenate(right)
    label = np.arange(m)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    hung = np.flatnonzero(label != np.arange(m))
    return rep[hung], rep[label[hung]]


def pivot_links(known: DataFrame, n: int, reach: int = 2, per_cell: int = 64, most: int = 2048) -> DataFrame:
    """(a, b) links of ``known`` (fp, rep; ``n`` rows, each fp once) that connect all whose fingerprints differ in ``reach`` bits or fewer."""
    depth = 0 if n <= 2 * per_cell else int(np.ceil(np.log(n / per_cell) / np.log(2.2)))
    all_pivots = pivots(depth + CHECKS)
    grid, checks = all_pivots[:depth], all_pivots[depth:]
    parts = n_parts(known)

    def enter(batches):
        for b in batches:
            fp, rep = np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1))
            who, cell = enter_cells(fp, grid, reach)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp[who].view(np.int64)), pa.array(rep[who])], names=["cell", "fp", "rep"])

    cells = hold(map_arrow(known.select("fp", "rep").repartition(parts), enter, "cell long, fp long, rep long"))
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select("cell", F.ceil(F.col("m") / most).alias("r"))
    joined = cells.join(large, "cell", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("r"))
    keys = F.transform(F.sequence(F.lit(0).cast("long"), F.col("r") - 1), lambda j: F.xxhash64(F.col("cell"), F.least(mine, j), F.greatest(mine, j)))
    dealt = joined.select(F.explode(F.when(F.col("r").isNull(), F.array("cell")).otherwise(keys)).alias("cell"), "fp", "rep")

    def link(batches):
        kept = None
        for b in batches:
            t = [np.asarray(b.column(k)) for k in range(3)]
            if kept is not None:
                t = [np.concatenate(x) for x in zip(kept, t, strict=True)]
            cut = np.flatnonzero(np.concatenate([[True], t[0][1:] != t[0][:-1]])) if len(t[0]) else np.zeros(0, np.int64)
            if not len(cut):
                continue
            last = int(cut[-1])
            kept = [x[last:] for x in t]
            yield from out([x[:last] for x in t], cut[:-1], last)
        if kept is not None:
            yield from out(kept, np.array([0]), len(kept[0]))

    def out(t, starts, total):
        if not total:
            return
        fp = t[1].view(np.uint64)
        table = np.stack([np.bitwise_count(fp ^ p).astype(np.int8) for p in checks])
        a, b = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), total], strict=True):
            if e - s > 1:
                x, y = links_in_cell(fp[s:e], t[2][s:e], table[:, s:e], reach)
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    links = hold(map_arrow(dealt.repartition(parts, "cell").sortWithinPartitions("cell"), link, "a long, b long").distinct())
    cells.unpersist()
    return links


def near_duplicates(prints: DataFrame, reach: int = 2, per_cell: int = 64, most: int = 2048) -> DataFrame:
    """``prints`` (doc_id, fp and more) with component_id; a column of that name is replaced."""
    prints = prints.drop("component_id")
    reps = hold(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    links = pivot_links(reps.where("rep is not null"), reps.count(), reach, per_cell, most)
    comps = min_label_components(links)
    links.unpersist()
    found = reps.join(comps, reps["rep"] == comps["node"], "left").where("n > 1 or label is not null")
    found = found.select(F.col("fp").alias("_sh_fp"), F.coalesce("label", "rep").alias("component_id"))
    return prints.join(found, prints["fp"] == found["_sh_fp"], "left").drop("_sh_fp").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(materialize(fingerprints(docs)))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(fps: list[tuple]) -> dict:
    """(doc_id, unsigned fingerprint) to component_id by comparing all pairs, for tests."""
    ids = [d for d, _ in fps]
    fp = np.array([f for _, f in fps], np.uint64)
    label = np.array(ids)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new
