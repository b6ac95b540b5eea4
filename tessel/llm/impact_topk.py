"""Exact top-k search: an impact-ordered index, processed score at a time.

Vectors of integers are dealt into shards of about ``shard`` vectors.  A shard's index has, for every dimension, its vectors sorted by
value and cut into ``LEVELS`` posting segments.  For a query, values are counted from the end that its sign makes
worst, so every contribution is at least 0; a segment's impact is the largest contribution in it.  Segments are processed by descending impact (of equal ones in a dimension the best end first),
adding exact contributions to accumulators.  What remains is bounded by the sum over dimensions of the next segment's impact.
Processing stops only on proof that few vectors can reach the k-th best accumulator, and those are rescored exactly.
Each shard gives its k best; the k best of these are the answer.

Queries are dealt in blocks and meet every shard once: (shard, block) pairs of packed rows, as a stated query set needs.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without vec_id; shorter
vectors count as padded with zeros; where components are so large that sums may pass 62 bits, vectors are scored plainly and scores beyond a long stop at its ends; a query never gets rows of its own vec_id; ties go to the smaller vec_id; repeated
rows are separate candidates, and a repeated query id is one query for each distinct vector of smallest order (the first); empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize

LEVELS = 4
OUT = "query_id long, vec_id long, score long"


class Index:
    """One shard: ids and an integer matrix."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, self.dim = x.shape
        self.levels = min(LEVELS, n)
        self.cut = np.linspace(0, n, self.levels + 1).astype(np.int64)
        order = np.argsort(x, axis=0, kind="stable")
        self.by_value = np.ascontiguousarray(order.T.astype(np.intp))
        self.values = np.ascontiguousarray(np.take_along_axis(x, order, 0).T.astype(np.int64))
        self.low = self.values[:, 0] if n else np.zeros(self.dim, np.int64)
        self.high = self.values[:, -1] if n else np.zeros(self.dim, np.int64)
        self.first, self.last = self.values[:, self.cut[:-1]], self.values[:, self.cut[1:] - 1]
        # what a unit of weight adds, counted from the worst value of the dimension: for weights above 0 and below
        wide = np.int64 if n and int(np.abs(self.values).max()) >= 1 << 12 else np.int32
        self.from_low = (self.values - self.low[:, None]).astype(wide)
        self.from_high = (self.values - self.high[:, None]).astype(wide)

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact scores of the k best, of score then smaller id."""
        up = q >= 0
        # the largest contribution of each segment; segments of a dimension from the best end
        impact = np.where(up[:, None], q[:, None] * (self.last - self.low[:, None]), q[:, None] * (self.first - self.high[:, None]))
        # ties inside a dimension from the best end too, so that the segment after the last one read bounds all that is unread
        placed = np.where(up[:, None], impact[:, ::-1], impact)
        rank = np.argsort(-placed, axis=None, kind="stable")
        rank = np.where(up[rank // self.levels], rank + self.levels - 1 - 2 * (rank % self.levels), rank)
        left = impact.max(1)
        remaining = int(left.sum())
        kind = np.int32 if self.from_low.dtype == np.int32 and remaining < 1 << 29 else np.int64
        acc = np.zeros(len(self.ids), kind)
        acc[self.ids == own] = np.iinfo(kind).min // 2
        weight = q.astype(kind)
        possible = None
        check = remaining // 3
        flat = impact.ravel()
        cut, signs = self.cut.tolist(), np.sign(q).tolist()
        for d, s in zip((rank // self.levels).tolist(), (rank % self.levels).tolist(), strict=True):
            w = signs[d]
            if w == 0:
                continue
            a, b = cut[s], cut[s + 1]
            acc[self.by_value[d, a:b]] += (self.from_low if w > 0 else self.from_high)[d, a:b] * weight[d]
            after = s - 1 if w > 0 else s + 1
            now = int(flat[d * self.levels + after]) if 0 <= after < self.levels else 0
            remaining -= int(left[d]) - now
            left[d] = now
            if remaining <= check and len(acc) > 4 * k:
                kth = np.partition(acc, len(acc) - k)[len(acc) - k]
                if np.count_nonzero(acc >= kth - remaining) <= max(4 * k, len(acc) // 6):
                    possible = np.flatnonzero(acc >= kth - remaining)
                    break
                check = remaining * 3 // 4
        if possible is None:
            floor = np.partition(acc, len(acc) - k)[len(acc) - k] if len(acc) > k else np.iinfo(kind).min
            possible = np.flatnonzero(acc >= floor)
        possible = possible[self.ids[possible] != own]
        exact = (self.x[possible].astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if kind == np.int32 else self.x[possible] @ q  # doubles hold these products exactly
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible][best], exact[best]


def plainly(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As Index.search for components whose products may pass 62 bits: every vector in Python's integers, scores beyond a long at its ends."""
    keep = np.flatnonzero(ids != own)
    score = [sum(a * b for a, b in zip(x[i].tolist(), q.tolist(), strict=True)) for i in keep.tolist()]
    best = sorted(range(len(score)), key=lambda i: (-score[i], int(ids[keep[i]])))[:k]
    return ids[keep[best]], np.array([min(max(score[i], -(1 << 63)), (1 << 63) - 1) for i in best], np.int64)


def _unpack(t: pa.Table, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    ids, data = t["ids"].to_pylist(), t["data"].to_pylist()
    if not ids:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
    return np.concatenate([np.frombuffer(x, np.int64) for x in ids]), np.concatenate([np.frombuffer(x, kind).reshape(-1, dim) for x in data]).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = 32768, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score.  Both inputs: vec_id long, v array<long> without nulls; the queries are rows of the vectors."""
    m = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).first()
    n, dim = m["n"], max(m["dim"] or 1, 1)
    most = max(abs(m["high"] or 0), abs(m["low"] or 0))
    kind, exact = np.int32 if most < 1 << 31 else np.int64, 4 * most * most * dim < 1 << 62
    asked = max(1, queries.count())
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // block))

    def packed(df: DataFrame, into: str, count: int) -> DataFrame:
        """Rows of at most ``block`` vectors each, packed where they are read, then once more by their group."""
        group = F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")

        def pack(t: pa.Table) -> pa.Table:
            x = np.zeros((len(t), dim), kind)
            for i, v in enumerate(t["v"].to_pylist()):
                x[i, : len(v)] = v
            order = np.argsort(np.asarray(t["vec_id"]), kind="stable")
            return pa.table({into: pa.array([t[into][0].as_py()], pa.int32()), "ids": pa.array([np.asarray(t["vec_id"])[order].tobytes()], pa.binary()), "data": pa.array([x[order].tobytes()], pa.binary())})

        return df.select(group.alias(into), F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")).groupBy(into).applyInArrow(pack, f"{into} int, ids binary, data binary")

    index = materialize(packed(vectors, "shard", shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wanted = materialize(packed(queries, "block", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, x = _unpack(a, dim, kind)
        q_ids, q = _unpack(b, dim, kind)
        out: list[list] = [[], [], []]
        if len(ids):
            find = Index(ids, x).search if exact else lambda *a: plainly(ids, x, *a)
            first = np.concatenate([[True], q_ids[1:] != q_ids[:-1]]) if len(q_ids) else np.zeros(0, bool)
            for i in np.flatnonzero(first):
                hit, score = find(q[i], int(q_ids[i]), k)
                out[0] += [int(q_ids[i])] * len(hit)
                out[1] += hit.tolist()
                out[2] += score.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    near = index.groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInArrow(search, OUT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def integers(df: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; rows that take no part are left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def op5_topk(spark, sf_dir: str) -> DataFrame:
    v = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(v, v.where("vec_id % 20 = 0"))


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
