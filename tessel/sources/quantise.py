"""Real coordinates to the integer grid, and model selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantise_vertices(raw: DataFrame, b: int, fill: float = 0.6, rotation: list[float] | None = None, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """raw (model_id, vid, x, y, z doubles) to grid coordinates, with ``weld``, the smallest vid of the equal grid points, and ``out_of_range``.

    Rotate (row-major 3 x 3), scale the largest extent of the model to ``fill`` of the range, move its middle by ``shift`` of that, round half to even,
    clamp.  Models without extent are left out.
    """
    top = float((1 << (b - 1)) - 1)
    r = raw
    if rotation is not None:
        old = [F.col(c) for c in "xyz"]
        r = r.select("model_id", "vid", *[(old[0] * rotation[3 * i] + old[1] * rotation[3 * i + 1] + old[2] * rotation[3 * i + 2]).alias(c) for i, c in enumerate("xyz")])
    ext = r.groupBy("model_id").agg(*[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))])
    ext = ext.withColumn("_ext", F.greatest(*[F.col(f"_h{c}") - F.col(f"_l{c}") for c in "xyz"])).where("_ext > 0").withColumn("_scale", F.lit(fill * top) / F.col("_ext"))
    q = r.join(ext, "model_id")
    out = F.lit(False)
    cols = {}
    for c, s in zip("xyz", shift, strict=True):
        v = (F.col(c) - (F.col(f"_l{c}") + F.col(f"_h{c}")) / 2) * F.col("_scale")
        v = F.rint(v + s * fill * top if s else v)
        out = out | (v < -top - 1) | (v > top)
        cols[c] = F.least(F.greatest(v, F.lit(-top - 1)), F.lit(top)).cast("bigint")
    q = q.select("model_id", "vid", *[v.alias(k) for k, v in cols.items()], out.alias("out_of_range"))
    return q.withColumn("weld", F.min("vid").over(Window.partitionBy("model_id", "x", "y", "z")))


def quantise_triangles(quantised: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of welded ids; triangles that collapse are dropped."""
    ids = quantised.select("model_id", "vid", "weld")
    t = triangles
    for c in ("v0", "v1", "v2"):
        t = t.join(ids.select("model_id", F.col("vid").alias(c), F.col("weld").alias(f"_{c}")), ["model_id", c]).drop(c).withColumnRenamed(f"_{c}", c)
    kept = t.where("v0 <> v1 and v1 <> v2 and v0 <> v2")
    return quantised.where("vid = weld").select("model_id", "vid", "x", "y", "z"), kept.select(*triangles.columns)


def seeded_transform(seed: int) -> tuple[list[float], tuple[float, float, float]]:
    """A reproducible rotation (row-major) and shift (at most 35 % of the range each way) from a 64-bit xorshift* stream."""
    state = (seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & ((1 << 64) - 1) or 1

    def unit() -> float:
        nonlocal state
        state ^= state >> 12
        state = (state ^ (state << 25)) & ((1 << 64) - 1)
        state ^= state >> 27
        return ((state * 0x2545F4914F6CDD1D) & ((1 << 64) - 1)) / float(1 << 64)

    u, v, w = unit(), unit(), unit()
    x, y = math.sqrt(1 - u) * math.sin(2 * math.pi * v), math.sqrt(1 - u) * math.cos(2 * math.pi * v)
    z, s = math.sqrt(u) * math.sin(2 * math.pi * w), math.sqrt(u) * math.cos(2 * math.pi * w)
    rotation = [1 - 2 * (y * y + z * z), 2 * (x * y - z * s), 2 * (x * z + y * s), 2 * (x * y + z * s), 1 - 2 * (x * x + z * z), 2 * (y * z - x * s), 2 * (x * z - y * s), 2 * (y * z + x * s), 1 - 2 * (x * x + y * y)]
    return rotation, tuple(0.7 * unit() - 0.35 for _ in range(3))


def stratify(models: DataFrame, size: str, key: str, strata: int, each: int) -> DataFrame:
    """models with ``stratum`` (1.. by size) and ``rank`` in a seeded order, at most ``each`` a stratum."""
    m = models.withColumn("stratum", F.ntile(strata).over(Window.orderBy(size, key)))
    order = Window.partitionBy("stratum").orderBy(F.pmod(F.col(key) * 2654435761, F.lit(4294967296)), key)
    return m.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
