"""The plane dictionary: proportional planes share an id; which way round a plane stands is kept beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact as X


RAW = ["_pa", "_pb", "_pc", "_pd"]
KEY = ["_ka", "_kb", "_kc", "_kd"]
RATIO_BITS = 26


def canonical(plane: tuple[X.Exact, ...]) -> dict:
    """Columns a, b, c, d (gcd taken out, first non-zero coefficient positive) and flipped."""
    g = X.gcd(list(plane)).cast(X.DECIMAL)
    flipped = X.leading_negative(plane)
    out = {}
    for name, p in zip("abcd", plane, strict=True):
        v = p.at(127)
        q = F.when(g == 0, v).otherwise((v / F.when(g == 0, F.lit(1)).otherwise(g)).cast(X.DECIMAL))
        out[name] = F.when(flipped, -q).otherwise(q).cast(X.DECIMAL)
    out["flipped"] = flipped
    return out


def keyed(rows: DataFrame, plane: tuple[X.Exact, ...]) -> DataFrame:
    """``rows`` with the coefficients (RAW), a key (KEY) that only proportional planes share, and flipped.

    Up to RATIO_BITS bits the key is the coefficients over the first that is not zero, as doubles: two different fractions of such numbers differ by
    more than a double's rounding, so all proportional planes share it.  Beyond, it is the coefficients themselves.
    """
    rows = rows.withColumns({c: p.col for c, p in zip(RAW, plane, strict=True)})
    if max(p.bits for p in plane) > RATIO_BITS:
        keys = {k: F.col(c) for k, c in zip(KEY, RAW, strict=True)}
    else:
        lead = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in RAW], F.lit(1)).cast("double")
        keys = {k: F.col(c).cast("double") / lead + F.lit(0.0) for k, c in zip(KEY, RAW, strict=True)}
    own = tuple(X.Exact(F.col(c), p.bits) for c, p in zip(RAW, plane, strict=True))
    return rows.withColumns(keys | {"flipped": X.leading_negative(own)})


def canonical_keys(with_keys: DataFrame, plane: tuple[X.Exact, ...]) -> DataFrame:
    """KEY with a, b, c, d: divisors are worked out once a key, in columns of their own."""
    own = tuple(X.Exact(F.col(c), p.bits) for c, p in zip(RAW, plane, strict=True))
    one = with_keys.groupBy(*KEY).agg(F.min(F.struct(*RAW)).alias("_p")).select(*KEY, "_p.*")
    g = one.withColumn("_g", X.gcd(list(own)).cast(X.DECIMAL)).withColumn("_neg", X.leading_negative(own))
    out = {}
    for name, p in zip("abcd", own, strict=True):
        q = F.when(F.col("_g") == 0, p.at(127)).otherwise((p.at(127) / F.when(F.col("_g") == 0, F.lit(1)).otherwise(F.col("_g")).cast(X.DECIMAL)).cast(X.DECIMAL))
        out[name] = F.when(F.col("_neg"), -q).otherwise(q).cast(X.DECIMAL)
    return g.withColumns(out).select(*KEY, "a", "b", "c", "d")


def intern(rows: DataFrame, plane: tuple[X.Exact, ...]) -> tuple[DataFrame, DataFrame]:
    """(dictionary: plane_id, a, b, c, d; rows with plane_id and flipped).  Ids number the distinct planes in their own order.

    The numbering window sees distinct planes only; ids are range-partitioned ranks, not one task's row numbers.
    """
    from .mesh import checkpoint

    with_keys = keyed(rows, plane)
    keys = checkpoint(canonical_keys(with_keys, plane))
    ids = number(keys.select("a", "b", "c", "d").distinct(), ["a", "b", "c", "d"], "plane_id")
    known = keys.join(ids, ["a", "b", "c", "d"]).select(*KEY, "plane_id")
    return ids, with_keys.join(known, KEY).drop(*RAW, *KEY)


def number(distinct: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 in the given order: range partitions, counts by partition, then a rank inside each."""
    from .mesh import checkpoint

    placed = checkpoint(distinct.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_from")
    inside = Window.partitionBy("_part").orderBy(*order)
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_from") + F.row_number().over(inside) - 1).drop("_part", "_from")


def find(ids: DataFrame, rows: DataFrame, plane: tuple[X.Exact, ...]) -> DataFrame:
    """Rows with the plane_id of their plane, null where the dictionary lacks it."""
    with_keys = keyed(rows, plane)
    known = canonical_keys(with_keys, plane).join(ids, ["a", "b", "c", "d"], "left").select(*KEY, "plane_id")
    return with_keys.join(known, KEY).drop(*RAW, *KEY)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """One dictionary of two: plane_id, a, b, c, d and the ids in either, old_first and old_second."""
    cols = ["a", "b", "c", "d"]
    both = first.withColumnRenamed("plane_id", "old_first").join(second.withColumnRenamed("plane_id", "old_second"), cols, "full")
    return number(both, cols, "plane_id")
