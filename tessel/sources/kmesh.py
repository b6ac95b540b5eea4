"""Binary mesh files: ``KMSH``, u32 version 1, u32 vertices, u32 faces, f64[3 v], u32[3 f], little-endian; and exact output tables."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"KMSH", 1


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(vertices n x 3 doubles, faces m x 3 ids); raises on anything that is not a whole file of version 1."""
    if data[:4] != MAGIC:
        raise ValueError("not a mesh file")
    version, nv, nf = struct.unpack_from("<III", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version} is not known")
    if len(data) != 16 + 24 * nv + 12 * nf:
        raise ValueError("the file is cut short or too long")
    v = np.frombuffer(data, "<f8", 3 * nv, 16).reshape(-1, 3)
    f = np.frombuffer(data, "<u4", 3 * nf, 16 + 24 * nv).reshape(-1, 3).astype(np.int64)
    if nf and f.max() >= nv:
        raise ValueError("a face names a vertex that is not there")
    return v, f


def encode(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    return MAGIC + struct.pack("<III", VERSION, len(vertices), len(faces)) + np.ascontiguousarray(vertices, "<f8").tobytes() + np.ascontiguousarray(faces, "<u4").tobytes()


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v, f = decode(data)
                x = v if what == "vertices" else f
                ids = pa.array(np.arange(len(x), dtype=np.int64))
                kind = pa.float64() if what == "vertices" else pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), ids, *(pa.array(x[:, k], kind) for k in range(3))], names=names)

    names = ["model_id", "vid", "x", "y", "z"] if what == "vertices" else ["model_id", "tid", "v0", "v1", "v2"]
    kinds = ["string", "long"] + (["double"] * 3 if what == "vertices" else ["long"] * 3)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("model_id"), "content")
    return files.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """model_id (file name), vid, x, y, z.  One task a file; files are read by Spark, so any store that it knows."""
    return _read(spark, path, "vertices")


def read_triangles(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "triangles")


def write_exact(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """Exact meshes as two Parquet tables; points are canonical integer quadruples."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    triangles.write.mode("overwrite").parquet(f"{path}/triangles")


def read_exact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/triangles")
