"""Shared plumbing: the shared folder, written intermediate tables, Arrow text buffers, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="tessel-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def materialize(df: DataFrame, keep: bool = True) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; it goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep:
        atexit.register(drop_path, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessel_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_tessel_path", None)
    if path:
        drop_path(df.sparkSession, path)


def hold(df: DataFrame) -> DataFrame:
    """Computed once, on the executors' disks, for several later plans; what a lost executor held is computed again from its lineage.  ``DataFrame.unpersist`` ends it."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def files(rows: int, per_file: int = 1 << 20) -> int:
    """In how many files a narrow table of about ``rows`` rows is written."""
    return 1 + rows // per_file


def give_back() -> None:
    """Freed memory of this Python process goes back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, whose workers give their memory back at the end of a task: Spark keeps them for later stages."""

    def given_back(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(given_back, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(df: DataFrame, floor: int = 1) -> int:
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def labels_of(parts: int) -> np.ndarray:
    """For each of ``parts`` hash partitions an INT key that Spark's repartition(parts, key) sends there, so packed rows spread evenly."""
    k = np.arange(64 * parts + 256, dtype=np.uint32)
    rot = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    h = rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = rot(np.uint32(42) ^ h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    at = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % parts
    found, first = np.unique(at, return_index=True)
    out = np.arange(parts)
    out[found] = first
    return out.astype(np.int32)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's text, modulo m; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and its n+1 offsets, without copying where possible."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = int(off[0]) if len(off) else 0
    return buf[base : int(off[-1]) if len(off) else 0], (off - base).astype(np.int64)


def slices(off: np.ndarray, most: int, rows: int = 1 << 62) -> list[tuple[int, int]]:
    """Runs of whole rows with about ``most`` bytes and at most ``rows`` rows each; a longer row stands alone."""
    out, n, i = [], len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n, i + rows)
        out.append((i, j))
        i = j
    return out


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
HASH_P = 0x9E3779B97F4A7C15
_POW: dict = {}


def powers(n: int, base: int = HASH_P) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _POW.get(base)
    if got is None or len(got[0]) < n:
        m = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        inv = pow(base, -1, 1 << 64)
        got = tuple(np.concatenate([one, np.multiply.accumulate(np.full(m, x, np.uint64))]) for x in (base, inv))
        _POW[base] = got
    return got[0][:n], got[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(buf: np.ndarray, base: int = HASH_P) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf), base)[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = HASH_P) -> np.ndarray:
    """A 64-bit hash of buf[start:end], from prefix_hash."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix), base)[1][start] + (end - start).astype(np.uint64))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word; words never cross rows.  Second value of rows: offsets by row."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    inw = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inw[:-1]]) & ~edge[:-1]
    start = np.flatnonzero(inw & ~before)
    after = np.concatenate([inw[1:], [False]]) & ~edge[1:]
    end = np.flatnonzero(inw & ~after) + 1
    return start, end, np.searchsorted(start, off).astype(np.int64)


def min_label_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) with the smallest node reachable, for every node that has a link.

    Alternating large-star and small-star rounds over (a, b) links; each round is written to the shared folder in few files, which
    cuts plan and lineage.  A round never gathers a node's links: it takes the smallest neighbour by a partial aggregation
    and joins it back; the joins of a hub's links are ones that adaptive execution splits.  The rounds end when count and checksum
    of the links stay the same.
    """
    mark = lambda p: tuple(p.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    pairs = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().repartition(files(edges.count())))
    told = mark(pairs)
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b")
        after = materialize(small.where("a <> b").distinct().repartition(files(told[0])))
        now = mark(after)
        release(pairs)
        pairs, same, told = after, now == told, now
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.groupBy("a").agg(F.min("b").alias("label"))
    found = nodes.select(F.col("a").alias("node"), "label").union(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    found = materialize(found.repartition(files(2 * told[0])))
    release(pairs)
    return found
