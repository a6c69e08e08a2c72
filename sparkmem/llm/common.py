"""Helpers shared by the training-data operators: Arrow text access, word positions, shared-folder tables, components."""

from __future__ import annotations

import ctypes
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import free_disk, scratch_path  # noqa: F401

SLICE_BYTES = 1 << 20      # text handled at once inside a task; a longer single text is handled alone
BATCH_ROWS = "1000"        # rows per Arrow batch (long texts make small batches necessary)


def arrow_conf(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (survives a lost executor)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def folder_of(table: DataFrame) -> str | None:
    """The folder of a table that ``written`` gave."""
    files = table.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def spread(spark: SparkSession, n_bytes: int, per_task: int = 16 << 20, least: int = 12) -> int:
    """Number of partitions for ``n_bytes`` of work: grows with the data."""
    return max(least, math.ceil(n_bytes / per_task))


def block_numbers() -> Iterator[int]:
    """Numbers for the blocks of a task: unique over its stage, and the same when a lost task runs again."""
    from pyspark import TaskContext
    task = TaskContext.get()
    return itertools.count((task.partitionId() if task else 0) << 32)


# --------------------------------------------------------------------------
# Arrow text
# --------------------------------------------------------------------------
def return_freed_memory() -> None:
    """Hand memory of freed arrays back to the system.

    Python workers outlive a stage and are reused; without this, what a stage's largest arrays took stays with them.
    """
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):            # glibc
        libc.malloc_trim(0)


def lean(run):
    """The same ``mapInArrow`` function, which hands freed memory back at the end of a task."""
    def wrapped(batches):
        yield from run(batches)
        return_freed_memory()
    return wrapped


def lean_groups(run):
    """The same for a function of ``applyInPandas``."""
    def wrapped(key, pdf):
        out = run(key, pdf)
        return_freed_memory()
        return out
    return wrapped


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64[n+1], bytes uint8) of a string column; a null counts as empty."""
    return_freed_memory()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = off[0]
    return off - base, data[base:off[-1]]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most ``most`` bytes each, at least one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(offsets: np.ndarray, data: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes that are no gaps (space and 0x09-0x0D by default); words end at row ends."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~gaps[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True                       # a row begins (or the buffer ends) here
    prev = np.empty_like(ink)
    prev[0] = False
    prev[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~prev | first[:-1]))
    nxt = np.empty_like(ink)
    nxt[-1] = False
    nxt[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~nxt | first[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


# odd multiplier of a polynomial modulo 2^64, its inverse, and the finishing multipliers of a 64-bit mixer
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_POW: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64 (kept in the worker, grown by doubling)."""
    key = "inv" if inverse else "pow"
    have = _POW.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, _BINV if inverse else _B, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size > (8 << 20):                    # of one very long text only: not worth keeping
            return have
        _POW[key] = have
    return have


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one prefix sum over the buffer."""
    n = len(data)
    with np.errstate(over="ignore"):
        s = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n)[:n], out=s[1:])
        h = (s[end] - s[start]) * powers(n + 1, inverse=True)[start]
        return mix64(h + (end - start).astype(np.uint64) * _M2)


def clustered_ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Concatenated aranges lo[i]..hi[i]-1."""
    n = hi - lo
    total = int(n.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = n > 0
    lo, n = lo[keep], n[keep]
    at = np.cumsum(n)[:-1]
    out[0] = lo[0]
    out[at] = lo[1:] - (lo[:-1] + n[:-1] - 1)
    return np.cumsum(out)


# --------------------------------------------------------------------------
# Connected components
# --------------------------------------------------------------------------
def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph of edges u-v: each node (but the root) with the smallest node it reaches here."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[:len(u)], inv[len(u):]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], m)
        np.minimum.at(label, label[b], m)
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _forest_batches(batches):
    us, vs = [], []
    held = 0
    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
        held += b.num_rows
        if held > 2_000_000:                    # keep the partition's forest only, never all its edges
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)
            if held > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                us, vs, held = [], [], 0
    if us:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node with an edge; component = smallest node reachable.

    ``edges`` has long columns u, v. Each round links nodes to the smallest neighbour of their
    neighbourhood (large star, then small star) and is written to the shared folder, so the lineage
    stays short; the number of rounds grows with the logarithm of the longest chain. Edges between
    partitions are first reduced to one forest per partition. No node's neighbours are gathered:
    minima are aggregates, and joins on a hot node are split by adaptive execution.
    """
    local = edges.where("u <> v").mapInArrow(_forest_batches, "u long, v long")
    e = written(local, name)
    last = None
    while True:
        sym = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low2, "u")
        small = (j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low2.select("u", F.col("m").alias("v"))).distinct())
        e = written(small, name)
        # a fixed point has the same edges: the count and two order-free digests of the edge set stay equal
        digest = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                             F.bit_xor(F.xxhash64("v", "u"))).first())
        if digest == last:
            break
        last = digest
    low = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = low.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return low.select(F.col("u").alias("node"), "component").unionAll(roots)
