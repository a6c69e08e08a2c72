"""A stored index of vectors for exact searches and joins: what can't match is ruled out before any matrix moves.

``build_index`` stores vectors in blocks. Pivots (a bounded sample of the vectors, spread out) give every vector its angles; vectors are dealt
to blocks by nearest pivot and angle, so a block holds neighbours, and the block's row has the least and greatest angle to *every* pivot. By
the triangle inequality of angles two vectors are at least ``|angle(x, p) - angle(y, p)|`` apart, so the ranges of two blocks bound the angle of
any pair between them from below.

``near_blocks`` meets those ranges alone: blocks are grouped in pages of bounds, and a pair of pages is compared in numpy; matrices
are not read. ``products`` then sends each matrix once to each tile (a square of neighbouring blocks) that has work for it. The number of tasks
follows the number of tiles, and a task holds one side of a tile and a block of the other. Where the matrices that are sent would be more than the
index has, the tiles are taken in turns, and each turn's shuffle files go before the next.

Matrices are stored as the table has its vectors (floats or doubles). A product of two blocks is first one of floats in the leading directions of
the sample, with what these leave out of a vector as its last entry: by Cauchy and Schwarz it is at least the cosine, so only the pairs that reach
the threshold there are computed in doubles.

Rows whose vector is null, empty, or holds null or non-finite entries are in no index. Vectors meet vectors of their own length only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import COSINE_EPS
from ..session import free_disk, scratch_path

BLOCK_BYTES = 4 << 20      # of a block's matrix (doubles)
LEAST_ROWS = 256           # of a block where there are that many
SPLITS = 16                # blocks a small table is cut into, so that its products are spread over tasks
SORTED_AT_ONCE = 32 << 20  # bytes of vectors that one task sorts into blocks; above that, ranges of them are dealt to tasks
SIDE_BYTES = 32 << 20      # of stored matrices on a side of a tile
LEAST_SIDE, SIDES = 1 << 20, 10    # an index of less than so many full sides is cut into so many, so that its tiles are spread over tasks
TURN_BYTES = 384 << 20     # of matrices sent to tiles at a time, or as many as the indexes have if these are more
TILED_BYTES = 1 << 20      # of a block's matrix (doubles) where blocks meet in tiles only: small rows take less memory on their way
BATCH_BYTES = 4 << 20      # of an Arrow batch
PAGE = 1024                # blocks whose bounds are compared at once
SAMPLE, PIVOTS = 512, 32   # vectors the pivots are chosen from, pivots of one length
GROUP_BYTES = 16 << 20     # of a row group of the stored blocks: a reader holds one whole, and a writer checks only every hundred rows unless told
PRODUCT = 1 << 20          # cosines that a product has at once
LEFT_OUT = 1e-3            # of the sample's squared lengths that its leading directions may leave out
DENSE = 64                 # a product where more than one cosine of so many may reach the threshold is made in doubles at once
SLACK = 1e-6               # of angles, far above rounding
BLOCK_SCHEMA = "block long, dim int, n int, lo array<double>, hi array<double>, keys binary, mat binary"


@dataclass
class VectorIndex:
    """Blocks on the shared folder (BLOCK_SCHEMA; ``keys`` is an Arrow stream of the key columns), their number and rows, and the pivots."""
    blocks: DataFrame
    n_blocks: int
    n_rows: int
    n_bytes: int               # of all matrices (doubles)
    pivots: dict[int, np.ndarray]
    axes: dict[int, np.ndarray]     # leading directions by length of the vectors, where few of them do
    width: int                 # bytes of a stored number: 4 or 8


# --------------------------------------------------------------------------
# Vectors and angles
# --------------------------------------------------------------------------
def vector_groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the usable vectors of a batch."""
    col = batch.column(batch.schema.get_field_index(column))
    length = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        x = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, d)
        usable = np.isfinite(x).all(axis=1)
        if usable.any():
            yield int(d), rows[usable], x[usable]


def units(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1.0)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def pivots_of(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The pivots of a length; one that the sample did not meet has a fixed direction."""
    return pivots[dim] if dim in pivots else np.full((1, dim), 1 / math.sqrt(dim))


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units(x) @ pivots.T, -1.0, 1.0))


def choose_pivots(vectors: Sequence[Sequence[float]]) -> dict[int, np.ndarray]:
    """Per length up to PIVOTS directions of the sample, each the one farthest from those before."""
    by_dim: dict[int, list] = {}
    for v in vectors:
        x = np.array([np.nan if e is None else e for e in v], np.float64)
        if np.isfinite(x).all() and x.any():
            by_dim.setdefault(len(x), []).append(x)
    out = {}
    for d, some in by_dim.items():
        x = units(np.array(some))
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < PIVOTS:
            far = np.minimum(far, angles(x, x[chosen[-1]][None])[:, 0])
            if far.max() < 0.05:
                break
            chosen.append(int(far.argmax()))
        out[d] = x[chosen]
    return out


def leading_axes(vectors: Sequence[Sequence[float]]) -> dict[int, np.ndarray]:
    """Per length the fewest leading directions that leave LEFT_OUT of the sample out, if these are at most half of the length."""
    by_dim: dict[int, list] = {}
    for v in vectors:
        x = np.array([np.nan if e is None else e for e in v], np.float64)
        if np.isfinite(x).all() and x.any():
            by_dim.setdefault(len(x), []).append(x)
    out = {}
    for d, some in by_dim.items():
        _, s, axes = np.linalg.svd(units(np.array(some)), full_matrices=False)
        rest = 1 - np.cumsum(s * s) / (s * s).sum()
        m = int(np.argmax(rest <= LEFT_OUT)) + 1
        if 2 * m <= d and 2 * m <= len(some):
            out[d] = np.ascontiguousarray(axes[:m].T)
    return out


# --------------------------------------------------------------------------
# Building
# --------------------------------------------------------------------------
def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def keys_of(raw) -> pa.RecordBatch:
    """The key columns of a block."""
    return pa.ipc.open_stream(raw).read_next_batch()


def _assign(pivots: dict[int, np.ndarray], schema: pa.Schema):
    """Rows with their length, nearest pivot and angle to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows, x in vector_groups(b, "_v"):
                a = angles(x, pivots_of(pivots, d))
                own = a.argmin(axis=1)
                some = b.take(pa.array(rows))
                cols = {"_dim": pa.array(np.full(len(rows), d, np.int32)), "_cell": pa.array(own.astype(np.int32)),
                        "_angle": pa.array(a[np.arange(len(own)), own])}
                yield pa.RecordBatch.from_arrays([cols[n] if n in cols else some.column(n) for n in schema.names], schema=schema)
    return run


def _pack(pivots: dict[int, np.ndarray], keys: list[str], order: list[str], block_rows: Callable[[int], int], width: int):
    """Blocks of rows that follow one another (of one length; where a cell ends, a block does if it is half full)."""
    names = ["block", "dim", "n", "lo", "hi", "keys", "mat"]

    def block(number: int, d: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        if order:
            t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in order]))
        ((_, _, x),) = vector_groups(t.to_batches()[0], "_v")
        a = angles(x, pivots_of(pivots, d))
        k = t.select(keys).to_batches()[0]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([d], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([a.min(axis=0)]), pa.array([a.max(axis=0)]),
             pa.array([_ipc(k)], pa.binary()), pa.array([x.astype(f"<f{width}").tobytes()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32          # the same again if the task runs again
        held, have, dim, cell = [], 0, -1, -1
        for b in batches:
            if not b.num_rows:
                continue
            dims = b.column(b.schema.get_field_index("_dim")).to_numpy()
            cells = b.column(b.schema.get_field_index("_cell")).to_numpy()
            cut = np.flatnonzero((np.diff(dims) != 0) | (np.diff(cells) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
                lo, hi = int(lo), int(hi)
                room = block_rows(int(dims[lo]))
                if have and (dims[lo] != dim or (cells[lo] != cell and 2 * have >= room)):
                    yield block(number, dim, held)
                    number, held, have = number + 1, [], 0
                dim, cell = int(dims[lo]), int(cells[lo])
                while lo < hi:
                    take = min(hi - lo, room - have)
                    held.append(b.slice(lo, take))
                    lo, have = lo + take, have + take
                    if have == room:
                        yield block(number, dim, held)
                        number, held, have = number + 1, [], 0
        if have:
            yield block(number, dim, held)
    return run


def build_index(df: DataFrame, vec_col: str, key_cols: Sequence[str], order_cols: Sequence[str] = (),
                pivots: dict[int, np.ndarray] | None = None, choose: Callable[[list, int], dict[int, np.ndarray]] | None = None,
                sample: int = SAMPLE, most_rows: int | None = None, block_bytes: int = BLOCK_BYTES, stored: bool = False) -> VectorIndex:
    """Store ``df``'s vectors with their key columns; rows of a block are in the order of ``order_cols``.

    An index that is to meet another is built with the other's ``pivots``; ``choose(vectors of the sample, rows)`` gives others than
    ``choose_pivots``. ``block_bytes`` (doubles) and ``most_rows`` limit a block. A ``stored`` table is cheap to read and not written once more.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    spark, keys = df.sparkSession, list(key_cols)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    usable = df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(*keys, F.col(vec_col).alias("_v"))
    path = None
    if stored:
        base, n = usable, usable.count()
    else:
        seen = Observation()
        path = scratch_path(spark, "vectors")
        usable.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)      # the source is computed once
        n = int(seen.get["n"])
        base = spark.read.schema(usable.schema).parquet(path)
    axes: dict[int, np.ndarray] = {}
    if pivots is None:
        rows = base.select("_v", F.xxhash64(*keys, "_v").alias("_h")).orderBy("_h").limit(sample).select("_v").collect() if n else []
        some = [r[0] for r in rows]
        pivots, axes = choose(some, n) if choose else choose_pivots(some), leading_axes(some[:SAMPLE])
    width = 4 if isinstance(usable.schema["_v"].dataType.elementType, T.FloatType) else 8

    def block_rows(dim: int) -> int:
        rows = max(1, min(block_bytes // (8 * dim), max(LEAST_ROWS, math.ceil(n / SPLITS))))
        return min(rows, most_rows) if most_rows else rows

    schema = base.limit(0).withColumns({"_dim": F.lit(0), "_cell": F.lit(0), "_angle": F.lit(0.0)}).schema
    placed = base.mapInArrow(_assign(pivots, to_arrow_schema(schema)), schema)
    longest = max([d for d in pivots] or [1])
    small = n * longest * 8 <= SORTED_AT_ONCE
    if small:
        placed = placed.coalesce(1)
    else:
        placed = placed.repartitionByRange("_dim", "_cell", "_angle", F.xxhash64(*keys))
    placed = placed.sortWithinPartitions("_dim", "_cell", "_angle")
    count, to = Observation(), scratch_path(spark, "vector-blocks")
    (placed.mapInArrow(_pack(pivots, keys, list(order_cols), block_rows, width), BLOCK_SCHEMA)
     .observe(count, F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
              F.coalesce(F.sum(F.col("n").cast("long") * F.col("dim") * 8), F.lit(0)).alias("bytes"))
     .write.options(**{"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}).parquet(to))
    if not small:
        del usable, base, placed
        free_disk(spark, *([path] if path else []))             # the blocks have all that is needed
    return VectorIndex(spark.read.schema(BLOCK_SCHEMA).parquet(to), int(count.get["blocks"]), int(count.get["rows"]), int(count.get["bytes"]), pivots,
                       axes, width)


# --------------------------------------------------------------------------
# Pairs of blocks, by their bounds
# --------------------------------------------------------------------------
def _pages(blocks: DataFrame, n_blocks: int, side: str, *extra: str) -> DataFrame:
    page = F.pmod(F.xxhash64("block"), F.lit(max(1, math.ceil(n_blocks / PAGE)))).cast("int")
    return (blocks.select("dim", page.alias(f"{side}_page"), F.struct("block", "lo", "hi", *extra).alias("_b"))
            .groupBy("dim", f"{side}_page").agg(F.collect_list("_b").alias(f"{side}_blocks")))


def _bounds(col: pa.Array, i: int):
    s = col[i].values
    lo, hi = (np.array(s.field(c).to_pylist(), np.float64) for c in ("lo", "hi"))
    return s.field("block").to_numpy(zero_copy_only=False), lo, hi, s


def angle_between(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Least angle of a vector of each block a to one of each block b, as far as the pivots tell."""
    gap = np.zeros((len(lo_a), len(lo_b)))
    for p in range(lo_a.shape[1]):
        np.maximum(gap, lo_a[:, p, None] - hi_b[:, p], out=gap)
        np.maximum(gap, lo_b[:, p] - hi_a[:, p, None], out=gap)
    return gap


def near_blocks(a: VectorIndex, b: VectorIndex, reach: float | None = None, floors: DataFrame | None = None) -> DataFrame:
    """(a_block, b_block[, floor]) of blocks that may hold a pair within the angle ``reach``.

    With ``floors`` (block of a, floor) instead: pairs that may reach the cosine ``floor`` of the block of a. An index paired with itself
    gives each pair once (a_block <= b_block).
    """
    same, by_floor = a is b, floors is not None
    left = a.blocks.select("block", "dim", "lo", "hi")
    if by_floor:
        left = left.join(floors, "block")
    pages = _pages(left, a.n_blocks, "a", *(["floor"] if by_floor else [])).join(
        _pages(b.blocks.select("block", "dim", "lo", "hi"), b.n_blocks, "b"), "dim")
    if same:
        pages = pages.where("a_page <= b_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                id_a, lo_a, hi_a, s = _bounds(rb.column(0), i)
                id_b, lo_b, hi_b, _ = _bounds(rb.column(1), i)
                gap = angle_between(lo_a, hi_a, lo_b, hi_b) - SLACK
                if not by_floor:
                    ok = gap <= reach
                    floor = np.full(len(id_a), -2.0)
                else:
                    # the cosine of a pair is at most that of the least angle; what a zero vector gives is 0
                    floor = s.field("floor").to_numpy(zero_copy_only=False)
                    ok = np.maximum(np.cos(np.clip(gap, 0, np.pi)), 0.0) >= floor[:, None] - 1e-9
                if same and rb.column(2)[i].as_py():
                    ok &= id_a[:, None] <= id_b
                r, c = np.nonzero(ok)
                left, right = (np.minimum(id_a[r], id_b[c]), np.maximum(id_a[r], id_b[c])) if same else (id_a[r], id_b[c])
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(floor[r])], ["a_block", "b_block", "floor"])

    one = F.col("a_page") == F.col("b_page")
    return pages.select("a_blocks", "b_blocks", one.alias("one")).mapInArrow(run, "a_block long, b_block long, floor double")


def nearest_blocks(a: VectorIndex, b: VectorIndex, most: int) -> DataFrame:
    """(a_block, b_block) of the ``most`` blocks of b nearest to each block of a, by the middles of their ranges of angles."""
    pages = _pages(a.blocks.select("block", "dim", "lo", "hi"), a.n_blocks, "a").join(
        _pages(b.blocks.select("block", "dim", "lo", "hi"), b.n_blocks, "b"), "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                id_a, lo_a, hi_a, _ = _bounds(rb.column(0), i)
                id_b, lo_b, hi_b, _ = _bounds(rb.column(1), i)
                ma, mb = (lo_a + hi_a) / 2, (lo_b + hi_b) / 2
                far = (ma * ma).sum(1)[:, None] - 2 * ma @ mb.T + (mb * mb).sum(1)
                c = np.argsort(far, axis=1, kind="stable")[:, :most]
                r = np.repeat(np.arange(len(id_a)), c.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(id_a[r]), pa.array(id_b[c.ravel()]), pa.array(far[r, c.ravel()])],
                                                 ["a_block", "b_block", "far"])

    near = pages.select("a_blocks", "b_blocks").mapInArrow(run, "a_block long, b_block long, far double")
    w = Window.partitionBy("a_block").orderBy("far", "b_block")
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("a_block", "b_block", F.lit(-2.0).alias("floor"))


# --------------------------------------------------------------------------
# Products of the blocks that are left
# --------------------------------------------------------------------------
class Block:
    """A block as a task holds it; ``norms`` have the epsilon of the cosine, or are those given."""

    def __init__(self, number: int, keys: pa.RecordBatch, x: np.ndarray, axes: np.ndarray | None = None, norms: np.ndarray | None = None):
        self.number, self.keys, self.x, self.axes = number, keys, x, axes
        if norms is None:
            y = self.doubles
            norms = np.sqrt((y * y).sum(axis=1)) + COSINE_EPS
        self.norms = norms
        self._kinds: tuple[np.ndarray, np.ndarray] | None = None
        self._units: np.ndarray | None = None
        self._low: np.ndarray | None = None

    @property
    def doubles(self) -> np.ndarray:
        return self.x.astype(np.float64, copy=False)

    @property
    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """(first row of each distinct vector, number of each row's vector): equal rows then have equal cosines to the last digit."""
        if self._kinds is None:
            raw = np.ascontiguousarray(self.x).view(np.dtype((np.void, self.x.shape[1] * self.x.itemsize))).ravel()
            _, first, number = np.unique(raw, return_index=True, return_inverse=True)
            self._kinds = first, number
        return self._kinds


    @property
    def units(self) -> np.ndarray:
        """The vectors over their norms: a product of them is the cosine, but for the last digits."""
        if self._units is None:
            self._units = self.x / self.norms[:, None]
        return self._units

    @property
    def low(self) -> np.ndarray:
        """Floats whose products are, but for ``loose``, the cosines or more: unit vectors, or their part along the axes and the length of the rest."""
        if self._low is None:
            u = units(self.doubles)
            if self.axes is not None:
                part = u @ self.axes
                u = np.column_stack([part, np.sqrt(np.maximum((u * u).sum(axis=1) - (part * part).sum(axis=1), 0.0))])
            self._low = u.astype(np.float32)
        return self._low


def loose(dim: int) -> float:
    """More than a product of floats of this length differs from that of the doubles (unit vectors)."""
    return (dim + 16) * 2.0 ** -23


def all_blocks(a: VectorIndex, b: VectorIndex) -> DataFrame:
    """(a_block, b_block, floor) of all blocks of one length (for a ``b`` of few blocks)."""
    return (a.blocks.select("dim", F.col("block").alias("a_block")).join(b.blocks.select("dim", F.col("block").alias("b_block")), "dim")
            .select("a_block", "b_block", F.lit(-2.0).alias("floor")))


def _sides(index: VectorIndex, side_bytes: int, name: str) -> DataFrame:
    """(``name``_block, side) of all blocks: blocks that follow one another share a side up to so many bytes. The driver sees a row per part of the index."""
    blocks = index.blocks.select("block", F.shiftright("block", 32).alias("part"), (F.col("n").cast("long") * F.col("dim") * index.width).alias("bytes"))
    start, starts = 0, []
    for part, size in blocks.groupBy("part").agg(F.sum("bytes")).orderBy("part").collect():
        starts.append((part, start))
        start += size
    table = index.blocks.sparkSession.createDataFrame(starts, "part long, start long")
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("bytes").over(w), F.lit(0))
    return (blocks.join(F.broadcast(table), "part")
            .select(F.col("block").alias(f"{name}_block"), F.floor(before / side_bytes).cast("long").alias(f"t{name}")))


def products(a: VectorIndex, b: VectorIndex, pairs: DataFrame, work: Callable[[Block, list[Block], float], Iterator[pa.RecordBatch]],
             schema, by_left: bool = False, block: Callable[..., Block] = Block) -> DataFrame:
    """``work(block of a, its blocks of b within a tile, floor)`` for the given pairs (a_block, b_block, floor).

    Tiles are squares of blocks that lie next to each other, SIDE_BYTES a side; with ``by_left`` a tile is one block of a and all its partners
    (for pairs that are few per block). What is sent at a time is no more than TURN_BYTES or the indexes' own size: if it is more in all, this
    works in turns and its result is stored. ``block(number, keys, matrix, axes)`` makes what ``work`` gets.
    """
    spark = pairs.sparkSession
    stored = {0: a.n_bytes // 8 * a.width, 1: b.n_bytes // 8 * b.width}
    turns, path = 1, scratch_path(spark, "tiles")
    if by_left:
        need = pairs.withColumns({"ta": F.col("a_block"), "tb": F.lit(0).cast("long")})
        tiles = a.n_blocks
    else:
        side = min(SIDE_BYTES, max(LEAST_SIDE, math.ceil(max(stored.values()) / SIDES)))
        need = pairs.join(_sides(a, side, "a"), "a_block").join(_sides(b, side, "b"), "b_block")
    need = (need.select("ta", "tb", "a_block", "b_block", "floor").groupBy("ta", "tb", "a_block")
            .agg(F.collect_list("b_block").alias("wanted"), F.min("floor").alias("floor")))
    if not by_left:                             # how many tiles have work is known once the pairs are
        need.write.parquet(path)
        need = spark.read.schema(need.schema).parquet(path)
        tiles = need.select("ta", "tb").distinct().count()
        turns = math.ceil(2 * side * tiles / max(TURN_BYTES, sum(stored.values()) // (2 if a is b else 1)))
    wide = ["block", "dim", "keys", "mat"]
    axes, widths = a.axes if a is b else {}, (a.width, b.width)

    def rows_of(need: DataFrame, parts: int, few: bool) -> DataFrame:
        left = need.select("ta", "tb", F.lit(0).alias("side"), F.col("a_block").alias("block"), "wanted", "floor")
        right = (need.select("ta", "tb", F.lit(1).alias("side"), F.explode("wanted").alias("block")).distinct()
                 .withColumns({"wanted": F.lit(None).cast("array<long>"), "floor": F.lit(None).cast("double")}))
        if few:                                 # a turn's tiles are bounded: matrices are shuffled once, to their tiles
            left, right = F.broadcast(left), F.broadcast(right)
        rows = left.join(a.blocks.select(*wide), "block").unionByName(right.join(b.blocks.select(*wide), "block"))
        return (rows.select("ta", "tb", "side", "block", "wanted", "floor", "dim", "keys", "mat")
                .repartition(parts, "ta", "tb").sortWithinPartitions("ta", "tb", F.col("side").desc(), "block"))

    def opened(rb, i) -> Block:
        dim = rb.column(6)[i].as_py()
        x = np.frombuffer(rb.column(8)[i].as_buffer(), f"<f{widths[rb.column(2)[i].as_py()]}").reshape(-1, dim).copy()    # a view would keep the whole batch
        return block(rb.column(3)[i].as_py(), keys_of(rb.column(7)[i].as_buffer()), x, axes.get(dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, right = None, {}
        for rb in batches:
            for i in range(rb.num_rows):
                at = (rb.column(0)[i].as_py(), rb.column(1)[i].as_py())
                if at != tile:
                    tile, right = at, {}
                one = opened(rb, i)
                if rb.column(2)[i].as_py():             # the blocks of b come first
                    right[one.number] = one
                else:
                    yield from work(one, [right[w] for w in sorted(rb.column(4)[i].as_py())], rb.column(5)[i].as_py())

    def parts(tiles: int) -> int:               # few tiles are dealt to more tasks, so that each has one
        return max(1, tiles if by_left else min(4 * tiles, max(tiles, 3 * spark.sparkContext.defaultParallelism)))

    if turns <= 1:
        return rows_of(need, parts(tiles), not by_left).mapInArrow(run, schema)
    out = []
    for turn in range(turns):
        mine = need.where(F.pmod(F.xxhash64("ta", "tb"), F.lit(turns)) == turn)
        done = rows_of(mine, parts(math.ceil(tiles / turns)), True).mapInArrow(run, schema)
        out.append(scratch_path(spark, "products"))
        done.write.parquet(out[-1])
        del mine, done
        free_disk(spark)
    return spark.read.schema(schema).parquet(*out)


def single_cosines(a: Block, b: Block, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of single pairs, summed in one order wherever a pair is met (the last digits of a matrix product depend on its shape)."""
    out = np.empty(len(r))
    step = max(1, (1 << 21) // a.x.shape[1])
    for lo in range(0, len(r), step):
        i, j = r[lo:lo + step], c[lo:lo + step]
        x, y = a.x[i].astype(np.float64, copy=False), b.x[j].astype(np.float64, copy=False)
        out[lo:lo + step] = (x * y).sum(axis=1) / (a.norms[i] * b.norms[j])
    return out


def pairs_above(a: Block, b: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, cosines) of the pairs that reach the threshold, for a bounded number of rows of a at once."""
    step = max(16, PRODUCT // max(1, len(b.x)))
    least = np.float32(threshold - loose(a.x.shape[1]))
    for lo in range(0, len(a.x), step):
        if threshold > 0:                       # the epsilon only makes a positive cosine less
            r, c = np.nonzero(a.low[lo:lo + step] @ b.low.T >= least)
            if len(r) * DENSE <= len(b.x) * min(step, len(a.x) - lo):
                s = single_cosines(a, b, r + lo, c)
                ok = s >= threshold
                if ok.any():
                    yield r[ok] + lo, c[ok], s[ok]
                continue
        sim = (a.doubles[lo:lo + step] @ b.doubles.T) / np.outer(a.norms[lo:lo + step], b.norms)
        r, c = np.nonzero(sim >= threshold - 1e-12)
        s = sim[r, c]
        close = np.abs(s - threshold) <= 1e-12
        if close.any():
            s[close] = single_cosines(a, b, r[close] + lo, c[close])
            r, c, s = r[s >= threshold], c[s >= threshold], s[s >= threshold]
        if len(r):
            yield r + lo, c, s


def best_of(a: Block, b: Block, k: int, floor: float | np.ndarray = -2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, cosine) of the k greatest cosines of each row of a that reach the floor (one for all, or one per row); of equal ones
    the first rows of b. Rows of a come in order.

    Only distinct vectors of b are multiplied, and only cosines that reach the floor are ranked: most products fall under a good floor.
    """
    first, number = b.kinds
    u = b.units[first]
    members = np.argsort(number, kind="stable")             # rows of each distinct vector, in order
    size = np.minimum(np.bincount(number, minlength=len(first)), k)
    start = np.searchsorted(number[members], np.arange(len(first)))
    floors = np.broadcast_to(np.asarray(floor, np.float64), len(a.x))
    rs, cs, ss = [], [], []

    def cut(r, c, s, order_by):
        """The k first of each row by falling cosine, then ``order_by``."""
        order = np.lexsort((order_by, -s, r))
        r, c, s = r[order], c[order], s[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[keep], c[keep], s[keep]

    step = max(16, PRODUCT // max(1, len(u)))
    for lo in range(0, len(a.x), step):
        sim = a.units[lo:lo + step] @ u.T
        least = floors[lo:lo + step, None] - 1e-9
        hit = sim >= least
        n = sim.shape[1]
        if n > k and np.count_nonzero(hit) > 32 * k * len(sim):
            kth = np.partition(sim, n - k, axis=1)[:, n - k][:, None]
            hit = sim >= np.maximum(least, kth - 1e-12)
        r, c = np.nonzero(hit)
        # exact cosines, so that equal ones are equal; then the rows of the vectors that are left
        r, c, s = cut(r, c, single_cosines(a, b, r + lo, first[c]), first[c])
        n = size[c]
        row = members[np.repeat(start[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        r, s = np.repeat(r, n), np.repeat(s, n)
        r, row, s = cut(r, row, s, row)
        rs.append(r + lo)
        cs.append(row)
        ss.append(s)
    return np.concatenate(rs), np.concatenate(cs), np.concatenate(ss)


class Best:
    """The k greatest cosines of each row so far."""

    def __init__(self, rows: int, k: int):
        self.found, self.k = np.full((rows, k), -2.0), k

    def add(self, r: np.ndarray, s: np.ndarray) -> None:
        """Cosines of rows (in order, at most k of a row)."""
        here = np.full_like(self.found, -2.0)
        here[r, np.arange(len(r)) - np.searchsorted(r, r)] = s
        self.found = np.sort(np.concatenate([self.found, here], axis=1), axis=1)[:, -self.k:]

    @property
    def certain(self) -> np.ndarray:
        return self.found[:, 0]
