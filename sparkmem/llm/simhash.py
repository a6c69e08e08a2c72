"""Operator 6, SimHash near-duplicates by a self-join of a binary trie.

Fingerprints (a bit is set when it is set in over half of the shingle hashes) are reduced to distinct
values before any join. The trie's top levels become cells (the leading bits), and only cells whose
prefixes differ by no more than the error budget meet. Inside a task two subtrees are walked together,
level by level: every node pair carries the bits that differ so far, and a pair is dropped as soon as they
exceed the budget. A node is a range of the sorted fingerprints, so one level of all pairs is a few
numpy operations. Links found in a task are reduced to a spanning forest of that task before they
leave it (components need no more), which keeps dense groups of near copies linear.

Nulls and odd input: a null or empty text, or one of white space only, has fingerprint zero and is linked like
any other; repeated rows share a fingerprint; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, components, forest, lean, lower_ascii, row_slices, utf8, words, written

CELL_ROWS = 1 << 15        # fingerprints in one block of a cell
FRONTIER = 1 << 21         # node pairs walked at once


def fingerprints_of(offsets: np.ndarray, data: np.ndarray, shingle: int = 3) -> np.ndarray:
    """uint64 SimHash of each text: XXH64 (seed 42) of space-joined word shingles, majority of each bit."""
    import xxhash
    xx = xxhash.xxh64_intdigest
    data = lower_ascii(data)
    out = np.zeros(len(offsets) - 1, np.uint64)
    raw = data.tobytes()
    for i in range(len(out)):
        w = raw[offsets[i]:offsets[i + 1]].split()
        if not w:
            continue
        if len(w) <= shingle:
            out[i] = xx(b" ".join(w), 42)
            continue
        if shingle == 3:
            h = [xx(a, 42) for a in map(b"%b %b %b".__mod__, zip(w, w[1:], w[2:]))]
        else:
            h = [xx(b" ".join(w[j:j + shingle]), 42) for j in range(len(w) - shingle + 1)]
        out[i] = majority(np.array(h, np.uint64))
    return out


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the values."""
    n = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[lo:lo + (1 << 16)]).astype("<u8")
        n += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * n > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = utf8(b.column(1))
            fp = [fingerprints_of(off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]], shingle) for lo, hi in row_slices(off)]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, fp long) of rows (id, text); fp holds the 64 bits."""
    arrow_conf(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(lean(_fingerprint_batches(shingle)), "id long, fp long")


# --------------------------------------------------------------------------
# Trie self-join
# --------------------------------------------------------------------------
def _children(sorted_fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the child with the bit set begins in each range [lo, hi) (binary search, all ranges at once)."""
    a, b = lo.copy(), hi.copy()
    shift = np.uint64(bit)
    one = np.uint64(1)
    while True:
        open_ = a < b
        if not open_.any():
            return a
        mid = (a + b) >> 1
        is_set = ((sorted_fp[np.minimum(mid, len(sorted_fp) - 1)] >> shift) & one).astype(bool)
        b = np.where(open_ & is_set, mid, b)
        a = np.where(open_ & ~is_set, mid + 1, a)


def trie_join(x: np.ndarray, y: np.ndarray | None, budget: int, top_bit: int = 63):
    """Yield index arrays (i, j) of all pairs x[i], y[j] (or i < j within x) that differ in at most ``budget`` bits.

    Both are sorted. Depth first over blocks of node pairs, so that the frontier stays bounded.
    """
    same = y is None
    y = x if same else y
    if not len(x) or not len(y):
        return
    one = np.array([0]), np.array([len(x)]), np.array([0]), np.array([len(y)]), np.array([0], np.int8)
    stack = [(top_bit, one)]
    while stack:
        bit, (al, ah, bl, bh, err) = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack.append((bit, tuple(v[half:] for v in (al, ah, bl, bh, err))))
            stack.append((bit, tuple(v[:half] for v in (al, ah, bl, bh, err))))
            continue
        # pairs of small nodes are compared whole
        small = ((ah - al) * (bh - bl) <= 4) | (bit < 0)
        if small.any():
            s = np.flatnonzero(small)
            for dx in range(int((ah - al)[s].max())):
                for dy in range(int((bh - bl)[s].max())):
                    k = s[((ah - al)[s] > dx) & ((bh - bl)[s] > dy)]
                    i, j = al[k] + dx, bl[k] + dy
                    if same:
                        keep = i < j
                        i, j = i[keep], j[keep]
                    hit = np.bitwise_count(x[i] ^ y[j]) <= budget
                    if hit.any():
                        yield i[hit], j[hit]
            keep = ~small
            al, ah, bl, bh, err = al[keep], ah[keep], bl[keep], bh[keep], err[keep]
        if not len(al):
            continue
        am = _children(x, al, ah, bit)
        bm = am if same and np.array_equal(al, bl) and np.array_equal(ah, bh) else _children(y, bl, bh, bit)
        parts = []
        for a0, a1, b0, b1, cost in ((al, am, bl, bm, 0), (am, ah, bm, bh, 0), (al, am, bm, bh, 1), (am, ah, bl, bm, 1)):
            keep = (a0 < a1) & (b0 < b1) & (err + cost <= budget)
            if same:
                keep &= a0 < b1                 # the mirrored pair of nodes is walked once
                if cost:
                    keep &= ~((al == bl) & (ah == bh) & (a0 > b0))
            parts.append((a0[keep], a1[keep], b0[keep], b1[keep], (err[keep] + cost).astype(np.int8)))
        nxt = tuple(np.concatenate(v) for v in zip(*parts))
        if len(nxt[0]):
            stack.append((bit - 1, nxt))


def _blob(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def _pack(key, pdf):
    import pandas as pd
    fp = np.sort(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64))
    return pd.DataFrame({"cell": [key[0]], "sub": [key[1]], "fps": [fp.tobytes()]})


def _join_blocks(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a_cell, a_sub, b_cell, b_sub, ab, bb in zip(*(c.to_pylist() for c in b.columns)):
                x = _blob(ab)
                same = (a_cell, a_sub) == (b_cell, b_sub)
                y = None if same else _blob(bb)
                us, vs, held = [], [], 0
                for i, j in trie_join(x, y, budget):
                    us.append(x[i])
                    vs.append((x if same else y)[j])
                    held += len(i)
                    if held > 1 << 21:
                        u, v = forest(np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64))
                        us, vs, held = [u.view(np.uint64)], [v.view(np.uint64)], 0
                if us:
                    u, v = forest(np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    return run


def links(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) within ``budget`` bits: a spanning forest per task."""
    spark = distinct.sparkSession
    n = distinct.count()
    depth = max(4, math.ceil(math.log2(max(n, 1) / CELL_ROWS)) + 2)
    cell = F.shiftrightunsigned("fp", 64 - depth).cast("int")
    rows = distinct.select("fp", cell.alias("cell"))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    # a crowded cell is dealt to several blocks, so that a block stays within CELL_ROWS or so
    rows = rows.join(sizes, "cell").withColumn(
        "sub", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / CELL_ROWS)).cast("int"))
    blocks = written(rows.select("cell", "sub", "fp").groupBy("cell", "sub")
                     .applyInPandas(_pack, "cell int, sub int, fps binary"), "simhash-blocks")
    # the cells that a block has to meet: prefixes that differ by no more than the budget
    masks = [m for m in range(1 << depth) if bin(m).count("1") <= budget]
    a = blocks.select(F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub"),
                      F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    a = a.withColumn("b_cell", F.col("a_cell").bitwiseXOR(F.col("mask"))).where("a_cell <= b_cell").drop("mask")
    pairs = (a.join(blocks.select(F.col("cell").alias("b_cell"), F.col("sub").alias("b_sub")), "b_cell")
             .where("a_cell < b_cell or a_sub <= b_sub"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // (CELL_ROWS * 16))
    bl = blocks.select(F.col("cell").alias("b_cell"), F.col("sub").alias("b_sub"), F.col("fps").alias("b_fps"))
    al = blocks.select(F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub"), F.col("fps").alias("a_fps"))
    work = (pairs.join(al, ["a_cell", "a_sub"]).join(bl, ["b_cell", "b_sub"])
            .select("a_cell", "a_sub", "b_cell", "b_sub", "a_fps", "b_fps").repartition(parts))
    return work.mapInArrow(_join_blocks(budget), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """(id, fp, component_id) of rows (id, text): component_id = smallest id reachable by links."""
    fp = written(fingerprints(docs, shingle), "simhash-fp")
    low = fp.groupBy("fp").agg(F.min("id").alias("first_id"))
    comp = components(links(low.select("fp"), budget), "simhash-cc")
    classes = low.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    smallest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    member = classes.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return fp.join(member, "fp").select("id", "fp", "component_id")
