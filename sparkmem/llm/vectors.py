"""Operator 2, embedding near-duplicates as an exact metric range join.

Vectors are taken as points on the unit sphere with the angle as metric. Pivots (a bounded sample of the vectors, more of them the more
vectors there are) partition the points into cells by nearest pivot; cells are cut into blocks by the angle to their pivot, and each block is
stored once, as the table has its vectors, with its least and greatest angle to every pivot (``operators.vector_index``). Two
blocks meet only if, by the triangle inequality, these leave room for a pair within the angle of the threshold. Tiles of blocks are multiplied
in tasks, in turns that send no more than the stored blocks have in all or a fixed size, and a turn's shuffle files go before the next. What leaves a task are
link counts per vector and a spanning forest of the links found, never pairs.
Equal vectors are one representative with a multiplicity throughout.

Nulls and odd input: a vector that is null, empty, zero or holds null or non-finite components links with
nothing; vectors of different length never link; repeated rows count as links of each other, rows of one id
and different vectors are vectors of their own; a null id links like any other and
counts as a link of its partners, but is no smallest id (a component of null ids alone has a null one);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import vector_index as I
from ..session import free_disk
from .common import arrow_conf, components, forest, written

MOST_PIVOTS = 1024         # bound of the driver's sample and of what tasks carry along
CELL_ROWS = 4096           # vectors a cell should hold
BLOCK_ROWS = 2048          # vectors of one block


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the digest of their unit vector; null where a vector has none."""
    for b in batches:
        keys = []
        for v in b.column(1).to_pylist():
            key = None
            if v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(x).all() and top > 0:
                    x = x / top
                    key = hashlib.sha256((x / math.sqrt(float(x @ x)) + 0.0).astype("<f8").tobytes()).digest()
            keys.append(key)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary())], ["id", "embedding", "key"])


def _unit_block(number: int, keys: pa.RecordBatch, x: np.ndarray, axes: np.ndarray | None = None) -> I.Block:
    """A block of unit vectors: its products are cosines."""
    return I.Block(number, keys, I.units(x.astype(np.float64, copy=False)), axes, np.ones(len(x)))


def _pivots(vectors: list, n: int) -> dict[int, np.ndarray]:
    """A pivot per CELL_ROWS vectors: a length has its share of the sample's."""
    by_dim: dict[int, list] = {}
    for v in vectors[:max(1, min(MOST_PIVOTS, math.ceil(n / CELL_ROWS)))]:
        by_dim.setdefault(len(v), []).append(v)
    return {d: I.units(np.array(some, np.float64)) for d, some in by_dim.items()}


def range_join(reps: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n): link counts (v null) and forest edges (n null) of the distinct vectors (id, n, embedding) of a stored table."""
    index = I.build_index(reps, "embedding", ["id", "n"], choose=_pivots, sample=max(I.SAMPLE, MOST_PIVOTS), most_rows=BLOCK_ROWS, stored=True)

    def work(a: I.Block, blocks: list[I.Block], _) -> Iterator[pa.RecordBatch]:
        ids_a, n_a = (a.keys.column(i).to_numpy() for i in range(2))
        got_a = np.zeros(len(ids_a), np.int64)
        us, ns, eu, ev = [ids_a], [got_a], [], []
        for b in blocks:
            ids_b, n_b = (b.keys.column(i).to_numpy() for i in range(2))
            got_b = np.zeros(len(ids_b), np.int64)
            for r, c, _ in I.pairs_above(a, b, threshold):
                if a.number == b.number:
                    r, c = r[r < c], c[r < c]
                if len(r):
                    np.add.at(got_a, r, n_b[c])
                    np.add.at(got_b, c, n_a[r])
                    u, v = forest(ids_a[r], ids_b[c])
                    eu.append(u)
                    ev.append(v)
            if got_b.any():
                us.append(ids_b[got_b > 0])
                ns.append(got_b[got_b > 0])
        if not eu:
            return
        u, n = np.concatenate(us), np.concatenate(ns)
        u, n = u[n > 0], n[n > 0]
        p, q = forest(np.concatenate(eu), np.concatenate(ev))
        counts, links = np.zeros(len(u), bool), np.ones(len(p), bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([u, p])), pa.array(np.concatenate([np.zeros_like(u), q]), mask=np.concatenate([~counts, ~links])),
             pa.array(np.concatenate([n, np.zeros_like(p)]), mask=np.concatenate([counts, links]))], ["u", "v", "n"])

    reach = math.acos(min(1.0, max(-1.0, threshold)))
    return written(I.products(index, index, I.near_blocks(index, index, reach), work, "u long, v long, n long", block=_unit_block), "range-links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id) of rows (id, embedding): cosine >= threshold in double precision."""
    arrow_conf(vectors.sparkSession)
    spark, rows = vectors.sparkSession, vectors.select("id", "embedding")
    schema = T.StructType([T.StructField("id", T.LongType()), *rows.select("embedding").schema, T.StructField("key", T.BinaryType())])
    base = written(rows.mapInArrow(_keys, schema), "range-keys")
    # groups go by a number of their own: ids may be null, and then have no order
    groups = written(base.where("key is not null").groupBy("key", F.size("embedding").alias("dim"))
                     .agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
                     .withColumn("id", F.monotonically_increasing_id()), "range-groups")
    free_disk(spark)                            # the vectors' shuffle files
    found = range_join(groups.select("id", "n", "embedding"), threshold)
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("others"))
    comp = components(found.where("v is not null").select("u", "v"), "range-cc")
    groups = (groups.select("key", "id", "least", "n").join(counts.withColumnRenamed("u", "id"), "id", "left")
              .join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    low = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = (groups.join(low, "component")
              .select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    out = base.select("id", "key").join(groups, "key", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"))
