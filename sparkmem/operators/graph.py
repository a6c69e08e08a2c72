"""Connected components by alternating neighbourhood minima (large star, small star)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of the edges u-v: each node but the least of its component, with that least node."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[:len(u)], inv[len(u):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for end in (a, b, before[a], before[b]):
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v); component is the smallest node it reaches.

    Each round replaces a node's links by links to the least node of its neighbourhood; minima are aggregates, so no
    neighbourhood is gathered, and each round's edges are written to the shared folder. The number of rounds grows with
    the logarithm of the longest chain.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == last:
            break
        last = now
    label = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = label.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return label.unionByName(roots)
