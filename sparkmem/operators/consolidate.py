"""Consolidation.

* ``consolidate``: per scope, the newest ``max_items`` episodic memories (or all
  of them) are clustered greedily in arrival order (newest first): a memory
  joins the first cluster whose running centroid has cosine >= threshold, else
  opens a new one; a memory without an embedding sits alone (zero vector). The
  order-dependent fold runs per group of memories that can interact at all, in
  rounds. ``consolidate_members`` also gives the members, as rows.
* ``cluster_rollup`` turns clusters of two or more into semantic memories.
* ``centroids``: mean vector per group, as a partial aggregation per
  (group, position) -- no group is collected whole.
* ``near_duplicate_pairs``: pairs at or above a cosine threshold, exact, between
  classes of equal vectors, over a stored index (``vector_index``).
"""

from __future__ import annotations

import functools
import math
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CONSOLIDATE_MAX_ITEMS, CONSOLIDATE_THRESHOLD, SUMMARY_CHARS, VECTOR_DIM
from ..functions.vector import cosine
from ..session import materialize
from . import vector_index as V
from .graph import connected_components, spanning_stars
from .greedy import ROUND_ITEMS, fold, fold_groups, number_runs


def greedy_clusters(vectors: list, threshold: float, dim: int = VECTOR_DIM, times: list[int] | None = None) -> list[int]:
    """Cluster index per item (items in processing order): the plain fold of one group (``greedy.fold``)."""
    return fold(vectors, times if times is not None else [1] * len(vectors), threshold, {}, 0, dim)


def _arrival(df: DataFrame) -> DataFrame:
    """``member_pos``: a sortable key of the processing order (newest first), no numbering needed."""
    return df.withColumn("member_pos", F.struct((-F.col("created_at")).alias("created"), (-F.col("seq")).cast("long").alias("seq"),
                                                F.col("id").alias("id")))


def cluster_members(memories: DataFrame, max_items: int | None = CONSOLIDATE_MAX_ITEMS,
                    threshold: float = CONSOLIDATE_THRESHOLD, scope_cols: Sequence[str] = ("scope_id",),
                    dim: int = VECTOR_DIM, episodic_only: bool = True, round_items: int = ROUND_ITEMS) -> DataFrame:
    """K6 step 1: ``scope, cluster, member_pos, id, content`` of the newest ``max_items`` memories of each scope, or of
    all of them (``None``). ``member_pos`` sorts by arrival.

    The greedy fold looks at every earlier cluster, but memories interact only along chains of cosines >=
    ``threshold ** 2``: a centroid of members within ``threshold`` of it is at least ``threshold`` as long as its
    members' total, so an item that joins it has cosine >= ``threshold ** 2`` to one of them. The connected components of
    that relation are therefore folded on their own, each in its order, with the same result as the whole scope. Equal
    vectors are one node of that graph (128 bits of hash), and a component of one distinct vector is one cluster without any
    fold. Larger components are folded in rounds (``greedy``), so none of them is a task, whatever its size.
    A negative or zero threshold ties everything to everything: a scope is then one component.
    """
    scope_cols = list(scope_cols)
    df = memories.where(F.col("type") == "episodic") if episodic_only else memories
    df = _arrival(df)
    if max_items is not None:
        w = Window.partitionBy(*scope_cols).orderBy("member_pos")
        df = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_items)
    has = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    df = df.select(*scope_cols, "member_pos", "id", "content", "embedding",
                   *[F.when(has, F.xxhash64(F.lit(salt), *scope_cols, F.lit(salt), "embedding")).alias(h) for salt, h in ((1, "_h1"), (2, "_h2"))])
    df = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "members")
    cols = [*scope_cols, "cluster", "member_pos", "id", "content"]
    alone = df.where("_h1 is null").withColumn("cluster", F.concat(F.lit("alone:"), "id")).select(*cols)
    rows = df.where("_h1 is not null")
    # nodes: distinct (scope, vector)
    nodes = materialize(rows.groupBy("_h1", "_h2").agg(F.first(F.struct(*scope_cols)).alias("_s"), F.first("embedding").alias("embedding"))
                        .withColumn("_node", F.monotonically_increasing_id()), "nodes")
    if threshold <= 0:
        whole = nodes.groupBy("_s").agg(F.min("_node").alias("_c"))
        label = nodes.join(whole, nodes["_s"].eqNullSafe(whole["_s"])).select("_h1", "_h2", "_node", "_c", F.lit(True).alias("_mixed"))
        found = True
    else:
        # links within a scope at threshold ** 2
        links = materialize(block_pairs(nodes.select(F.col("_node").alias("id"), F.col("_node").alias("seq"), "_s", "embedding"),
                                        threshold * threshold, scope_col="_s", links=True).select(F.col("id_a").alias("u"), F.col("id_b").alias("v")), "links")
        found = bool(links.limit(1).count())
        label = nodes.select("_h1", "_h2", "_node", F.col("_node").alias("_c"), F.lit(False).alias("_mixed"))
        if found:
            comp = connected_components(links).select(F.col("node").alias("_node"), F.col("component").alias("_comp"))
            label = (nodes.join(comp, "_node", "left")
                     .select("_h1", "_h2", "_node", F.coalesce("_comp", "_node").alias("_c"), F.col("_comp").isNotNull().alias("_mixed")))
    linked = rows.join(label, ["_h1", "_h2"])
    single = linked.where("not _mixed").withColumn("cluster", F.concat(F.lit("copies:"), F.col("_c").cast("string"))).select(*cols)
    if not found:
        return alone.unionByName(single)
    mixed = materialize(linked.where("_mixed").select("_row", "_node", "_c", "member_pos"), "mixed")
    runs = number_runs(mixed.select(F.col("_c").alias("group"), F.col("member_pos").alias("pos"), F.col("_row").alias("row"), F.col("_node").alias("node")))
    clusters = fold_groups(runs.groupBy("group", "run").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("n")),
                           nodes.select(F.col("_node").alias("node"), "embedding"), threshold, dim, round_items)
    by_row = runs.join(clusters, ["group", "run"]).select(F.col("row").alias("_row"), F.concat_ws(":", F.col("group").cast("string"),
                                                                                                F.col("cluster").cast("string")).alias("cluster"))
    return alone.unionByName(single).unionByName(rows.join(by_row, "_row").select(*cols))


def cluster_rollup(members: DataFrame, as_of: float, scope_cols: Sequence[str] = ("scope_id",),
                   min_members: int = 2, include_members: bool = True, summary_chars: int = SUMMARY_CHARS) -> DataFrame:
    """One semantic memory per cluster with >= 2 members.

    Content ``"Summary of n events:\\n"`` + the first 512 characters of the
    members' contents joined by newlines in member order; importance
    ``min(1, .6 + .02 n)``; no embedding.

    Bounded per group whatever the cluster size: ``n`` is a partial count, and
    only the first ``summary_chars + 1`` members are collected for the text (n
    members give at least n - 1 newlines). The full member list (``member_ids`` and
    ``metadata_json.members``) is collected only with ``include_members``,
    for clusters that are bounded upstream (``consolidate`` caps them at
    ``max_items``); otherwise ``first_member`` is given.
    """
    scope_cols = list(scope_cols)
    key = list(scope_cols) + ["cluster"]
    members = members.withColumn("content", F.substring("content", 1, summary_chars))
    counts = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n_members"),
                                       F.min_by("id", "member_pos").alias("first_member"))
    counts = counts.where(F.col("n_members") >= min_members)
    w = Window.partitionBy(*key).orderBy("member_pos")
    head = members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= summary_chars + 1)
    head = head.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("member_pos", "content"))).alias("_h"))
    g = counts.join(head, key)
    if include_members:
        ids = members.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("member_pos", "id"))).alias("_m"))
        g = g.join(ids, key)
    joined = F.array_join(F.transform("_h", lambda x: x["content"]), "\n")
    hkey = F.sha2(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in scope_cols], F.col("first_member")), 256)
    meta = [F.lit("consolidation").alias("source")]
    if include_members:
        meta.append(F.transform("_m", lambda x: x["id"]).alias("members"))
    cols = [
        *scope_cols, "cluster", "n_members",
        F.concat(F.lit("semantic:"), F.substring(hkey, 1, 16)).alias("id"),
        F.lit("semantic").alias("type"),
        F.concat(F.lit("Summary of "), F.col("n_members").cast("string"), F.lit(" events:\n"),
                 F.substring(joined, 1, summary_chars)).alias("content"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.least(F.lit(1.0), F.lit(0.6) + F.lit(0.02) * F.col("n_members")).alias("importance"),
        F.lit(float(as_of)).alias("created_at"),
        F.lit(float(as_of)).alias("last_access"),
        F.to_json(F.struct(*meta)).alias("metadata_json"),
        "first_member",
    ]
    if include_members:
        cols.append(F.array_join(F.transform("_m", lambda x: x["id"]), ",").alias("member_ids"))
    return g.select(*cols)


def consolidate(memories: DataFrame, as_of: float, max_items: int | None = CONSOLIDATE_MAX_ITEMS,
                threshold: float = CONSOLIDATE_THRESHOLD, scope_cols: Sequence[str] = ("scope_id",),
                dim: int = VECTOR_DIM) -> DataFrame:
    """K6: new semantic memory rows (sources are kept, as in the reference).

    ``max_items=None`` takes every memory; the rows then name their first member, and ``consolidate_members`` has all of them.
    """
    return consolidate_members(memories, as_of, max_items, threshold, scope_cols, dim)[0]


def consolidate_members(memories: DataFrame, as_of: float, max_items: int | None = None, threshold: float = CONSOLIDATE_THRESHOLD,
                        scope_cols: Sequence[str] = ("scope_id",), dim: int = VECTOR_DIM) -> tuple[DataFrame, DataFrame]:
    """K6 with its members as rows: ``(semantic memories, (scope, id of the semantic memory, member_pos, member))``.

    A cluster's members are rows, not a list, so neither the number of memories nor a cluster's size needs a limit.
    """
    # a summary shows no more of any text than its own length
    memories = memories.withColumn("content", F.substring("content", 1, SUMMARY_CHARS))
    m = cluster_members(memories, max_items, threshold, scope_cols, dim)
    if max_items is None:
        m = materialize(m, "clusters")          # the fold runs once, not once per aggregate of the rollup
    rows = cluster_rollup(m, as_of, scope_cols, include_members=max_items is not None)
    key = [*scope_cols, "cluster"]
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    members = m.alias("m").join(rows.select(*key, F.col("id").alias("semantic_id")).alias("r"), functools.reduce(lambda a, b: a & b, same))
    return rows, members.select(*[F.col(f"m.{c}").alias(c) for c in scope_cols], "semantic_id", "member_pos", F.col("m.id").alias("member"))


def centroids(df: DataFrame, group_cols: Sequence[str], emb_col: str = "embedding") -> DataFrame:
    """D3: mean vector per group in long form ``(group, pos, value)``; rows
    without a vector are skipped."""
    ex = df.where(F.col(emb_col).isNotNull()).select(*group_cols, F.posexplode(emb_col).alias("pos", "v"))
    return ex.groupBy(*group_cols, "pos").agg(F.avg(F.col("v").cast("double")).alias("value")) \
        .withColumn("pos", (F.col("pos") + 1).cast("long"))


def block_pairs(df: DataFrame, threshold: float, scope_col: str | None = None, links: bool = False) -> DataFrame:
    """``id_a, id_b, sim`` of rows (id, seq, embedding[, scope]) with ``seq_a < seq_b`` and cosine >= threshold, exact.

    The vectors are stored as an index; blocks whose bounds to any pivot are further apart than the threshold's angle hold no pair and never
    meet, the others are multiplied tile by tile. With ``scope_col`` only rows of one scope count.
    With ``links`` (ids are numbers) a product gives edges with the same components instead of all its pairs, without ``sim``.
    """
    keys = ["id", "seq", *([scope_col] if scope_col else [])]
    base = df.select("id", F.col("seq").cast("long").alias("seq"), *([scope_col] if scope_col else []), F.col("embedding").alias("_emb"))
    if scope_col:
        base = base.withColumn(scope_col, F.xxhash64(scope_col))
    index = V.build_index(base, "_emb", keys, ["seq"], block_bytes=V.TILED_BYTES)
    reach = math.acos(min(1.0, threshold)) if threshold > 0 else math.pi
    id_type = df.schema["id"].dataType
    schema = T.StructType([T.StructField("id_a", id_type), T.StructField("id_b", id_type), T.StructField("sim", T.DoubleType())])

    def work(a: V.Block, blocks: list[V.Block], _) -> Iterator[pa.RecordBatch]:
        ids_a, seq_a = a.keys.column("id"), a.keys.column("seq").to_numpy(zero_copy_only=False)
        for b in blocks:
            ids_b, seq_b = b.keys.column("id"), b.keys.column("seq").to_numpy(zero_copy_only=False)
            for r, c, s in V.pairs_above(a, b, threshold):
                ok = np.ones(len(r), bool)
                if a.number == b.number:
                    ok &= seq_a[r] < seq_b[c]
                if scope_col:
                    scope_a, scope_b = (x.keys.column(scope_col).to_numpy(zero_copy_only=False) for x in (a, b))
                    ok &= scope_a[r] == scope_b[c]
                r, c, s = r[ok], c[ok], s[ok]
                if not len(r):
                    continue
                if links:
                    u, v = spanning_stars(ids_a.to_numpy(zero_copy_only=False)[r], ids_b.to_numpy(zero_copy_only=False)[c])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.float64())], ["id_a", "id_b", "sim"])
                    continue
                swap = pa.array(seq_a[r] > seq_b[c])
                left, right = ids_a.take(pa.array(r)), ids_b.take(pa.array(c))
                yield pa.RecordBatch.from_arrays([pc.if_else(swap, right, left), pc.if_else(swap, left, right), pa.array(s)],
                                                 ["id_a", "id_b", "sim"])

    return V.products(index, index, V.near_blocks(index, index, reach), work, schema)


def near_duplicate_pairs(df: DataFrame, threshold: float, emb_col: str = "embedding") -> DataFrame:
    """K7: pairs ``id_a, id_b, sim`` (``seq_a < seq_b``) with cosine >= threshold.

    Equal vectors are one class, whose representative is the row of least ``seq``: the result has all pairs of
    representatives, and one pair (representative, member) for every other row of a class, so a group
    of copies gives as many rows as it has members.
    """
    base = df.select("id", F.col("seq").cast("long").alias("seq"), F.col(emb_col).alias("embedding")) \
        .where(F.col(emb_col).isNotNull() & (F.size(emb_col) > 0))
    base = base.withColumn("_h", F.xxhash64("embedding"))
    first = base.groupBy("_h", "embedding").agg(F.min_by("id", "seq").alias("rep"), F.min("seq").alias("rep_seq"))
    reps = first.select(F.col("rep").alias("id"), F.col("rep_seq").alias("seq"), "embedding")
    among = block_pairs(reps, threshold)
    others = base.join(first, ["_h", "embedding"]).where(F.col("seq") > F.col("rep_seq"))
    stars = others.select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), cosine("embedding", "embedding").alias("sim"))
    return among.unionByName(stars.where(F.col("sim") >= threshold))
