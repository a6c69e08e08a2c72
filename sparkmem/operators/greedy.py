"""The greedy fold of consolidation (K6) in rounds, for groups of any size.

An item joins the first cluster, in order of creation, whose running centroid has cosine >= threshold, else it opens one. The rule goes by order, so
a group's items are taken in rounds of at most ROUND_ITEMS (runs of equal vectors count once). A cluster stays as it is until an item joins
it, and the first that does is within the threshold of the centroid that the round found: so of all earlier clusters a round's fold needs only those that
some item of the round reaches as they stand. Those are found by matrix products spread over tasks (blocks of clusters by blocks of
items); the fold of a round then sees its own items and these clusters, and returns what it changed. The result is that of the plain fold.

What a task holds is bounded by ROUND_ITEMS items and CLUSTER_BLOCK clusters, or the clusters that a round reaches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COSINE_EPS
from ..session import materialize, scratch_path

ROUND_ITEMS = 16_384       # items of a group that one round folds
CLUSTER_BLOCK = 4_096      # clusters that a task compares with a round's items


class Clusters:
    """Clusters of one vector length, in order of creation: running sums and counts."""

    def __init__(self, dim: int, room: int = 16):
        self.sums, self.counts, self.numbers = np.zeros((room, dim)), np.zeros(room), []

    def add(self, number: int, total: np.ndarray, count: float) -> None:
        k = len(self.numbers)
        if k == len(self.counts):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.sums[k], self.counts[k] = total, count
        self.numbers.append(number)

    def first_within(self, e: np.ndarray, threshold: float) -> int:
        """Place of the first cluster whose centroid reaches the threshold, -1 if none does."""
        k = len(self.numbers)
        if not k:
            return -1
        c = self.sums[:k] / self.counts[:k, None]
        sims = (c @ e) / ((np.sqrt((c * c).sum(axis=1)) + COSINE_EPS) * (np.sqrt(e @ e) + COSINE_EPS))
        hit = np.nonzero(sims >= threshold)[0]
        return int(hit[0]) if len(hit) else -1


def fold(vectors: Sequence, times: Sequence[int], threshold: float, known: dict[int, Clusters], next_number: int, dim: int) -> list[int]:
    """Cluster number per item; ``known`` (by vector length) is changed in place. ``times``: copies of an item that follow one another; they
    join the same cluster, as the first copy only moves its centroid towards the next. An item without a vector is alone."""
    out = []
    for v, n in zip(vectors, times):
        if v is None or len(v) == 0:
            known.setdefault(dim, Clusters(dim)).add(next_number, np.zeros(dim), 1.0)
            out.append(next_number)
            next_number += 1
            continue
        e = np.asarray(v, dtype=np.float64)
        mine = known.setdefault(len(e), Clusters(len(e)))
        at = mine.first_within(e, threshold)
        if at < 0:
            mine.add(next_number, e * n, n)
            out.append(next_number)
            next_number += 1
        else:
            mine.sums[at] += e * n
            mine.counts[at] += n
            out.append(mine.numbers[at])
    return out


# --------------------------------------------------------------------------
# Numbering of runs
# --------------------------------------------------------------------------
def number_runs(rows: DataFrame) -> DataFrame:
    """(group, row, node, n, run) of rows (group, pos, row, node): ``run`` numbers the runs of equal nodes in the order of (group, pos, node).

    Rows are sorted by ranges, so a group is no task's; each partition numbers its own runs, and the partitions' first and last rows (two per
    partition) tell what to add.
    """
    spark = rows.sparkSession
    ordered = rows.select("group", "pos", "row", "node").repartitionByRange("group", "pos", "node").sortWithinPartitions("group", "pos", "node")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        last, run = None, -1
        for b in batches:
            if not b.num_rows:
                continue
            g, node = b.column(0).to_numpy(), b.column(2).to_numpy()
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1])
            new[0] = (g[0], node[0]) != last
            runs = run + np.cumsum(new)
            last, run = (g[-1], node[-1]), int(runs[-1])
            yield pa.RecordBatch.from_arrays([pa.array(g), b.column(1), pa.array(node), pa.array(np.full(len(g), part, np.int32)), pa.array(runs)],
                                             ["group", "row", "node", "part", "local"])

    local = materialize(ordered.select("group", "row", "node").mapInArrow(number, "group long, row long, node long, part int, local long"), "runs")
    ends = local.groupBy("part").agg(F.min_by(F.struct("group", "node"), "local").alias("first"), F.max_by(F.struct("group", "node"), "local").alias("last"),
                                     F.max("local").alias("top")).orderBy("part").collect()
    offsets, start, before = [], 0, None
    for e in ends:
        start -= before is not None and tuple(e["first"]) == before        # the run goes on
        offsets.append((e["part"], start))
        start, before = start + e["top"] + 1, tuple(e["last"])
    table = spark.createDataFrame(offsets, "part int, start long")
    return local.join(F.broadcast(table), "part").select("group", "row", "node", (F.col("local") + F.col("start")).alias("run"))


# --------------------------------------------------------------------------
# Rounds
# --------------------------------------------------------------------------
OUT = "group long, run long, cluster long, total binary, count double"


def fold_groups(runs: DataFrame, vectors: DataFrame, threshold: float, dim: int, round_items: int = ROUND_ITEMS,
                cluster_block: int = CLUSTER_BLOCK) -> DataFrame:
    """(group, run, cluster) of runs (group, run, node, n) with vectors (node, embedding); clusters are numbered per group in order of creation."""
    spark = runs.sparkSession
    least = runs.groupBy("group").agg(F.min("run").alias("least"), F.count(F.lit(1)).alias("items"))
    items = (runs.join(least, "group").withColumn("round", F.floor((F.col("run") - F.col("least")) / round_items).cast("int"))
             .withColumn("last", F.floor((F.col("items") - 1) / round_items).cast("int"))
             .join(vectors, "node").select("group", "run", "n", "embedding", "last", "round"))
    path = scratch_path(spark, "fold-items")
    items.write.partitionBy("round").parquet(path)
    schema = items.schema
    rounds = int(spark.read.schema(schema).parquet(path).agg(F.max("round")).first()[0] or 0) + 1 if least.limit(1).count() else 0

    def step(key, mine: pd.DataFrame, before: pd.DataFrame | None) -> pd.DataFrame:
        mine = mine.sort_values("run")
        known: dict[int, Clusters] = {}
        old: dict[int, tuple] = {}
        if before is not None:
            for number, total, count in before.sort_values("cluster")[["cluster", "total", "count"]].itertuples(index=False):
                x = np.frombuffer(total, "<f8")
                known.setdefault(len(x), Clusters(len(x))).add(int(number), x, count)
                old[int(number)] = count
        numbers = fold(mine["embedding"], mine["n"], threshold, known, int(mine["next"].iloc[0]), dim)
        found = pd.DataFrame({"group": key[0], "run": mine["run"].to_numpy(), "cluster": numbers, "total": None, "count": np.nan})
        if not (mine["last"] > mine["round"]).iloc[0]:
            return found                                    # no round follows: the clusters' state is of no more use
        changed = [(key[0], None, c, k.sums[i].astype("<f8").tobytes(), k.counts[i]) for k in known.values() for i, c in enumerate(k.numbers)
                   if k.counts[i] != old.get(c)]
        return pd.concat([found, pd.DataFrame(changed, columns=found.columns)], ignore_index=True)

    def reached(key, mine: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """Clusters of the block that some item of the round reaches as they stand."""
        hit = np.zeros(len(block), bool)
        sums = [np.frombuffer(t, "<f8") for t in block["total"]]
        for d in {len(s) for s in sums}:
            at = np.array([i for i, s in enumerate(sums) if len(s) == d])
            c = np.array([sums[i] for i in at]) / block["count"].to_numpy()[at, None]
            e = [np.asarray(v, np.float64) for v in mine["embedding"] if len(v) == d]
            cn = np.sqrt((c * c).sum(1)) + COSINE_EPS
            for lo in range(0, len(e), 512):
                x = np.array(e[lo:lo + 512])
                sims = (x @ c.T) / np.outer(np.sqrt((x * x).sum(1)) + COSINE_EPS, cn)
                hit[at] |= (sims >= threshold - 1e-9).any(axis=0)
        return block.loc[hit, ["group", "cluster", "total", "count"]]

    assigned, state = [], None
    for r in range(rounds):
        mine = spark.read.schema(schema).parquet(path).where(F.col("round") == r)
        if state is None:
            done = mine.withColumn("next", F.lit(0).cast("long")).groupBy("group").applyInPandas(lambda key, pdf: step(key, pdf, None), OUT)
        else:
            size = state.groupBy("group").agg((F.max("cluster") + 1).alias("next"))
            mine = mine.join(size, "group")
            blocks = state.withColumn("block", F.floor(F.col("cluster") / cluster_block).cast("long"))
            asked = mine.select("group", "embedding", F.explode(F.expr(f"sequence(0L, (next - 1) div {cluster_block})")).alias("block"))
            near = asked.groupBy("group", "block").cogroup(blocks.groupBy("group", "block")).applyInPandas(
                reached, "group long, cluster long, total binary, count double")
            done = mine.groupBy("group").cogroup(near.groupBy("group")).applyInPandas(
                lambda key, left, right: step(key, left, right) if len(left) else pd.DataFrame(columns=[x.split()[0] for x in OUT.split(", ")]), OUT)
        done = materialize(done, "fold-round")
        assigned.append(done.where("run is not null").select("group", "run", "cluster"))
        if r + 1 < rounds:
            changed = done.where("run is null").select("group", "cluster", "total", "count")
            live = changed if state is None else changed.unionByName(
                state.join(mine.where("last > round").select("group").distinct(), "group", "left_semi").join(changed, ["group", "cluster"], "left_anti"))
            state = materialize(live, "fold-state")
    if not assigned:
        return runs.select("group", "run", F.lit(0).cast("long").alias("cluster")).limit(0)
    out = assigned[0]
    for more in itertools.islice(assigned, 1, None):
        out = out.unionByName(more)
    return out
