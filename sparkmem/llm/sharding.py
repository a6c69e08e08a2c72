"""Operator 1, sharding: best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) are taken by falling size; each enters the bin with the tightest room
that still holds it, found in an ordered (balanced) tree of remaining room. Groups of one size are
interchangeable, so the packing runs over the histogram (size, number of groups): a run of equal
sizes fills the tightest bin as far as it goes, then the next. The histogram has at most
sqrt(2 * total bytes) rows, whatever the number of documents, and that is all the driver sees; rows
find their shard by joins on group, size and rank.

Nulls and odd input: a null text has no bytes and forms its own group; empty texts are one group;
repeated rows are one group and each gets a slot; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

RANK_PARTS = 64      # parts of one size's groups when they are numbered
SLOT_PARTS = 1024    # parts of one shard's rows when they are numbered


class RoomTree:
    """Ordered tree of (room, bin): a sorted list of short sorted lists (a two-level B-tree)."""

    WIDTH = 512

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = []

    def add(self, room: int, b: int) -> None:
        if not self.leaves:
            self.leaves.append([(room, b)])
            return
        i = min(bisect.bisect_left([x[-1] for x in self.leaves], (room, b)), len(self.leaves) - 1)
        bisect.insort(self.leaves[i], (room, b))
        if len(self.leaves[i]) > self.WIDTH:
            half = self.leaves[i]
            self.leaves[i:i + 1] = [half[:self.WIDTH // 2], half[self.WIDTH // 2:]]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of at least ``size``."""
        i = bisect.bisect_left([x[-1] for x in self.leaves], (size, -1))
        if i == len(self.leaves):
            return None
        leaf = self.leaves[i]
        found = leaf.pop(bisect.bisect_left(leaf, (size, -1)))
        if not leaf:
            del self.leaves[i]
        return found


def best_fit_decreasing(hist: list[tuple[int, int]], capacity: int, most_bins: int | None = None):
    """[(size, first rank, last rank + 1, bin)], number of bins; None if more than ``most_bins`` are needed.

    ``hist``: (size, count) by falling size. A group larger than the capacity gets a bin of its own.
    """
    tree, plan, n_bins = RoomTree(), [], 0
    for size, count in hist:
        done = 0
        while done < count:
            found = tree.take_tightest(size)
            if found is None:
                if most_bins is not None and n_bins == most_bins:
                    return None
                found, n_bins = (max(capacity, size), n_bins), n_bins + 1
            room, b = found
            take = min(count - done, room // size if size else count)
            plan.append((size, done, done + take, b))
            done += take
            tree.add(room - take * size, b)
    return plan, n_bins


def pack_into(hist: list[tuple[int, int]], n_bins: int):
    """Plan for exactly the bins 0..n_bins-1 with sizes as equal as the groups allow.

    A group above the mean of what is left gets a bin of its own (it can't be split). For the rest,
    the least capacity for which best-fit-decreasing needs no more than the bins left is found by
    halving.
    """
    hist = sorted(((s, c) for s, c in hist if c), reverse=True)
    plan, used = [], 0
    total = sum(s * c for s, c in hist)
    while hist and used < n_bins - 1 and hist[0][0] * (n_bins - used) > total:
        size, count = hist[0]
        rank = sum(1 for p in plan if p[0] == size)
        plan.append((size, rank, rank + 1, used))
        used, total = used + 1, total - size
        hist = ([(size, count - 1)] if count > 1 else []) + hist[1:]
    if not hist:
        return plan
    shift = {hist[0][0]: sum(1 for p in plan if p[0] == hist[0][0])}
    left = n_bins - used
    low, high = max(hist[0][0], math.ceil(total / left)), max(hist[0][0], math.ceil(total / left)) * 2
    while (best := best_fit_decreasing(hist, high, left)) is None:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        found = best_fit_decreasing(hist, mid, left)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid
    return plan + [(s, a + shift.get(s, 0), z + shift.get(s, 0), b + used) for s, a, z, b in best[0]]


def number_rows(df: DataFrame, key: str, order: list, out: str, parts: int) -> DataFrame:
    """Gapless numbers from 0 within ``key``, without one task holding a whole key.

    Rows are dealt to ``parts`` parts of a key by the hash of the order columns, numbered there, and
    shifted by the counts of the parts before.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    df = df.withColumn("_part", part)
    sizes = df.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_part")
    before = sizes.select(key, "_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    numbered = df.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1)
    return (numbered.join(before, [key, "_part"])
            .withColumn(out, (F.col("_r") + F.col("_before")).cast("long")).drop("_part", "_r", "_before"))


def shard(rows: DataFrame, n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows (id, size, group_key).

    ``capacity``: fixed shard capacity, as few shards as best-fit-decreasing finds. ``n_shards``: that
    many shards of sizes as equal as the groups allow. Give one of them.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give n_shards or capacity")
    spark = rows.sparkSession
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"))
    groups = written(groups, "shard-groups")
    hist = [(int(r[0]), int(r[1])) for r in
            groups.groupBy("group_size").agg(F.count("*").alias("n")).orderBy(F.desc("group_size")).collect()]
    if n_shards is not None:
        plan = pack_into(hist, n_shards)
    else:
        plan = best_fit_decreasing(hist, capacity)[0]
    plan_df = spark.createDataFrame(plan or [], "group_size long, from_rank long, to_rank long, shard int")
    ranked = number_rows(groups, "group_size", ["group_key"], "_rank", RANK_PARTS)
    placed = (ranked.join(plan_df, "group_size")
              .where((F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank")))
              .select("group_key", "shard"))
    out = rows.join(placed, "group_key")
    return number_rows(out, "shard", ["id"], "slot", SLOT_PARTS)


def document_rows(docs: DataFrame) -> DataFrame:
    """(id, size, text_crc32, group_key) of documents; a null text is a group of its own."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"null")).alias("group_key"))
