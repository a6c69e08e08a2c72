"""Working memory: decay scores and character-budgeted frames.

Every budgeted selection in the reference is "walk the items in some order and
stop at the first one that would exceed the budget". With non-negative lengths
the running sum is monotone, so that is exactly ``running_sum <= budget``.

Scale notes. A running sum over a whole scope gets no WindowGroupLimit, so a
hot scope would sort its entire history in one task. ``budget_prefix`` first
cuts every Arrow batch of the input to what the budget can need of it
(``budget_cut``: no shuffle, about budget / mean length rows of a scope and
batch leave it); one shuffle by scope and the running sum then see only those.
Zero-length rows are re-attached by comparing with the first row that fails the
budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (LLM_CTX, LTM_SHARE, RECENT_THOUGHTS_CAP, STIMULI_SHARE,
                         WM_CHAR_BUDGET, WM_HALF_LIFE_SECONDS, WM_SHARE)
from ..functions.text import py_strip, render_tags

SCOPE = ("scope_id",)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decay_score(df: DataFrame, as_of, half_life: float = WM_HALF_LIFE_SECONDS,
                importance_col: str = "importance", ts_col: str = "ts",
                out_col: str = "score") -> DataFrame:
    """B1: ``importance * 0.5 ** (max(0, as_of - ts) / half_life)``; half_life <= 0 -> no decay."""
    as_of_c = as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    if half_life <= 0:
        decay = F.lit(1.0)
    else:
        age = F.greatest(F.lit(0.0), as_of_c - F.col(ts_col))
        decay = F.pow(F.lit(0.5), age / F.lit(float(half_life)))
    return df.withColumn(out_col, F.col(importance_col) * decay)


def budget_cut(df: DataFrame, partition_cols: Sequence[str], order: Sequence[tuple[str, bool]], length_col: str, budget: int) -> DataFrame:
    """What a budgeted prefix per partition can need of ``df``, found without a shuffle: the mergeable half of ``budget_prefix``.

    Of each Arrow batch and partition the rows in order while the batch's *own* running total of ``length_col`` is within the budget, the first that
    fails, and rows that tie with it. A local total is never above the global one, so no row of the result is lost; and what a batch
    keeps is about budget / mean length rows of a partition, however hot it is. ``order``: (column, ascending), nulls as Spark sorts them.
    """
    parts = list(partition_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            group = np.zeros(n, np.int64)
            for c in parts:
                code = pd.factorize(b.column(b.schema.get_field_index(c)).to_pandas(), use_na_sentinel=False)[0]
                group = np.unique(group * (code.max() + 1) + code, return_inverse=True)[1]
            keys = {"g": pa.array(group)}
            for k, (c, _) in enumerate(order):
                col = b.column(b.schema.get_field_index(c))
                keys[f"n{k}"], keys[f"v{k}"] = col.is_valid().cast(pa.int8()), col
            by = [("g", "ascending")]
            for k, (_, up) in enumerate(order):            # Spark: nulls are smallest
                by += [(f"{x}{k}", "ascending" if up else "descending") for x in "nv"]
            at = pc.sort_indices(pa.table(keys), sort_keys=by).to_numpy()
            g = group[at]
            length = pc.fill_null(b.column(b.schema.get_field_index(length_col)), 0).to_numpy(zero_copy_only=False)[at]
            total = np.cumsum(length)
            start = np.searchsorted(g, g)
            before = total - length - (total[start] - length[start])     # of the partition, without the row itself
            keep = before <= budget
            # rows beyond the first that fails stay if they tie with it
            lost = np.flatnonzero(~keep)
            first = lost[np.concatenate([[True], g[lost][1:] != g[lost][:-1]])] if len(lost) else lost
            if len(first):
                cols = [keys[f"{x}{k}"].take(pa.array(at)).to_pandas().to_numpy() for k in range(len(order)) for x in "nv"]
                for f in first:
                    r = f
                    while r < n and g[r] == g[f] and all(v[r] == v[f - 1] or (pd.isna(v[r]) and pd.isna(v[f - 1])) for v in cols):
                        keep[r] = True
                        r += 1
            yield b.take(pa.array(np.sort(at[keep])))

    return df.mapInArrow(run, df.schema)


def budget_prefix(df: DataFrame, partition_cols: Sequence[str], order_col: str, descending: bool,
                  length_col: str, budget: int, tiebreak: Sequence = (),
                  allow_zero_length: bool = True, running_col: str = "running_chars", few: bool = False) -> DataFrame:
    """Rows, in order, while the running total of ``length_col`` stays within ``budget``.

    ``order_col`` (+ ``tiebreak`` columns, ascending) fixes a total order per
    partition. Lengths must be >= 0. Adds ``running_col``. ``few``: partitions are
    known to be small, so nothing is cut before the running sum.
    """
    if budget < 0:
        return df.limit(0).withColumn(running_col, F.lit(None).cast("long"))
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    order = [o] + [(_col(t)) for t in tiebreak]
    parts = list(partition_cols)
    w = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(*order)
    wrun = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.col(length_col).cast("long")
    nonzero = df.where(length > 0) if allow_zero_length else df
    if few:
        run = nonzero.withColumn(running_col, F.sum(length).over(wrun))
        return run.where(F.col(running_col) <= budget)
    cut_order = [(order_col, not descending)] + [(f"_t{k}", True) for k in range(len(tiebreak))]
    capped = budget_cut(nonzero.withColumns({f"_t{k}": _col(t) for k, t in enumerate(tiebreak)}), parts, cut_order, length_col, budget)
    capped = capped.drop(*[f"_t{k}" for k in range(len(tiebreak))])
    run = capped.withColumn(running_col, F.sum(length).over(wrun))
    kept = run.where(F.col(running_col) <= budget)
    if not allow_zero_length:
        return kept
    # First failing non-empty row per partition: zero-length rows before it are kept.
    fail_key = F.max(order_col) if descending else F.min(order_col)
    cut = run.where(F.col(running_col) > budget).groupBy(*parts).agg(fail_key.alias("_cut"))
    zeros = df.where(length == 0)
    if parts:
        zeros = zeros.join(cut, parts, "left")
    else:  # one global partition: the cut is a single row
        zeros = zeros.withColumn("_k", F.lit(0)).join(
            F.broadcast(cut.withColumn("_k", F.lit(0))), "_k", "left").drop("_k")
    before = (F.col(order_col) > F.col("_cut")) if descending else (F.col(order_col) < F.col("_cut"))
    zeros = (zeros.where(F.col("_cut").isNull() | before).drop("_cut")
             .withColumn(running_col, F.lit(None).cast("long")))
    return kept.unionByName(zeros)


def working_memory(thoughts: DataFrame, char_budget: int = WM_CHAR_BUDGET,
                   scope_cols: Sequence[str] = SCOPE, seq_col: str = "seq",
                   content_col: str = "content") -> DataFrame:
    """FIFO buffer after appending every thought in ``seq`` order, evicting the
    oldest while the total exceeds ``char_budget``.

    Equal to the longest newest-first run of items whose total length fits,
    so one item longer than the budget empties the buffer. Adds ``wm_len``.
    """
    df = thoughts.withColumn("wm_len", F.coalesce(F.length(content_col), F.lit(0)).cast("long"))
    return budget_prefix(df, scope_cols, seq_col, True, "wm_len", char_budget,
                         running_col="wm_running")


def wm_view(wm: DataFrame, n: int = 10, scope_cols: Sequence[str] = SCOPE,
            seq_col: str = "seq") -> DataFrame:
    """The last ``n`` (>= 1) items of the buffer, oldest first (``pos`` 1..n)."""
    n = max(1, int(n))
    w = Window.partitionBy(*scope_cols).orderBy(F.col(seq_col).desc())
    last = wm.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    w2 = Window.partitionBy(*scope_cols).orderBy(F.col(seq_col).asc())
    return last.drop("_rn").withColumn("pos", F.row_number().over(w2).cast("long"))


def wm_lines(wm: DataFrame, as_of, half_life: float = WM_HALF_LIFE_SECONDS,
             ctx_tokens: int = LLM_CTX, scope_cols: Sequence[str] = SCOPE,
             seq_col: str = "seq") -> DataFrame:
    """Summary lines ``- ['tag'] content`` by decayed score (ties: arrival),
    while their total length stays within ``int(ctx * 4 * 0.30)``.

    Columns: scope, ``rank`` (1-based, summary order), ``line``, ``score``.
    """
    budget = int(ctx_tokens * 4 * WM_SHARE)
    scored = decay_score(wm, as_of, half_life)
    lines = scored.select(
        *scope_cols, F.col(seq_col), F.col("score"),
        F.concat(F.lit("- "), render_tags("tags"), F.lit(" "), py_strip("content")).alias("line"))
    lines = lines.withColumn("line_len", F.length("line").cast("long"))
    # order: score desc, then arrival (seq asc) -- expressed as a composite key
    lines = lines.withColumn("_neg", -F.col("score"))
    kept = budget_prefix(lines, scope_cols, "_neg", False, "line_len", budget,
                         tiebreak=[seq_col], allow_zero_length=False)
    w = Window.partitionBy(*scope_cols).orderBy(F.col("_neg").asc(), F.col(seq_col).asc())
    return kept.withColumn("rank", F.row_number().over(w).cast("long")).drop("_neg")


def join_lines(lines: DataFrame, order_col: str, line_col: str = "line",
               scope_cols: Sequence[str] = SCOPE, out_col: str = "text") -> DataFrame:
    """Newline-join bounded per-scope lines in ``order_col`` order (one row per scope)."""
    return lines.groupBy(*scope_cols).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("k"),
                                                                      F.col(line_col).alias("v")))),
                                 lambda x: x["v"]), "\n").alias(out_col),
        F.count(F.lit(1)).alias("n_lines"))


def stimuli_lines(stimuli: DataFrame, ctx_tokens: int = LLM_CTX,
                  scope_cols: Sequence[str] = SCOPE, seq_col: str = "seq") -> DataFrame:
    """``source: content`` lines newest first within ``int(ctx * 4 * 0.20)``;
    ``pos`` gives the output order (oldest first)."""
    budget = int(ctx_tokens * 4 * STIMULI_SHARE)
    lines = stimuli.select(*scope_cols, F.col(seq_col),
                           F.concat(F.col("source"), F.lit(": "), py_strip("content")).alias("line"))
    lines = lines.withColumn("line_len", F.length("line").cast("long"))
    kept = budget_prefix(lines, scope_cols, seq_col, True, "line_len", budget, allow_zero_length=False)
    w = Window.partitionBy(*scope_cols).orderBy(F.col(seq_col).asc())
    return kept.withColumn("pos", F.row_number().over(w).cast("long"))


def memory_lines(hits: DataFrame, ctx_tokens: int = LLM_CTX, scope_cols: Sequence[str] = SCOPE,
                 rank_col: str = "rank") -> DataFrame:
    """E5: ``type:content`` in similarity order within ``int(ctx * 4 * 0.50)``."""
    budget = int(ctx_tokens * 4 * LTM_SHARE)
    lines = hits.select(*scope_cols, F.col(rank_col),
                        F.concat(F.col("type"), F.lit(":"), py_strip("content")).alias("line"))
    lines = lines.withColumn("line_len", F.length("line").cast("long"))
    return budget_prefix(lines, scope_cols, rank_col, False, "line_len", budget, allow_zero_length=False, few=True)   # at most k


def recent_thoughts(thoughts: DataFrame, k: int = 10, cap: int = RECENT_THOUGHTS_CAP,
                    scope_cols: Sequence[str] = SCOPE, seq_col: str = "seq") -> DataFrame:
    """The newest ``min(k, cap)`` thoughts of the ring, oldest first (``pos``)."""
    n = min(max(1, int(k)), int(cap))
    return wm_view(thoughts, n, scope_cols, seq_col)


def wm_usage(wm: DataFrame, scope_cols: Sequence[str] = SCOPE) -> DataFrame:
    """Characters and items held per scope."""
    return wm.groupBy(*scope_cols).agg(
        F.sum(F.length("content")).cast("long").alias("wm_chars"),
        F.count(F.lit(1)).alias("wm_items"))
