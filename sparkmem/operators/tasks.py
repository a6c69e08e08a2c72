"""Task ranking.

A task log holds versions (``seq``); the latest version per id is scored and
ranked per scope. Claims are a log of ``(id, version_seq)``: claiming a task
hides that version, and an updated task (new ``seq``) is claimable again.
Ranking uses ``row_number() <= k`` per scope (partial WindowGroupLimit).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TASK_DAY_SECONDS, TASK_HOUR_SECONDS, TASK_WEIGHTS, TOPK_DEFAULT

SCOPE = ("scope_id",)


def _clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def urgency(deadline: Column, now: Column) -> Column:
    """0 without a deadline (null or 0); 1 when due or overdue; linear over a day."""
    dt = F.greatest(F.lit(0.0), deadline - now)
    return F.when(deadline.isNull() | (deadline == 0), F.lit(0.0)) \
        .otherwise(_clamp01(F.lit(1.0) - dt / F.lit(TASK_DAY_SECONDS)))


def recency(last_update: Column, now: Column) -> Column:
    dt = F.greatest(F.lit(0.0), now - last_update)
    return _clamp01(F.lit(1.0) / (F.lit(1.0) + dt / F.lit(TASK_HOUR_SECONDS)))


def score_tasks(df: DataFrame, as_of, weights: Sequence[float] = TASK_WEIGHTS,
                out_col: str = "score") -> DataFrame:
    """Weighted urgency, importance, uncertainty, recency and clamped goal fit."""
    now = as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    wu, wi, wn, wr, wg = (F.lit(float(w)) for w in weights)
    s = (wu * urgency(F.col("deadline_ts"), now) + wi * F.col("importance")
         + wn * F.col("uncertainty") + wr * recency(F.col("last_update_ts"), now)
         + wg * _clamp01(F.col("goal_fit")))
    return df.withColumn(out_col, s)


def current_tasks(log: DataFrame, key_cols: Sequence[str] = ("scope_id", "id")) -> DataFrame:
    """Latest version per task, with ``first_seq`` (first insertion, the tie-break): one aggregate over the log."""
    key_cols = list(key_cols)
    others = [c for c in log.columns if c not in key_cols]
    agg = log.groupBy(*key_cols).agg(F.min("seq").alias("first_seq"),
                                     F.max_by(F.struct(*[F.col(c) for c in others]), F.col("seq")).alias("_r"))
    return agg.select(*key_cols, *[F.col("_r")[c].alias(c) for c in others], "first_seq")


def _clock(tasks: DataFrame, as_of, rescore_at) -> Column:
    """When a task is scored: at ``rescore_at`` if given, else at the row's own ``scored_at`` (the score is frozen
    when a version is added), else at ``as_of``."""
    if rescore_at is not None:
        return rescore_at if isinstance(rescore_at, Column) else F.lit(float(rescore_at))
    now = as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    return F.coalesce(F.col("scored_at"), now) if "scored_at" in tasks.columns else now


def _ranked(tasks: DataFrame, as_of, k: int, scope_cols, weights, statuses, rescore_at=None) -> DataFrame:
    t = tasks if statuses is None else tasks.where(F.col("status").isin(*statuses))
    t = score_tasks(t, _clock(t, as_of, rescore_at), weights)
    order = [F.col("score").desc(), F.col("first_seq").asc(), F.col("id").asc()]
    w = Window.partitionBy(*scope_cols).orderBy(*order)
    return t.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def top_tasks(log: DataFrame, as_of, k: int = TOPK_DEFAULT, scope_cols: Sequence[str] = SCOPE,
              weights: Sequence[float] = TASK_WEIGHTS, statuses: Sequence[str] | None = None, rescore_at=None) -> DataFrame:
    """best ``k`` current tasks per scope (status does not filter unless asked).

    A log with ``scored_at`` keeps each version's score as of that time; ``rescore_at`` scores all anew.
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    return _ranked(current_tasks(log, list(scope_cols) + ["id"]), as_of, k, scope_cols, weights, statuses, rescore_at)


def _unclaimed(log: DataFrame, claims: DataFrame | None, scope_cols) -> DataFrame:
    cur = current_tasks(log, list(scope_cols) + ["id"])
    if claims is None:
        return cur
    c = claims.select(*scope_cols, "id", F.col("version_seq").alias("seq"))
    return cur.join(c, list(scope_cols) + ["id", "seq"], "left_anti")


def peek_task(log: DataFrame, as_of, claims: DataFrame | None = None,
              scope_cols: Sequence[str] = SCOPE, weights: Sequence[float] = TASK_WEIGHTS, rescore_at=None) -> DataFrame:
    """highest-scored unclaimed task per scope (``task_id``, ``score``)."""
    best = _ranked(_unclaimed(log, claims, scope_cols), as_of, 1, scope_cols, weights, None, rescore_at)
    return best.select(*scope_cols, F.col("id").alias("task_id"), "score")


def claim_next_tasks(log: DataFrame, as_of, claims: DataFrame | None = None, n: int = 1,
                     scope_cols: Sequence[str] = SCOPE,
                     weights: Sequence[float] = TASK_WEIGHTS, rescore_at=None) -> tuple[DataFrame, DataFrame]:
    """pop the best ``n`` unclaimed tasks per scope.

    Returns ``(claimed tasks with rank, claim rows to append)``.
    """
    best = _ranked(_unclaimed(log, claims, scope_cols), as_of, n, scope_cols, weights, None, rescore_at)
    new_claims = best.select(*scope_cols, "id", F.col("seq").alias("version_seq"))
    return best, new_claims
