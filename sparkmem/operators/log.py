"""Memory table as an append-only log and its fold.

Log rows: ``scope_id, seq, op, id`` + payload, with ``op`` in
``upsert | delete | delete_all``. The table is the fold of the log:

* per ``(scope_id, id)``, the latest upsert (by ``seq``) gives every column
  except ``created_at``, which comes from the first upsert after the id's last
  barrier;
* a barrier is the id's last ``delete`` or its scope's last ``delete_all``;
  upserts at or before it are ignored, and an id with no upsert after it is
  not live.

Plan: barriers are small aggregates (one row per deleted key / wiped scope,
partial aggregation before the shuffle); the upserts are joined to them (AQE
turns the join into a broadcast when the measured barrier side is small and
splits a hot key's partition when it is not) and folded with
``min_by``/``max_by``, which aggregate partially on the map side, so a hot id
never lands whole in one task.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMORY_COLUMNS = ("id", "type", "content", "embedding", "importance", "created_at",
                  "last_access", "metadata_json")
_NO_BARRIER = -(1 << 62)


def fold_log(log: DataFrame, key_cols: Sequence[str] = ("scope_id", "id"),
             scope_cols: Sequence[str] = ("scope_id",), seq_col: str = "seq",
             op_col: str = "op", keep_first: Sequence[str] = ("created_at",)) -> DataFrame:
    """A3: fold an upsert/delete/delete_all log into the live table (one row per key)."""
    key_cols, scope_cols = list(key_cols), list(scope_cols)
    payload = [c for c in log.columns if c not in set(key_cols) | {op_col}]
    op = F.col(op_col)
    dels = (log.where(op == "delete").groupBy(*key_cols)
            .agg(F.max(seq_col).alias("_del")))
    ups = log.where(op == "upsert")
    ups = ups.join(dels, key_cols, "left")
    barrier = F.col("_del")
    if scope_cols:
        dall = (log.where(op == "delete_all").groupBy(*scope_cols)
                .agg(F.max(seq_col).alias("_dall")))
        ups = ups.join(dall, scope_cols, "left")
        barrier = F.greatest(F.col("_del"), F.col("_dall"))
    ups = ups.where(F.col(seq_col) > F.coalesce(barrier, F.lit(_NO_BARRIER)))
    latest = [c for c in payload if c not in keep_first]
    aggs = [F.min_by(F.col(c), F.col(seq_col)).alias(c) for c in keep_first if c in payload]
    aggs.append(F.max_by(F.struct(*[F.col(c) for c in latest]), F.col(seq_col)).alias("_last"))
    folded = ups.groupBy(*key_cols).agg(*aggs)
    out_cols = [F.col(c) for c in key_cols] + [
        (F.col(c) if c in keep_first else F.col("_last")[c]).alias(c) for c in payload]
    return folded.select(*out_cols)


def latest_by_key(df: DataFrame, key_cols: Sequence[str], seq_col: str = "seq") -> DataFrame:
    """Last write wins per key (``max_by`` of the whole row by ``seq``)."""
    others = [c for c in df.columns if c not in key_cols]
    agg = df.groupBy(*key_cols).agg(F.max_by(F.struct(*[F.col(c) for c in others]), F.col(seq_col)).alias("_r"))
    return agg.select(*key_cols, *[F.col("_r")[c].alias(c) for c in others])


def upsert_rows(memories: DataFrame, seq: Column | None = None) -> DataFrame:
    """Memory rows -> log rows (``op = 'upsert'``)."""
    df = memories if seq is None else memories.withColumn("seq", seq)
    return df.withColumn("op", F.lit("upsert"))


def tombstones(ids: DataFrame, seq_col: str = "seq", op: str = "delete") -> DataFrame:
    """Delete requests ``(scope_id, id, seq)`` -> log rows with null payload."""
    return ids.withColumn("op", F.lit(op))


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows to a log (missing payload columns become null)."""
    return log.unionByName(rows, allowMissingColumns=True)


def get_memories(table: DataFrame, ids, key_cols: Sequence[str] = ("id",)) -> DataFrame:
    """A4: point lookups. ``ids`` is a list of ids (few) or a DataFrame of keys (many)."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select(*key_cols).distinct(), list(key_cols), "left_semi")
    ids = list(ids)
    return table.where(F.col(key_cols[0]).isin(ids)) if ids else table.limit(0)


def delete_memories(table: DataFrame, requests: DataFrame,
                    key_cols: Sequence[str] = ("scope_id", "id")) -> tuple[DataFrame, DataFrame]:
    """A5: delete by id. Returns ``(tombstone log rows, result per request)``.

    ``requests`` has the key columns and ``seq``; the result carries
    ``deleted = True`` when the id was live (the reference's row count > 0).
    """
    key_cols = list(key_cols)
    live = table.select(*key_cols).distinct().withColumn("_live", F.lit(True))
    result = (requests.join(live, key_cols, "left")
              .select(*requests.columns, F.coalesce(F.col("_live"), F.lit(False)).alias("deleted")))
    return tombstones(requests.select(*key_cols, "seq")), result


def delete_all(table: DataFrame, requests: DataFrame,
               scope_cols: Sequence[str] = ("scope_id",)) -> tuple[DataFrame, DataFrame]:
    """Erase a scope, only when ``confirm.lower() == 'yes'``.

    ``requests``: ``scope cols, seq, confirm``. Returns ``(tombstones, result)``
    where result has ``accepted`` and ``deleted`` (live rows erased; null when
    the confirmation is refused, the reference's HTTP 400).
    """
    scope_cols = list(scope_cols)
    ok = F.lower(F.col("confirm")) == "yes"
    counts = table.groupBy(*scope_cols).agg(F.count(F.lit(1)).alias("_n"))
    result = (requests.join(counts, scope_cols, "left")
              .select(*requests.columns, ok.alias("accepted"),
                      F.when(ok, F.coalesce(F.col("_n"), F.lit(0))).cast("long").alias("deleted")))
    stones = requests.where(ok).select(*scope_cols, "seq").withColumn("op", F.lit("delete_all"))
    return stones, result


def scan_memories(spark, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A2: column-pruned scan of a folded memory snapshot (parquet)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def compact(log: DataFrame, path: str, partition_by: Sequence[str] = ("type",), **fold_kw) -> DataFrame:
    """Write the folded table as a new snapshot directory, partitioned by ``type``.

    Precomputes ``content_lc`` and ``norm`` for the search jobs. Never
    overwrite a path that is being read: give each version its own ``path``.
    """
    from ..functions.vector import l2norm
    t = fold_log(log, **fold_kw)
    t = t.withColumn("content_lc", F.lower("content")).withColumn("norm", l2norm("embedding"))
    t.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return log.sparkSession.read.parquet(path)
