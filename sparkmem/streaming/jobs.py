"""Structured Streaming jobs.

``foreachBatch`` jobs write each micro-batch to a ``batch_id=N`` / ``tick=N`` / ``version=N`` directory with overwrite, so a batch
replayed after a failure rewrites the same output (idempotent), and restarting a stopped query resumes from its
checkpoint. Only batch 0 may start without state; a later batch whose state can't be read fails.

* I1 ``ingest_stream``: stimuli -> validated and redacted -> episodic memory log rows + pending stimuli; its counters are
  observed while the batch is written (D4, ``live_counters``).
* I3 ``wm_stream``: working memory in keyed state, exact in any order of arrival; a version holds the scopes that got rows.
* I2 ``cycle_stream``: each micro-batch drains the pending stimuli and runs one cycle for every scope that has some.
  ``scheduled_cycles`` is driven by ticks instead: every tick runs a cycle of every scope, with or without stimuli.
  Memories are appended per tick and folded into one folder every so many ticks; a manifest names the live folders.
* I4 ``answer_stream``: questions and answers as two live logs, matched in keyed state; what is accepted feeds the next tick
  (``accepted_stimuli``).
* I5 ``run_available`` drains everything available, then stops (pause); calling it again resumes from the
  checkpoint. ``run_cycles`` runs n ticks on demand.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..constants import WM_CHAR_BUDGET
from ..operators import log as L
from ..plans.cycle import CycleResult, accept_stimuli, answer_memories, run_cycle, stimulus_memories
from ..sources.io import next_seq, stamp_stimuli
from . import state as S

WM_COLUMNS = ("scope_id", "id", "content", "tags", "importance", "uncertainty", "ts", "seq")
COMPACT_EVERY = 16         # ticks after which the folders of memories are folded into one


def run_available(stream: DataFrame, per_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Process everything available, then stop; returns the last batch id.

    How much a batch takes is the reader's choice (``maxFilesPerTrigger``).
    """
    q = (stream.writeStream.foreachBatch(per_batch).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    progress = q.lastProgress
    return int(progress["batchId"]) if progress else -1


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def ingest_stream(stimuli_stream: DataFrame, sink: str, checkpoint: str, as_of: float, redact: bool = True,
                  base_seq: int = 0) -> int:
    """Per batch, validate (B6) and redact (B9) the stimuli, then append memory rows and pending stimuli.

    A stream of ``read_stimuli(streaming=True)`` is numbered here: from ``base_seq`` on, after all rows of the batch before.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "seq" not in batch.columns:
            first = base_seq
            if batch_id > 0:
                first = int(spark.read.parquet(f"{sink}/next_seq/batch_id={batch_id - 1}").first()["next_seq"])
            batch = stamp_stimuli(batch, first)
        batch = batch.persist()                 # numbered and validated once for all that is written of it
        try:
            if "seq" not in stimuli_stream.columns:
                top = batch.agg(F.coalesce(F.max("seq") + 1, F.lit(first)).cast("long").alias("next_seq"))
                _write(top, f"{sink}/next_seq/batch_id={batch_id}")
            ok, bad = accept_stimuli(batch, redact)
            good, lost = Observation(), Observation()
            _write(ok.observe(good, F.count(F.lit(1)).alias("n")), f"{sink}/pending/batch_id={batch_id}")
            _write(bad.observe(lost, F.count(F.lit(1)).alias("n")), f"{sink}/rejected/batch_id={batch_id}")
            ok = spark.read.schema(ok.schema).parquet(f"{sink}/pending/batch_id={batch_id}")
            _write(stimulus_memories(ok, as_of), f"{sink}/memories/batch_id={batch_id}")
            _count(spark, sink, batch_id, stimuli_ingested=good.get["n"], stimuli_rejected=lost.get["n"])
        finally:
            batch.unpersist()
    return run_available(stimuli_stream, per_batch, checkpoint)


def _count(spark: SparkSession, sink: str, batch_id: int, **counts: int) -> None:
    rows = [(name, int(n)) for name, n in counts.items()]
    _write(spark.createDataFrame(rows, "name string, n long").coalesce(1), f"{sink}/counters/batch_id={batch_id}")


def live_counters(spark: SparkSession, *sinks: str) -> DataFrame:
    """``name, n`` summed over all batches so far, restarts included: each batch left what was observed while it was written, and a
    replayed batch replaced its own; no data is scanned."""
    rows = None
    for sink in sinks:
        more = spark.read.schema("name string, n long").parquet(f"{sink}/counters")
        rows = more if rows is None else rows.unionByName(more)
    return rows.groupBy("name").agg(F.sum("n").alias("n"))


def wm_stream(thoughts_stream: DataFrame, state_dir: str, checkpoint: str,
              char_budget: int = WM_CHAR_BUDGET) -> int:
    """Keep the working memory of every scope across micro-batches: a version holds the scopes that got rows in its batch."""
    def per_batch(changed: DataFrame, batch_id: int) -> None:
        _write(changed, f"{state_dir}/version={batch_id}")
    return run_available(S.working_memory_by_scope(thoughts_stream, char_budget), per_batch, checkpoint, "update")


def latest_state(spark: SparkSession, state_dir: str, last_batch: int) -> DataFrame:
    """The working memory after a batch: each scope's rows of its last version (without the barrier rows)."""
    rows = spark.read.parquet(state_dir).where(F.col("version") <= last_batch)
    last = rows.groupBy("scope_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["scope_id", "version"]).where("kept").drop("kept", "version")


def _memory_rows(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``like`` (null where they have none)."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def _tick(spark: SparkSession, out_dir: str, tick: int, scopes: DataFrame, stimuli: DataFrame, base_memories: DataFrame,
          wm0: DataFrame, as_of: float, cycle_kw: dict, folders: list[str] | None = None) -> CycleResult:
    """One cycle of ``scopes`` on the state after tick - 1; writes the state and results of ``tick``. ``folders`` hold the memories that
    came after the given store (all former ticks' by default)."""
    if tick > 0:
        wm = spark.read.parquet(f"{out_dir}/wm/version={tick - 1}")
        seq = int(spark.read.parquet(f"{out_dir}/clock/tick={tick - 1}").first()["next_seq"])
    else:
        wm = wm0.select(*WM_COLUMNS)
        seq = max(next_seq(wm0), next_seq(base_memories))
    if folders is None:
        folders = [f"{out_dir}/memories/tick={i}" for i in range(tick)]
    memories = base_memories
    if folders:
        rows = spark.read.schema(base_memories.schema).parquet(*folders)
        memories = base_memories.unionByName(rows.select(*base_memories.columns))
    res = run_cycle(scopes, stimuli, wm, memories, as_of, cycle_seq=seq, write_once=True, **cycle_kw)
    ran = Observation()
    _write(res.report.withColumn("batch_id", F.lit(tick).cast("long")).observe(ran, F.count(F.lit(1)).alias("n")), f"{out_dir}/report/tick={tick}")
    _count(spark, out_dir, tick, cycles_run=ran.get["n"])
    _write(res.interrupts, f"{out_dir}/interrupts/tick={tick}")
    _write(res.memory_rows.select(*base_memories.columns), f"{out_dir}/memories/tick={tick}")
    _write(res.wm.select(*WM_COLUMNS), f"{out_dir}/wm/version={tick}")
    _write(spark.createDataFrame([(seq + 1,)], "next_seq long"), f"{out_dir}/clock/tick={tick}")
    return res


def cycle_stream(stimuli_stream: DataFrame, base_memories: DataFrame, out_dir: str, checkpoint: str,
                 as_of: float, wm0: DataFrame, **cycle_kw) -> int:
    """One cycle per scope with pending stimuli in each micro-batch.

    A cycle's ``seq`` follows everything in the state at its start (``next_seq`` of the given store and working memory,
    then one per tick). Memories are appended per tick, never rewritten: ids are unique per (scope, cycle).
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        scopes = batch.select("scope_id").distinct()
        _tick(batch.sparkSession, out_dir, batch_id, scopes, batch, base_memories, wm0, as_of, cycle_kw)
    return run_available(stimuli_stream, per_batch, checkpoint)


def run_idle_cycle(scopes: DataFrame, base_memories: DataFrame, out_dir: str, tick: int, as_of: float,
                   wm0: DataFrame, **cycle_kw) -> CycleResult:
    """I2's idle tick: one cycle of every given scope without stimuli, as tick number ``tick`` of ``out_dir``."""
    spark = scopes.sparkSession
    none = spark.createDataFrame([], "scope_id string, seq long, id string, source string, content string, ts double")
    return _tick(spark, out_dir, tick, scopes, none, base_memories, wm0, as_of, cycle_kw)


def run_cycles(n: int, scopes: DataFrame, stimuli: DataFrame, base_memories: DataFrame, out_dir: str, as_of: float,
               wm0: DataFrame, first_tick: int = 0, **cycle_kw) -> list[CycleResult]:
    """N cycles on demand: the first drains ``stimuli``, the others are idle ticks."""
    if n < 1:
        raise ValueError("n must be >= 1")
    spark = scopes.sparkSession
    out = [_tick(spark, out_dir, first_tick, scopes, stimuli, base_memories, wm0, as_of, cycle_kw)]
    for k in range(1, n):
        out.append(run_idle_cycle(scopes, base_memories, out_dir, first_tick + k, as_of, wm0, **cycle_kw))
    return out


def compact_memories(base_memories: DataFrame, out_dir: str, ticks: int, path: str) -> DataFrame:
    """Fold the given store and the rows of ``ticks`` ticks into one snapshot at ``path``."""
    spark = base_memories.sparkSession
    rows = base_memories
    if ticks:
        new = spark.read.schema(base_memories.schema).parquet(*[f"{out_dir}/memories/tick={i}" for i in range(ticks)])
        rows = rows.unionByName(new.select(*base_memories.columns))
    _write(L.fold_log(rows.withColumn("op", F.lit("upsert"))), path)
    return spark.read.parquet(path)


def answer_stream(questions_stream: DataFrame, answers_stream: DataFrame, sink: str, checkpoint: str) -> int:
    """I4: questions and answers arrive as two streams, in any order. Every decision (``state.decide_answers``) is appended to the file
    sink ``sink`` once, whatever fails and restarts; readers of it (``accepted_stimuli``, ``decisions``) see only what was committed."""
    q = (S.decide_answers(questions_stream, answers_stream).writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    progress = q.lastProgress
    return int(progress["batchId"]) if progress else -1


def decisions(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memory log rows, stimuli, rejected answers) of all decisions so far (K4's rows)."""
    rows = spark.read.schema(S.DECISION).parquet(sink)
    mem, stim = answer_memories(_accepted(rows))
    return mem, stim, rows.where("not accepted").drop("accepted")


def _accepted(rows: DataFrame) -> DataFrame:
    return rows.where("accepted").select("scope_id", F.col("qid").alias("id"), "answer_text", "answer_ts", F.col("seq").alias("answer_seq"))


def accepted_stimuli(spark: SparkSession, sink: str) -> DataFrame:
    """The accepted answers as a stream of ``user`` stimuli (with the ``qid`` they answer): input of ``scheduled_cycles``."""
    rows = _accepted(spark.readStream.schema(S.DECISION).parquet(sink))
    return rows.select("scope_id", F.col("answer_seq").alias("seq"), F.lit("user").alias("source"), F.col("answer_text").alias("content"),
                       F.col("answer_ts").alias("ts"), F.col("id").alias("qid"))


def scheduled_cycles(ticks: DataFrame, stimuli: DataFrame, scopes: DataFrame, base_memories: DataFrame, out_dir: str, checkpoint: str,
                     wm0: DataFrame, trigger: dict | None = None, compact_every: int = COMPACT_EVERY, **cycle_kw) -> int:
    """I2 on a schedule: every tick runs one cycle of every scope in ``scopes`` (and of those with stimuli), idle or not.

    ``ticks``: stream with a column ``as_of`` (``clock`` makes one of a rate source); ``stimuli``: stream of
    (scope_id, seq, id, source, content, ts[, qid]), rows with ``qid`` are accepted answers and become memories too. A micro-batch without a tick
    keeps its stimuli for the next one. A batch's manifest names the tick that ran last, the folders of live memories
    (at most ``compact_every`` and the folded one) and the folders of stimuli that wait, so no batch lists what it does not read.
    """
    cols = {"scope_id": "string", "seq": "long", "id": "string", "source": "string", "content": "string", "ts": "double", "qid": "string"}
    have = {c: (F.col(c) if c in stimuli.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()}
    both = stimuli.select(*have.values(), F.lit(None).cast("double").alias("as_of")).unionByName(
        ticks.select(*[F.lit(None).cast(t).alias(c) for c, t in cols.items()], F.col("as_of").cast("double").alias("as_of")))
    schema = ", ".join(f"{c} {t}" for c, t in cols.items())

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = {"tick": -1, "memories": [], "waiting": []}
        if batch_id > 0:
            last = json.loads(spark.read.parquet(f"{out_dir}/manifest/batch_id={batch_id - 1}").first()["state"])
        here = f"{out_dir}/waiting/batch_id={batch_id}"
        fresh = Observation()
        batch = batch.persist()
        try:
            _write(batch.where("as_of is null").drop("as_of").observe(fresh, F.count(F.lit(1)).alias("n")), here)
            clock = batch.agg(F.max("as_of").alias("as_of")).first()["as_of"]
        finally:
            batch.unpersist()
        waiting = last["waiting"] + ([here] if fresh.get["n"] else [])
        if clock is None:
            state = {**last, "waiting": waiting}
        else:
            tick = last["tick"] + 1
            pending = spark.read.schema(schema).parquet(*waiting) if waiting else spark.createDataFrame([], schema)
            folders = list(last["memories"])
            answered = pending.where("qid is not null")
            if waiting:
                rows, _ = answer_memories(answered.select("scope_id", F.col("qid").alias("id"), F.col("content").alias("answer_text"),
                                                          F.col("ts").alias("answer_ts"), F.col("seq").alias("answer_seq")))
                _write(_memory_rows(rows, base_memories), f"{out_dir}/memories/answers={batch_id}")
                folders.append(f"{out_dir}/memories/answers={batch_id}")
            every = scopes.select("scope_id").unionByName(pending.select("scope_id")).distinct()
            _tick(spark, out_dir, tick, every, pending.drop("qid"), base_memories, wm0, clock, cycle_kw, folders)
            folders.append(f"{out_dir}/memories/tick={tick}")
            if len(folders) > compact_every:
                folded = f"{out_dir}/memories/upto={tick}"
                table = spark.read.schema(base_memories.schema).parquet(*folders)
                _write(L.fold_log(table.withColumn("op", F.lit("upsert"))).select(*base_memories.columns), folded)
                folders = [folded]
            state = {"tick": tick, "memories": folders, "waiting": []}
        _write(spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1), f"{out_dir}/manifest/batch_id={batch_id}")

    q = (both.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    if trigger:
        return -1                               # runs until the caller stops it
    q.awaitTermination()
    progress = q.lastProgress
    return int(progress["batchId"]) if progress else -1


def clock(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of ticks from Spark's rate source: ``as_of`` is the time of the tick."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("timestamp").cast("double").alias("as_of"))


def last_manifest(spark: SparkSession, out_dir: str, batch_id: int) -> dict:
    return json.loads(spark.read.parquet(f"{out_dir}/manifest/batch_id={batch_id}").first()["state"])


def stage(df: DataFrame, path: str, batches: int, key: str | None = None, mode: str = "overwrite", fmt: str = "parquet") -> int:
    """Turn a table into the input of a file stream, in one write, rows of one ``key`` together; returns how many files (``maxFilesPerTrigger``) make
    about one of ``batches`` batches. A batch is as many files as the session has cores, so that neither the write nor a batch is a few tasks'."""
    per = max(1, df.sparkSession.sparkContext.defaultParallelism)
    (df.repartition(batches * per, key) if key else df.repartition(batches * per)).write.mode(mode).format(fmt).save(path)
    return per
