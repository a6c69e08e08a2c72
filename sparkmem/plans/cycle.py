"""K3 cycle, C4 report, K4 answer job, K1 ingest, D4 counters.

A cycle runs for every scope at once: context (K2) -> generated thought (J2)
-> tag (B2) -> working-memory append (E1 over kept state + new thought, exact
because eviction composes) -> store decision (J3, B3) -> memory log rows ->
question (B4) -> interrupt rows -> seed URLs when the user is unavailable (B5).
Everything is keyed by ``(scope, cycle)``; ids are hashes of the key, so a
replayed cycle writes the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (ANSWER_IMPORTANCE, DEFAULT_SELF_SUMMARY, LLM_CTX, STIMULUS_IMPORTANCE,
                         WM_CHAR_BUDGET)
from ..operators import interrupts as I
from ..operators import tasks as TK
from ..operators import thoughts as TH
from ..operators import working as W
from ..operators.pages import extract_seed_urls, pages_to_memories
from ..operators.providers import decide_table, embed_table, generate_table
from ..session import materialize
from .context import build_context


def _key(prefix: str, *cols) -> F.Column:
    h = F.sha2(F.concat_ws("\u0001", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                        for c in cols]), 256)
    return F.concat(F.lit(prefix), F.substring(h, 1, 16))


@dataclass
class CycleResult:
    context: DataFrame
    thoughts: DataFrame      # one per scope: id, content, tags, importance, uncertainty, ts, seq
    wm: DataFrame            # next working-memory state
    memory_rows: DataFrame   # upsert log rows for stored thoughts
    interrupts: DataFrame    # interrupt log rows
    seeds: DataFrame         # seed URLs (user unavailable only)
    page_memories: DataFrame | None   # K5 rows of those seeds, if pages were given
    report: DataFrame        # C4


def run_cycle(scopes: DataFrame, stimuli: DataFrame, wm: DataFrame, memories: DataFrame,
              as_of: float, cycle_seq: int, self_summary: str = DEFAULT_SELF_SUMMARY,
              ctx_tokens: int = LLM_CTX, wm_budget: int = WM_CHAR_BUDGET, user_available: bool = True,
              allow_hosts=(), tasks: DataFrame | None = None, task_claims: DataFrame | None = None,
              scope_cols: Sequence[str] = ("scope_id",), provider=None, embed=None,
              shared_memories: bool = False, pages: DataFrame | None = None, robots: DataFrame | None = None,
              page_kw: dict | None = None, write_once: bool = False) -> CycleResult:
    """K3 for every scope in ``scopes``; ``cycle_seq`` orders this cycle after the
    state's rows (it becomes the new thought's ``seq``).

    All results are plans; nothing runs until one is used. A caller that uses more than one (or loops cycles)
    passes ``write_once=True`` and writes the next state itself. With ``pages`` and ``robots`` the seed URLs of an
    unavailable user's questions are turned into memories (K5, one plan per question)."""
    sc = list(scope_cols)
    ctx = build_context(scopes, stimuli, wm, memories, as_of, self_summary, ctx_tokens,
                        scope_cols=sc, embed=embed, shared_memories=shared_memories)
    gen = generate_table(ctx.select(*sc, "system", "prompt"), "system", "prompt", "content", provider)
    th = TH.classify_thoughts(gen.select(*sc, "content"))
    th = th.select(*sc, _key("thought:", *sc, F.lit(cycle_seq)).alias("id"), "content", "tags", "importance",
                   "uncertainty", F.lit(float(as_of)).alias("ts"), F.lit(int(cycle_seq)).cast("long").alias("seq"))
    # one row per scope through all steps: each result below is a selection of it, no join of a thought with itself
    th_cols = th.columns
    full = TH.route_store_decisions(decide_table(th, "content", "decision_raw", provider))
    full = TH.question_column(full).withColumn("_created", F.lit(float(as_of)))
    full = full.withColumn("interrupt_id", F.when(F.col("question").isNotNull(), I.interrupt_id(sc, "seq", "question")))

    if write_once:
        # a caller that uses several results writes the thoughts and their routing once to the shared folder: the context
        # is then computed once, not once per result, and a lost executor re-reads them
        full = materialize(full, "thoughts")
        th = full.select(*th_cols)
    wm_cols = ["id", "content", "tags", "importance", "uncertainty", "ts", "seq"]
    state = wm.select(*sc, *wm_cols).unionByName(th.select(*sc, *wm_cols))
    next_wm = W.working_memory(state, wm_budget, sc).drop("wm_running")

    stored = full.where(F.col("store")).select(*sc, "id", "seq", "content", "mem_type", "mem_importance", "metadata_json")
    stored = embed_table(stored, "content", "embedding") if embed is None else embed(stored, "content", "embedding")
    mem_rows = stored.select(
        *sc, F.col("seq"), F.lit("upsert").alias("op"), _key("mem:", *sc, F.col("seq")).alias("id"),
        F.col("mem_type").alias("type"), "content", "embedding", F.col("mem_importance").alias("importance"),
        F.lit(float(as_of)).alias("created_at"), F.lit(float(as_of)).alias("last_access"), "metadata_json")

    intr = I.new_interrupt_rows(TH.extract_questions(th).withColumn("ts", F.lit(float(as_of))), sc)
    seeds = extract_seed_urls(intr.select(*sc, "id", "question"), "question", list(allow_hosts) if not
                              isinstance(allow_hosts, DataFrame) else allow_hosts,
                              user_available=user_available)

    page_rows = None
    if pages is not None and robots is not None and not user_available:
        plans = seeds.select(F.col("id").alias("plan_id"), F.col("pos"), F.col("seed"))
        found = pages_to_memories(plans, pages, allow_hosts, robots, as_of, **(page_kw or {}))
        owner = seeds.select(F.col("id").alias("plan_id"), *sc).distinct()
        page_rows = found.join(owner, "plan_id")

    report = full.select(
        *sc, F.col("id").alias("thought_id"), F.col("content").alias("thought"), "tags", F.col("store").alias("stored"),
        F.when(F.col("interrupt_id").isNotNull(), F.array("interrupt_id")).otherwise(F.array().cast("array<string>")).alias("interrupt_ids"))
    if tasks is not None:
        nxt = TK.peek_task(tasks, as_of, task_claims, sc)
        report = report.join(nxt.select(*sc, F.col("task_id").alias("next_task")), sc, "left")
    report = report.withColumn("cycle_seq", F.lit(int(cycle_seq)).cast("long"))
    return CycleResult(ctx, th, next_wm, mem_rows, intr, seeds, page_rows, report)


def stimulus_memories(stimuli: DataFrame, as_of: float, scope_cols: Sequence[str] = ("scope_id",),
                      embed=None) -> DataFrame:
    """Every stimulus becomes an episodic memory row (importance .3,
    metadata ``{"source": ...}``), keyed by a hash of (scope, seq, source, content)."""
    sc = list(scope_cols)
    m = stimuli.select(*sc, "seq", "source", "content")
    m = embed_table(m, "content", "embedding") if embed is None else embed(m, "content", "embedding")
    return m.select(*sc, "seq", F.lit("upsert").alias("op"),
                    _key("stim:", *sc, "seq", "source", "content").alias("id"),
                    F.lit("episodic").alias("type"), "content", "embedding",
                    F.lit(STIMULUS_IMPORTANCE).alias("importance"),
                    F.lit(float(as_of)).alias("created_at"), F.lit(float(as_of)).alias("last_access"),
                    F.to_json(F.struct(F.col("source"))).alias("metadata_json"))


def answer_memories(accepted: DataFrame, scope_cols: Sequence[str] = ("scope_id",),
                    embed=None) -> tuple[DataFrame, DataFrame]:
    """K4: every accepted answer (``interrupts.accepted_answers``) becomes an
    episodic memory (importance .4, metadata ``{source: interrupt, qid}``) and a
    ``user`` stimulus for the next cycle. "Last answer wins" concerns the
    interrupt's own state only, so the rows don't depend on how answers are batched."""
    sc = list(scope_cols)
    a = accepted.select(*sc, F.col("answer_seq").alias("seq"), F.col("id").alias("qid"),
                        F.col("answer_text").alias("content"), F.col("answer_ts").alias("ts"))
    a = embed_table(a, "content", "embedding") if embed is None else embed(a, "content", "embedding")
    mem = a.select(*sc, "seq", F.lit("upsert").alias("op"), _key("mem:", *sc, "seq", "qid").alias("id"),
                   F.lit("episodic").alias("type"), "content", "embedding",
                   F.lit(ANSWER_IMPORTANCE).alias("importance"), F.col("ts").alias("created_at"),
                   F.col("ts").alias("last_access"),
                   F.to_json(F.struct(F.lit("interrupt").alias("source"), F.col("qid"))).alias("metadata_json"))
    stim = a.select(*sc, "seq", _key("ans:", *sc, "seq").alias("id"), F.lit("user").alias("source"),
                    "content", "ts")
    return mem, stim


def answer_job(interrupts: DataFrame, answers: DataFrame, wm: DataFrame, memories: DataFrame, as_of: float,
               cycle_seq: int, scope_cols: Sequence[str] = ("scope_id",), **cycle_kw) -> tuple[DataFrame, DataFrame, CycleResult]:
    """K4 whole: match the answers (C1), turn each accepted one into a memory and a stimulus, and run one cycle
    (K3) on them. Returns ``(memory log rows, rejected answers, cycle result)``; the cycle sees the new memories."""
    sc = list(scope_cols)
    _, rejected = I.answer_interrupts(interrupts, answers, sc)
    rows, stimuli = answer_memories(I.accepted_answers(interrupts, answers, sc), sc)
    cols = memories.columns
    store = memories.unionByName(rows.select(*[c for c in cols if c in rows.columns]), allowMissingColumns=True)
    res = run_cycle(stimuli.select(*sc), stimuli, wm, store, as_of, cycle_seq, scope_cols=sc, **cycle_kw)
    return rows, rejected, res


def service_counters(stimuli: DataFrame, cycles: DataFrame) -> DataFrame:
    """Stimuli ingested and cycles run, as one row (two global counts)."""
    s = stimuli.agg(F.count(F.lit(1)).alias("stimuli_ingested")).withColumn("_k", F.lit(0))
    c = cycles.agg(F.count(F.lit(1)).alias("cycles_run")).withColumn("_k", F.lit(0))
    return s.join(c, "_k").drop("_k")


def ingest_job(stimuli: DataFrame, as_of: float, scope_cols: Sequence[str] = ("scope_id",),
               redact: bool = True, embed=None, wm: DataFrame | None = None,
               view: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """K1: validate (B6) -> redact PII (B9) -> memory log rows with embeddings.

    Returns ``(memory log rows, rejected stimuli with reasons, queued count per scope, working-memory view)``; the
    view is the last ``view`` items (E2) of the scopes that got stimuli, if ``wm`` is given.
    """
    sc = list(scope_cols)
    ok, bad = accept_stimuli(stimuli, redact)
    rows = stimulus_memories(ok, as_of, sc, embed)
    queued = ok.groupBy(*sc).agg(F.count(F.lit(1)).alias("queued"))
    seen = None if wm is None else W.wm_view(wm.join(queued.select(*sc), sc, "left_semi"), view, sc)
    return rows, bad, queued, seen


def accept_stimuli(stimuli: DataFrame, redact: bool = True) -> tuple[DataFrame, DataFrame]:
    """B6 and B9 of an ingest: ``(accepted rows, masked; rejected rows with reasons)``."""
    from ..operators.validate import redact_pii, validate
    ok, bad = validate(stimuli.withColumn("source", F.coalesce(F.col("source"), F.lit("api"))), "stimulus")
    return (redact_pii(ok, "content") if redact else ok), bad
