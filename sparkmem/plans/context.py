"""K2: per-scope prompt context for a cycle, for every scope at once.

stimuli -> newest-first budgeted lines (E4) -> query text (or "general")
-> embedding (J1) -> top-8 memories of the scope (C3) -> budgeted LTM lines (E5);
working memory -> decayed, budgeted summary lines (E3);
-> ``system`` and ``prompt`` strings with the Self / WM / LTM / Stimuli sections.

Shuffles: all are by scope. Memories are read once; from a store bucketed by
scope (``operators.store``) without an exchange. Every per-scope list that is
collected is bounded by a character budget or by k.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (CYCLE_RETRIEVAL_K, CYCLE_SYSTEM, DEFAULT_SELF_SUMMARY, EMPTY_STIMULI_QUERY,
                         LLM_CTX, PROMPT_TAIL, WM_HALF_LIFE_SECONDS)
from ..operators import search as S
from ..operators import working as W
from ..operators.providers import embed_table


def build_context(scopes: DataFrame, stimuli: DataFrame, wm: DataFrame, memories: DataFrame,
                  as_of: float, self_summary: str = DEFAULT_SELF_SUMMARY, ctx_tokens: int = LLM_CTX,
                  k: int = CYCLE_RETRIEVAL_K, half_life: float = WM_HALF_LIFE_SECONDS,
                  shared_memories: bool = False, scope_cols: Sequence[str] = ("scope_id",),
                  embed=None) -> DataFrame:
    """One row per scope: ``system, prompt, stim_text, query_text`` and line counts.

    ``scopes``: the scopes that run a cycle (a scope with no pending stimuli
    still runs one). ``shared_memories=True`` searches one store for every
    scope (the reference's single store) instead of the scope's own memories.
    """
    sc = list(scope_cols)
    embed = embed or (lambda df, c, o: embed_table(df, c, out_col=o))
    stim = W.join_lines(W.stimuli_lines(stimuli, ctx_tokens, sc), "pos", scope_cols=sc, out_col="stim_text") \
        .withColumnRenamed("n_lines", "n_stim_lines")
    base = scopes.select(*sc).distinct().join(stim, sc, "left")
    base = base.withColumn("stim_text", F.coalesce(F.col("stim_text"), F.lit(""))) \
        .withColumn("n_stim_lines", F.coalesce(F.col("n_stim_lines"), F.lit(0)).cast("long"))
    base = base.withColumn("query_text", F.when(F.length("stim_text") > 0, F.col("stim_text"))
                           .otherwise(F.lit(EMPTY_STIMULI_QUERY)))
    q = embed(base.select(*sc, "query_text"), "query_text", "_qv")
    if shared_memories:
        qq = q.select(F.struct(*sc).alias("qid"), F.col("_qv").alias("embedding"))
        hits = S.vector_hits(memories, qq, k)
        hits = hits.select(*[F.col("qid")[c].alias(c) for c in sc], "id", "seq", "sim", "rank")
        hits = hits.join(memories.select("id", "type", "content"), "id")
    else:
        hits = S.scope_hits(memories, q.select(*sc, F.col("_qv").alias("embedding")), k, scope_cols=sc, keep=("id", "type", "content"))
    ltm = W.join_lines(W.memory_lines(hits, ctx_tokens, sc), "rank", scope_cols=sc, out_col="ltm_text") \
        .withColumnRenamed("n_lines", "n_ltm_lines")
    wml = W.join_lines(W.wm_lines(wm, as_of, half_life, ctx_tokens, sc), "rank", scope_cols=sc, out_col="wm_text") \
        .withColumnRenamed("n_lines", "n_wm_lines")
    out = base.join(ltm, sc, "left").join(wml, sc, "left")
    out = (out.withColumn("ltm_text", F.coalesce(F.col("ltm_text"), F.lit("")))
           .withColumn("wm_text", F.coalesce(F.col("wm_text"), F.lit("")))
           .withColumn("n_ltm_lines", F.coalesce(F.col("n_ltm_lines"), F.lit(0)).cast("long"))
           .withColumn("n_wm_lines", F.coalesce(F.col("n_wm_lines"), F.lit(0)).cast("long")))
    prompt = F.concat(F.lit(f"Self: {self_summary}\nWM:\n"), F.col("wm_text"), F.lit("\nLTM:\n"),
                      F.col("ltm_text"), F.lit("\nStimuli:\n"), F.col("stim_text"), F.lit("\n" + PROMPT_TAIL))
    return out.select(*sc, F.lit(CYCLE_SYSTEM).alias("system"), prompt.alias("prompt"), "stim_text",
                      "query_text", "wm_text", "ltm_text", "n_stim_lines", "n_wm_lines", "n_ltm_lines")
