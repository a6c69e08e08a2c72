"""Batch provider jobs: embedding, generation, store decision.

The default providers are deterministic: generation and store decisions are
Catalyst expressions (SHA-256 seed arithmetic, planned as separate
projections); the hash embedding is an Arrow-batched UDF. A pluggable provider is any object with
``embed(list[str]) -> list[list[float]]`` or ``generate(system, prompt) -> str``;
it runs in an iterator pandas UDF, so a model is loaded once per task and fed
Arrow batches, never one row at a time.
"""

from __future__ import annotations

from typing import Iterator, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (CYCLE_SYSTEM, DECIDER_PROMPT, DECIDER_SYSTEM, DECIDER_TAGS,
                         MAX_THOUGHT_WORDS, MEMORY_TYPES, NO_SNIPPET, STORE_THRESHOLD,
                         TEMPLATES, THOUGHT_TAGS, VECTOR_DIM)
from ..functions.hashing import add_hash_embedding, add_seed, seed_mod900
from ..functions.text import PY_WORD_CLASS, PY_WS_CLASS, py_split_words, py_splitlines, py_strip


class EmbeddingsProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TextProvider(Protocol):
    def generate(self, system: str, prompt: str) -> str: ...


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# J1
# ---------------------------------------------------------------------------
def embed_table(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = VECTOR_DIM,
                provider: EmbeddingsProvider | None = None) -> DataFrame:
    """Add ``out_col`` = embedding of ``text_col``."""
    if provider is None:
        return add_hash_embedding(df, text_col, out_col, dim)

    @F.pandas_udf("array<float>")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vals = provider.embed([("" if t is None else str(t)) for t in s.tolist()])
            yield pd.Series([list(map(float, v)) for v in vals])

    return df.withColumn(out_col, _embed(F.col(text_col)))


# ---------------------------------------------------------------------------
# J2 / J3 deterministic text provider
# ---------------------------------------------------------------------------
def _template_array() -> Column:
    return F.array(*[F.lit(t) for tag in THOUGHT_TAGS for t in TEMPLATES[tag]])


def stimuli_snippet(prompt) -> Column:
    """Last non-blank line containing ':' of the first ``Stimuli:`` block, with a
    leading ``word:`` label and the whitespace after it removed; '' if none."""
    block = F.regexp_extract(_c(prompt), r"(?s)Stimuli:\s*(.+)", 1)
    lines = py_splitlines(py_strip(block))
    cands = F.filter(lines, lambda ln: (F.length(py_strip(ln)) > 0) & (F.instr(ln, ":") > 0))
    last = F.when(F.size(cands) > 0, py_strip(F.element_at(cands, -1))).otherwise(F.lit(""))
    return F.regexp_replace(last, f"^{PY_WORD_CLASS}+:{PY_WS_CLASS}*", "")


def _thought_from(m: Column, snip: Column) -> Column:
    tag = F.element_at(F.array(*[F.lit(t) for t in THOUGHT_TAGS]), (m % 3 + 1).cast("int"))
    tmpl = F.element_at(_template_array(), ((m % 3) * 3 + (m % 15) / 5 + 1).cast("int"))
    x = F.when(F.length(snip) > 0, snip).otherwise(F.lit(NO_SNIPPET))
    sentence = F.replace(tmpl, F.lit("{x}"), x)
    words = F.slice(py_split_words(sentence), 1, MAX_THOUGHT_WORDS)
    return F.concat(tag, F.lit(" "), F.array_join(words, " "))


def _decision_from(m: Column) -> Column:
    imp = (m % 100).cast("double") / 100.0
    ttype = F.element_at(F.array(*[F.lit(t) for t in MEMORY_TYPES]), ((m % 9) / 3 + 1).cast("int"))
    tag = F.element_at(F.array(*[F.lit(t) for t in DECIDER_TAGS]), (m % 3 + 1).cast("int"))
    should = F.when(imp > STORE_THRESHOLD, F.lit("true")).otherwise(F.lit("false"))
    return F.concat(F.lit('{"should_store": '), should, F.lit(', "importance": '),
                    F.format_string("%.2f", F.least(F.lit(1.0), imp)), F.lit(', "type": "'), ttype,
                    F.lit('", "tags": ["auto","'), tag, F.lit('"]}'))


def deterministic_thought(system, prompt) -> Column:
    """Thought text of the deterministic generator for (system, prompt)."""
    return _thought_from(seed_mod900(system, prompt), stimuli_snippet(prompt))


def deterministic_decision(system, prompt) -> Column:
    """Decision JSON of the deterministic generator (``system`` starting with ``STORE_DECIDER:``)."""
    return _decision_from(seed_mod900(system, prompt))


def generate_table(df: DataFrame, system_col, prompt_col, out_col: str = "thought",
                   provider: TextProvider | None = None) -> DataFrame:
    """One generation per row (one row per scope-cycle).

    The deterministic provider is planned as separate projections (digest ->
    seed -> snippet -> text), so no intermediate is evaluated twice per row.
    """
    if provider is None:
        df = df.withColumn("_sys", _c(system_col)).withColumn("_prompt", _c(prompt_col))
        df = add_seed(df, "_sys", "_prompt", "_m")
        df = df.withColumn("_snip", stimuli_snippet("_prompt"))
        is_decider = py_strip(F.col("_sys")).startswith(DECIDER_SYSTEM)
        out = F.when(is_decider, _decision_from(F.col("_m"))).otherwise(_thought_from(F.col("_m"), F.col("_snip")))
        return df.withColumn(out_col, out).drop("_sys", "_prompt", "_m", "_snip")

    @F.pandas_udf("string")
    def _gen(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, p in batches:
            yield pd.Series([provider.generate(a, b) for a, b in zip(s.tolist(), p.tolist())])

    return df.withColumn(out_col, _gen(_c(system_col), _c(prompt_col)))


def decide_table(df: DataFrame, content_col: str, out_col: str = "decision_raw",
                 provider: TextProvider | None = None) -> DataFrame:
    """Store-decision reply for each thought (fed to ``route_store_decisions``)."""
    prompt = F.concat(F.lit(DECIDER_PROMPT), F.col(content_col))
    return generate_table(df, F.lit(DECIDER_SYSTEM), prompt, out_col, provider)


def cycle_system() -> Column:
    return F.lit(CYCLE_SYSTEM)
