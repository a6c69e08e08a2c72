"""Interrupts: questions opened by cycles and answered later.

Both sides are logs. An answer applies to an interrupt that exists (created
at an earlier ``seq``); re-answering overwrites (last answer wins); an answer
to an unknown id is rejected. Answers are matched with one join against one
row per interrupt id, then reduced per id with ``max_by`` (partial
aggregation, so a hot question does not land whole in one task).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("scope_id",)


def _matched(interrupts: DataFrame, answers: DataFrame, scope_cols: Sequence[str]) -> DataFrame:
    q = interrupts.select(*scope_cols, F.col("id").alias("qid"), F.col("seq").alias("_created_seq"))
    a = answers.join(q, list(scope_cols) + ["qid"], "left")
    return a.withColumn("_valid", F.col("_created_seq").isNotNull() & (F.col("seq") > F.col("_created_seq")))


def answer_interrupts(interrupts: DataFrame, answers: DataFrame,
                      scope_cols: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """``(answered interrupts, rejected answers)``.

    ``answers``: ``scope, seq, qid, answer_text, answer_ts``.
    """
    m = _matched(interrupts, answers, scope_cols)
    rejects = m.where(~F.col("_valid")).drop("_created_seq", "_valid")
    last = (m.where(F.col("_valid")).groupBy(*scope_cols, "qid")
            .agg(F.max_by(F.struct("answer_text", "answer_ts", F.col("seq").alias("answer_seq")), F.col("seq")).alias("_a")))
    answered = (interrupts.join(last.withColumnRenamed("qid", "id"), list(scope_cols) + ["id"])
                .select(*interrupts.columns, F.lit(True).alias("answered"),
                        F.col("_a.answer_text").alias("answer_text"), F.col("_a.answer_ts").alias("answer_ts"),
                        F.col("_a.answer_seq").alias("answer_seq")))
    return answered, rejects


def accepted_answers(interrupts: DataFrame, answers: DataFrame, scope_cols: Sequence[str] = KEY) -> DataFrame:
    """Every answer that applies to an interrupt (not only the last one): ``scope, id, answer_text, answer_ts, answer_seq``."""
    m = _matched(interrupts, answers, scope_cols).where(F.col("_valid"))
    return m.select(*scope_cols, F.col("qid").alias("id"), "answer_text", "answer_ts", F.col("seq").alias("answer_seq"))


def interrupt_state(interrupts: DataFrame, answers: DataFrame, scope_cols: Sequence[str] = KEY) -> DataFrame:
    """Every interrupt with ``answered``/``answer_text``/``answer_ts`` (nulls when open)."""
    answered, _ = answer_interrupts(interrupts, answers, scope_cols)
    a = answered.select(*scope_cols, "id", "answered", "answer_text", "answer_ts", "answer_seq")
    return (interrupts.join(a, list(scope_cols) + ["id"], "left")
            .withColumn("answered", F.coalesce(F.col("answered"), F.lit(False))))


def open_interrupts(interrupts: DataFrame, answers: DataFrame, scope_cols: Sequence[str] = KEY) -> DataFrame:
    """G1: created minus answered."""
    m = _matched(interrupts, answers, scope_cols).where(F.col("_valid")).select(*scope_cols, F.col("qid").alias("id"))
    return interrupts.join(m, list(scope_cols) + ["id"], "left_anti")


def get_interrupts(interrupts: DataFrame, answers: DataFrame, ids: DataFrame,
                   scope_cols: Sequence[str] = KEY) -> DataFrame:
    """Lookup by id (missing ids give no row)."""
    st = interrupt_state(interrupts, answers, scope_cols)
    return st.join(ids.select(*scope_cols, "id").distinct(), list(scope_cols) + ["id"], "left_semi")


def interrupt_id(scope_cols: Sequence[str], seq_col: str, question_col: str) -> Column:
    """``q:`` + hash of (scope, seq, question), so that two questions in one millisecond never collide."""
    key = F.sha2(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in scope_cols],
                             F.col(seq_col).cast("string"), F.col(question_col)), 256)
    return F.concat(F.lit("q:"), F.substring(key, 1, 16))


def new_interrupt_rows(questions: DataFrame, scope_cols: Sequence[str] = KEY,
                       seq_col: str = "seq", ts_col: str = "ts") -> DataFrame:
    """Interrupt log rows from extracted questions."""
    return questions.select(*scope_cols, F.col(seq_col).alias("seq"), interrupt_id(scope_cols, seq_col, "question").alias("id"),
                            "question", "rationale", "required_fields", F.col(ts_col).alias("created_ts"))
