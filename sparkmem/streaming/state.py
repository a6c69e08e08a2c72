"""State that streams keep per key: the working memory of a scope (I3), questions and their early answers (I4).

Both are ``applyInPandasWithState`` (I4 by parts of the questions): only keys that a micro-batch touches are read and written, the state store carries them over restarts, and
what a task holds of a key is bounded by the state, not by the batch: a key's rows come as chunks that are folded one after another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import WM_CHAR_BUDGET
from ..operators.working import budget_cut

SALTS = 8                  # lanes a question's answers are dealt to
PARTS = 512                # keys of the state of questions and answers


# --------------------------------------------------------------------------
# Working memory
# --------------------------------------------------------------------------
def _plain(v):
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v]
    return v.item() if isinstance(v, np.generic) else v


def newest_within(rows: list[tuple], budget: int) -> list[tuple]:
    """Of rows (seq, id, length, ...) the newest whose lengths stay within the budget, and the newest one evicted (the barrier, last).

    Rows without length stay while they are newer than the barrier. Whatever arrives later, all that is older than the barrier stays
    out, as the total before it only grows: the result of all rows is that of the kept ones and the new ones.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""), reverse=True)
    out, total = [], 0
    for r in rows:
        total += r[2]
        out.append(r)
        if r[2] and total > budget:
            break
    return out


def working_memory_by_scope(thoughts: DataFrame, char_budget: int = WM_CHAR_BUDGET) -> DataFrame:
    """The working memory of every scope that got rows in a micro-batch: its rows after the batch, in update mode.

    One row per item, ``kept`` false for the barrier; a scope's rows replace all that were given for it before. Each input batch is cut to the
    budget before it is shuffled.
    """
    cols = [c for c in thoughts.columns if c != "scope_id"]
    schema = T.StructType([thoughts.schema["scope_id"], *[thoughts.schema[c] for c in cols], T.StructField("kept", T.BooleanType())])
    sized = thoughts.withColumn("_len", F.coalesce(F.length("content"), F.lit(0)).cast("long"))
    some = budget_cut(sized, ["scope_id"], [("seq", False), ("id", False)], "_len", char_budget)
    at = [cols.index("seq"), cols.index("id")]

    def fold(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # (seq, id, length, the row's values)
        rows = [(v[at[0]], v[at[1]], n, v) for n, v in json.loads(state.get[0])] if state.exists else []
        for chunk in chunks:
            values = [[_plain(v) for v in r] for r in chunk[cols].itertuples(index=False, name=None)]
            rows += [(v[at[0]], v[at[1]], int(n), v) for v, n in zip(values, chunk["_len"])]
            rows = newest_within(rows, char_budget)
        state.update((json.dumps([(n, v) for _, _, n, v in rows]),))
        total = np.cumsum([n for _, _, n, _ in rows])
        kept = [bool(t <= char_budget or not r[2]) for t, r in zip(total, rows)]
        out = pd.DataFrame([v for _, _, _, v in rows], columns=cols, dtype=object)
        out.insert(0, "scope_id", key[0])
        out["kept"] = kept
        yield out[schema.names]

    return some.groupBy("scope_id").applyInPandasWithState(fold, schema, "rows string", "update", GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------------------
# I4: questions and answers
# --------------------------------------------------------------------------
DECISION = "scope_id string, qid string, seq long, answer_text string, answer_ts double, accepted boolean"
_OPEN = pa.schema([("scope_id", pa.string()), ("qid", pa.string()), ("created", pa.int64())])
_WAITING = pa.schema([("scope_id", pa.string()), ("qid", pa.string()), ("seq", pa.int64()), ("answer_text", pa.string()), ("answer_ts", pa.float64())])
_QUESTION = ["scope_id", "qid"]


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    table = pa.ipc.open_stream(raw).read_all() if raw else schema.empty_table()
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def decide_answers(questions: DataFrame, answers: DataFrame, salts: int = SALTS, parts: int = PARTS) -> DataFrame:
    """Every answer with ``accepted``: whether it applies to a question of an earlier ``seq`` (C1), whichever of the two arrives first.

    ``questions``: stream of (scope_id, id, seq, created_ts); ``answers``: stream of (scope_id, qid, seq, answer_text, answer_ts). A question
    stays open in the state store; an answer whose question has not come waits there, without a limit of time (a watermark would drop
    questions that come late). A key of the state is one of ``parts`` parts of the questions, whose rows are matched as columns: a key per
    question costs a call of Python each. A question's answers are dealt to ``salts`` lanes, each of which has the question in a part of its own,
    so a question that all the answers name is no one task's. ``parts`` and ``salts`` are part of the checkpoint: a stopped query keeps them.
    A question that comes again changes nothing (the earliest seq counts).
    """
    q = (questions.select("scope_id", F.col("id").alias("qid"), F.col("seq").cast("long").alias("seq"))
         .withColumns({"answer_text": F.lit(None).cast("string"), "answer_ts": F.lit(None).cast("double"), "is_question": F.lit(True),
                       "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))}))
    a = answers.select("scope_id", "qid", F.col("seq").cast("long").alias("seq"), "answer_text", F.col("answer_ts").cast("double").alias("answer_ts"),
                       F.lit(False).alias("is_question"), F.pmod(F.xxhash64("seq", "answer_text"), F.lit(salts)).cast("int").alias("salt"))
    both = q.unionByName(a).withColumn("part", F.pmod(F.xxhash64("salt", "scope_id", "qid"), F.lit(parts)).cast("int")).drop("salt")
    names = [x.split()[0] for x in DECISION.split(", ")]

    def match(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw = state.get if state.exists else (None, None)
        opened, waiting = _unpacked(raw[0], _OPEN), _unpacked(raw[1], _WAITING)
        for chunk in chunks:
            asks = chunk["is_question"].astype(bool)
            chunk["seq"] = chunk["seq"].astype("Int64")
            asked = chunk.loc[asks & chunk["seq"].notna(), [*_QUESTION, "seq"]].rename(columns={"seq": "created"})
            rows = chunk.loc[~asks, _WAITING.names]
            if len(asked):
                opened = pd.concat([opened, asked]).groupby(_QUESTION, dropna=False, as_index=False, sort=False)["created"].min()
                rows, waiting = pd.concat([waiting, rows]), waiting.iloc[:0]       # those that waited may have their question now
            met = rows.merge(opened, "left", on=_QUESTION)
            known = met["created"].notna()
            if known.any():
                out = met[known]
                yield out.assign(accepted=(out["seq"] > out["created"]).fillna(False).astype(bool))[names]
            waiting = pd.concat([waiting, met.loc[~known, _WAITING.names]])
        state.update((_packed(opened, _OPEN), _packed(waiting, _WAITING)))

    return both.groupBy("part").applyInPandasWithState(match, DECISION, "opened binary, waiting binary", "append", GroupStateTimeout.NoTimeout)
