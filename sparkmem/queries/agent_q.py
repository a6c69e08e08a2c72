"""Task, interrupt, thought and provider queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (CYCLE_SYSTEM, DECIDER_PROMPT, DECIDER_SYSTEM, MEMORY_TYPES, TEMPLATES,
                         THOUGHT_TAGS)
from ..operators import interrupts as I
from ..operators import tasks as TK
from ..operators import thoughts as TH
from ..operators.providers import decide_table, embed_table, generate_table
from ..registry import query
from ..sources import fixtures as fx
from ..sql_text import PY_WS_RE2, py_strip, seed900_sql, sql_lit, tasks_cte, thoughts_cte

AS_OF = fx.TASK_AS_OF


# --------------------------------------------------------------------------
# tasks
# --------------------------------------------------------------------------
@query("task_score", oracle=f"""
WITH {tasks_cte(AS_OF)}
SELECT scope_id, id, round(score, 6) AS score FROM scored
""")
def task_score(spark, sf):
    t = TK.score_tasks(fx.tasks(spark, sf), AS_OF)
    return t.select("scope_id", "id", F.round("score", 6).alias("score"))


@query("task_top", oracle=f"""
WITH {tasks_cte(AS_OF)}
SELECT scope_id, CAST(rank AS BIGINT) AS rank, id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, seq) AS rank FROM scored)
WHERE rank <= 5
""")
def task_top(spark, sf):
    t = TK.top_tasks(fx.tasks(spark, sf), AS_OF, k=5)
    return t.select("scope_id", "rank", "id", F.round("score", 6).alias("score"))


def _claim_two(spark, sf):
    return TK.claim_next_tasks(fx.tasks(spark, sf), AS_OF, claims=None, n=2)


@query("task_claim", oracle=f"""
WITH {tasks_cte(AS_OF)}
SELECT scope_id, id, seq AS version_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, seq) AS rank FROM scored)
WHERE rank <= 2
""")
def task_claim(spark, sf):
    _, claims = _claim_two(spark, sf)
    return claims.select("scope_id", "id", "version_seq")


@query("task_peek", oracle=f"""
WITH {tasks_cte(AS_OF)}
SELECT scope_id, id AS task_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, seq) AS rank FROM scored)
WHERE rank = 3
""")
def task_peek(spark, sf):
    _, claims = _claim_two(spark, sf)
    p = TK.peek_task(fx.tasks(spark, sf), AS_OF, claims=claims)
    return p.select("scope_id", "task_id", F.round("score", 6).alias("score"))


# --------------------------------------------------------------------------
# interrupts
# --------------------------------------------------------------------------
_IQ = """
WITH q AS (SELECT event_id AS seq, 'q:' || event_id AS id FROM events WHERE event_type = 'signup'),
a AS (SELECT event_id AS seq, 'q:' || (event_id - event_id % 3) AS qid, props AS answer_text,
             epoch(ts) AS answer_ts FROM events WHERE event_type = 'purchase')
"""


@query("interrupts_open", oracle=_IQ + """
SELECT id FROM q WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.qid = q.id AND a.seq > q.seq)
""")
def interrupts_open(spark, sf):
    return I.open_interrupts(fx.interrupt_log(spark, sf), fx.answers(spark, sf)).select("id")


@query("interrupts_answer", oracle=_IQ + """
SELECT q.id, arg_max(a.answer_text, a.seq) AS answer_text, round(arg_max(a.answer_ts, a.seq), 6) AS answer_ts,
       max(a.seq) AS answer_seq
FROM q JOIN a ON a.qid = q.id AND a.seq > q.seq GROUP BY q.id
""")
def interrupts_answer(spark, sf):
    answered, _ = I.answer_interrupts(fx.interrupt_log(spark, sf), fx.answers(spark, sf))
    return answered.select("id", "answer_text", F.round("answer_ts", 6).alias("answer_ts"), "answer_seq")


@query("interrupts_rejected", oracle=_IQ + """
SELECT a.seq, a.qid FROM a WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.id = a.qid AND a.seq > q.seq)
""")
def interrupts_rejected(spark, sf):
    _, rejects = I.answer_interrupts(fx.interrupt_log(spark, sf), fx.answers(spark, sf))
    return rejects.select("seq", "qid")


@query("interrupts_get", oracle=_IQ + """
SELECT q.id, count(a.seq) > 0 AS answered, arg_max(a.answer_text, a.seq) AS answer_text
FROM q LEFT JOIN a ON a.qid = q.id AND a.seq > q.seq
WHERE q.id IN (SELECT qid FROM a)
GROUP BY q.id
""")
def interrupts_get(spark, sf):
    ids = fx.answers(spark, sf).select("scope_id", F.col("qid").alias("id"))
    got = I.get_interrupts(fx.interrupt_log(spark, sf), fx.answers(spark, sf), ids)
    return got.select("id", "answered", "answer_text")


@query("question_extract", oracle=f"""
WITH {thoughts_cte(tagged=True)}
SELECT scope_id, seq, {py_strip('substr(content, 10)')} AS question
FROM thoughts WHERE starts_with(content, '#question') AND length({py_strip('substr(content, 10)')}) > 0
""")
def question_extract(spark, sf):
    q = TH.extract_questions(fx.thoughts(spark, sf, tagged=True))
    return q.select("scope_id", "seq", "question")


@query("thought_classify", oracle=f"""
WITH {thoughts_cte(tagged=True)},
c AS (SELECT scope_id, seq, CASE WHEN starts_with(content, '#plan') THEN 'plan'
                                 WHEN starts_with(content, '#question') THEN 'question'
                                 ELSE 'insight' END AS tag FROM thoughts)
SELECT scope_id, seq, tag, CASE WHEN tag <> 'insight' THEN 0.6 ELSE 0.5 END::DOUBLE AS importance,
       CASE WHEN tag = 'plan' THEN 0.4 ELSE 0.5 END::DOUBLE AS uncertainty FROM c
""")
def thought_classify(spark, sf):
    c = TH.classify_thoughts(fx.thoughts(spark, sf, tagged=True))
    return c.select("scope_id", "seq", "tag", "importance", "uncertainty")


# --------------------------------------------------------------------------
# deterministic providers
# --------------------------------------------------------------------------
@query("embed_hash", oracle="""
WITH src AS (SELECT doc_id, text FROM documents),
d AS (SELECT doc_id, list_transform(range(32), lambda j: ((('0x' || substr(sha256(text), 2 * j + 1, 2))::INTEGER - 128) / 128.0)) AS v
      FROM src WHERE text IS NOT NULL),
n AS (SELECT doc_id, v, sqrt(8.0 * list_sum(list_transform(v, lambda x: x * x))) + 1e-8 AS nrm FROM d)
SELECT doc_id, CAST(i + 1 AS BIGINT) AS pos, round(CAST(CAST(v[(i % 32) + 1] / nrm AS FLOAT) AS DOUBLE), 6) AS value
FROM n, range(256) t(i)
""")
def embed_hash(spark, sf):
    d = embed_table(fx.table(spark, sf, "documents", "doc_id", "text"), "text")
    return d.select("doc_id", F.posexplode("embedding").alias("p", "v")).select(
        "doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.round(F.col("v").cast("double"), 6).alias("value"))


def _templates_sql() -> str:
    return "[" + ", ".join(sql_lit(t) for tag in THOUGHT_TAGS for t in TEMPLATES[tag]) + "]"


_SYS = sql_lit(CYCLE_SYSTEM)
_BREAK_RE2 = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def thought_ctes(src: str) -> str:
    """CTEs ``tg_s .. tg_t`` over ``src`` (which has ``prompt``); the last adds ``m`` and
    ``thought`` = the deterministic generator's reply to (CYCLE_SYSTEM, prompt)."""
    return f"""tg_s AS (SELECT *, {seed900_sql(_SYS + " || '|' || prompt")} AS m,
             {py_strip("regexp_extract(prompt, '(?s)Stimuli:\\s*(.+)', 1)")} AS block FROM {src}),
tg_l AS (SELECT *, list_filter(regexp_split_to_array(block, '{_BREAK_RE2}'),
                            lambda x: length({py_strip('x')}) > 0 AND contains(x, ':')) AS cands FROM tg_s),
tg_x AS (SELECT *, CASE WHEN len(cands) > 0
                     THEN regexp_replace({py_strip('cands[-1]')}, '^[\\pL\\pN_]+:{PY_WS_RE2}*', '')
                     ELSE '' END AS snip FROM tg_l),
tg_u AS (SELECT *, (['#plan', '#question', '#insight'])[(m % 3) + 1] AS tag,
             replace(({_templates_sql()})[(m % 3) * 3 + (m % 15) // 5 + 1], '{{x}}',
                     CASE WHEN length(snip) > 0 THEN snip ELSE 'the goal' END) AS sentence FROM tg_x),
tg_t AS (SELECT *, tag || ' ' ||
       array_to_string(list_slice(regexp_split_to_array({py_strip('sentence')}, '{PY_WS_RE2}+'), 1, 60), ' ') AS thought
FROM tg_u)"""


@query("generate_hash", oracle=f"""
WITH p AS (
  SELECT CAST(conv_id AS VARCHAR) AS scope_id, turn AS seq,
         'Stimuli:' || chr(10) || role || ': ' || text AS prompt FROM conversations),
{thought_ctes('p')}
SELECT scope_id, seq, m AS seed, thought FROM tg_t
""")
def generate_hash(spark, sf):
    from ..functions.hashing import seed_mod900
    c = fx.table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    p = c.select(F.col("conv_id").cast("string").alias("scope_id"), F.col("turn").alias("seq"),
                 F.concat(F.lit("Stimuli:\n"), F.col("role"), F.lit(": "), F.col("text")).alias("prompt"))
    g = generate_table(p, F.lit(CYCLE_SYSTEM), "prompt", "thought")
    return g.select("scope_id", "seq", seed_mod900(F.lit(CYCLE_SYSTEM), F.col("prompt")).alias("seed"), "thought")


def _decision_sql(content: str) -> str:
    m = seed900_sql(f"{sql_lit(DECIDER_SYSTEM)} || '|' || {sql_lit(DECIDER_PROMPT)} || {content}")
    return m


@query("decide_hash", oracle=f"""
WITH {thoughts_cte()},
s AS (SELECT scope_id, seq, {_decision_sql('content')} AS m FROM thoughts)
SELECT scope_id, seq,
  '{{"should_store": ' || CASE WHEN (m % 100) / 100.0 > 0.55 THEN 'true' ELSE 'false' END ||
  ', "importance": ' || printf('%.2f', least(1.0, (m % 100) / 100.0)) ||
  ', "type": "' || (['episodic', 'semantic', 'procedural'])[(m % 9) // 3 + 1] ||
  '", "tags": ["auto","' || (['plan', 'question', 'insight'])[(m % 3) + 1] || '"]}}' AS raw
FROM s
""")
def decide_hash(spark, sf):
    d = decide_table(fx.thoughts(spark, sf), "content", "raw")
    return d.select("scope_id", "seq", "raw")


@query("store_route", oracle=f"""
WITH {thoughts_cte()},
s AS (SELECT scope_id, seq, {_decision_sql('content')} AS m FROM thoughts)
SELECT scope_id, seq, (m % 100) / 100.0 > 0.55 AS store,
       (['episodic', 'semantic', 'procedural'])[(m % 9) // 3 + 1] AS mem_type,
       round((m % 100) / 100.0, 6) AS mem_importance,
       '{{"tags":["auto","' || (['plan', 'question', 'insight'])[(m % 3) + 1] || '"]}}' AS metadata_json
FROM s
""")
def store_route(spark, sf):
    d = decide_table(fx.thoughts(spark, sf), "content", "decision_raw")
    r = TH.route_store_decisions(d)
    return r.select("scope_id", "seq", "store", "mem_type", F.round("mem_importance", 6).alias("mem_importance"),
                    "metadata_json")


__all__ = ["MEMORY_TYPES", "DECIDER_SYSTEM"]
