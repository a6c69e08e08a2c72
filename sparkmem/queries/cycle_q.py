"""Composite job queries (K2, K3/C4, D4) over conversations + documents + orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import DECIDER_PROMPT, DECIDER_SYSTEM, DEFAULT_SELF_SUMMARY, PROMPT_TAIL
from ..operators import interrupts as I
from ..operators.store import MemoryStore
from .agent_q import thought_ctes
from ..operators import working as W
from ..plans.context import build_context
from ..plans.cycle import answer_memories, run_cycle, service_counters
from ..plans.cycle import answer_job as answer_job_plan
from ..plans.cycle import ingest_job as ingest_job_plan
from ..registry import query
from ..sources import fixtures as fx
from ..sql_text import (N_CONV_SQL, T0, cosine_sql, hash_vec_ctes, memories_cte, py_strip, redact_sql, seed900_sql, sql_lit,
                        tasks_cte, thoughts_cte, wm_cte)

AS_OF = T0 + 3600.0
TASK_AS_OF = fx.TASK_AS_OF


def _inputs(spark, sf):
    scopes = fx.table(spark, sf, "conversations", "conv_id").select(F.col("conv_id").cast("string").alias("scope_id"))
    stimuli = fx.stimuli_chat(spark, sf)
    wm = W.working_memory(fx.thoughts(spark, sf), 4000)
    mem = fx.memories(spark, sf, null_embedding_every=0)
    return scopes, stimuli, wm, mem


def ctx_sql(stimuli: bool = True) -> str:
    """CTEs up to ``p``: the prompt of every scope; without stimuli for an idle tick."""
    return f"""
WITH {thoughts_cte()}, {wm_cte()},
sl AS (SELECT CAST(conv_id AS VARCHAR) AS scope_id, turn AS seq, 'chat: ' || {py_strip('text')} AS line
       FROM conversations WHERE role = 'user' AND {'true' if stimuli else 'false'}),
sr AS (SELECT *, SUM(length(line)) OVER (PARTITION BY scope_id ORDER BY seq DESC
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM sl),
stim AS (SELECT scope_id, string_agg(line, chr(10) ORDER BY seq) AS stim_text, count(*) AS n_stim
         FROM sr WHERE used <= 6553 GROUP BY scope_id),
scopes AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS scope_id FROM conversations),
base AS (SELECT s.scope_id, coalesce(t.stim_text, '') AS stim_text, coalesce(t.n_stim, 0) AS n_stim
         FROM scopes s LEFT JOIN stim t USING (scope_id)),
bq AS (SELECT scope_id, CASE WHEN length(stim_text) > 0 THEN stim_text ELSE 'general' END AS qtext FROM base),
{hash_vec_ctes('qv', 'bq', 'scope_id', 'qtext')},
{memories_cte()},
{hash_vec_ctes('mv', 'mem', 'scope_id, seq, id, type, content', 'content')},
sims AS (SELECT mv.scope_id, mv.seq, mv.type, mv.content, {cosine_sql('qv.embedding', 'mv.embedding')} AS cos
         FROM mv JOIN qv USING (scope_id)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY cos DESC, seq) AS rk FROM sims)
         WHERE rk <= 8),
ll AS (SELECT scope_id, rk, type || ':' || {py_strip('content')} AS line FROM hits),
lr AS (SELECT *, SUM(length(line)) OVER (PARTITION BY scope_id ORDER BY rk
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM ll),
ltm AS (SELECT scope_id, string_agg(line, chr(10) ORDER BY rk) AS ltm_text, count(*) AS n_ltm
        FROM lr WHERE used <= 16384 GROUP BY scope_id),
wsc AS (SELECT scope_id, seq, importance * power(0.5, greatest(0.0, {AS_OF} - ts) / 900.0) AS score,
               '- [''' || role || '''] ' || {py_strip('content')} AS line FROM wm),
wr AS (SELECT *, SUM(length(line)) OVER (PARTITION BY scope_id ORDER BY score DESC, seq
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM wsc),
wmt AS (SELECT scope_id, string_agg(line, chr(10) ORDER BY score DESC, seq) AS wm_text, count(*) AS n_wm
        FROM wr WHERE used <= 9830 GROUP BY scope_id),
p AS (
  SELECT b.scope_id,
         {sql_lit('Self: ' + DEFAULT_SELF_SUMMARY + chr(10) + 'WM:' + chr(10))} || coalesce(wm_text, '') || chr(10) ||
         'LTM:' || chr(10) || coalesce(ltm_text, '') || chr(10) || 'Stimuli:' || chr(10) || stim_text || chr(10) ||
         {sql_lit(PROMPT_TAIL)} AS prompt,
         n_stim, coalesce(n_wm, 0) AS n_wm, coalesce(n_ltm, 0) AS n_ltm
  FROM base b LEFT JOIN ltm USING (scope_id) LEFT JOIN wmt USING (scope_id))
"""


_CTX_SQL = ctx_sql()


@query("context_build", oracle=_CTX_SQL + """
SELECT scope_id, CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(prompt) AS prompt_md5,
       CAST(n_stim AS BIGINT) AS n_stim_lines, CAST(n_wm AS BIGINT) AS n_wm_lines, CAST(n_ltm AS BIGINT) AS n_ltm_lines
FROM p
""")
def context_build(spark, sf):
    scopes, stimuli, wm, mem = _inputs(spark, sf)
    ctx = build_context(scopes, stimuli, wm, mem, AS_OF)
    return ctx.select("scope_id", F.length("prompt").cast("long").alias("prompt_chars"),
                      F.md5("prompt").alias("prompt_md5"), "n_stim_lines", "n_wm_lines", "n_ltm_lines")


@query("context_store", oracle=_CTX_SQL + """
SELECT scope_id, CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(prompt) AS prompt_md5,
       CAST(n_stim AS BIGINT) AS n_stim_lines, CAST(n_wm AS BIGINT) AS n_wm_lines, CAST(n_ltm AS BIGINT) AS n_ltm_lines
FROM p
""")
def context_store(spark, sf):
    """The same over a store bucketed by scope that came to be by refreshes: half of the memories, then the others as log rows."""
    scopes, stimuli, wm, mem = _inputs(spark, sf)
    store = MemoryStore.create(mem.where("seq % 2 = 0"), f"memories_{uuid.uuid4().hex[:12]}", 16)
    store.refresh(mem.where("seq % 2 = 1").withColumn("op", F.lit("upsert")))
    ctx = build_context(scopes, stimuli, wm, store.read(), AS_OF)
    return ctx.select("scope_id", F.length("prompt").cast("long").alias("prompt_chars"),
                      F.md5("prompt").alias("prompt_md5"), "n_stim_lines", "n_wm_lines", "n_ltm_lines")


def cycle_sql(seq: str = "1000", stimuli: bool = True) -> str:
    """CTEs up to ``rep``: the report of one cycle of every scope."""
    return ctx_sql(stimuli) + f""",
{thought_ctes('p')},
dec AS (SELECT *, {seed900_sql(sql_lit(DECIDER_SYSTEM + '|' + DECIDER_PROMPT) + ' || thought')} AS m2 FROM tg_t),
rep AS (SELECT scope_id,
       'thought:' || substr(sha256(concat_ws(chr(1), scope_id, CAST({seq} AS VARCHAR))), 1, 16) AS thought_id,
       thought,
       (m2 % 100) / 100.0 > 0.55 AS stored,
       CAST(CASE WHEN starts_with(thought, '#question')
                  AND length({py_strip('substr(thought, 10)')}) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_interrupts,
       CAST({seq} AS BIGINT) AS cycle_seq
FROM dec)
"""


@query("cycle_report", oracle=cycle_sql() + f""",
{tasks_cte(TASK_AS_OF).replace('o_custkey AS VARCHAR', 'o_custkey % ' + N_CONV_SQL + ' AS VARCHAR')},
best AS (SELECT scope_id, arg_max(id, struct_pack(s := score, q := -seq)) AS next_task FROM scored GROUP BY scope_id)
SELECT rep.*, next_task FROM rep LEFT JOIN best USING (scope_id)
""")
def cycle_report(spark, sf):
    """One cycle of every conversation, with the best task of its scope (orders, dealt to the conversations) as the next one."""
    scopes, stimuli, wm, mem = _inputs(spark, sf)
    n = fx.n_conversations(spark, sf)
    tasks = fx.tasks(spark, sf).withColumn("scope_id", (F.col("scope_id").cast("long") % n).cast("string"))
    tasks = tasks.withColumn("scored_at", F.lit(TASK_AS_OF))     # scores are frozen when a version is added
    res = run_cycle(scopes, stimuli, wm, mem, AS_OF, cycle_seq=1000, tasks=tasks)
    return res.report.select("scope_id", "thought_id", "thought", "stored",
                             F.size("interrupt_ids").cast("long").alias("n_interrupts"), "cycle_seq", "next_task")


@query("ingest_job", oracle=f"""
WITH s AS (
  SELECT CAST(conv_id AS VARCHAR) AS scope_id, turn AS seq, 'chat' AS source, {redact_sql('text')} AS content
  FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT scope_id, seq, 'stim:' || substr(sha256(concat_ws(chr(1), scope_id, CAST(seq AS VARCHAR), source, content)), 1, 16) AS id,
       'episodic' AS type, 0.3::DOUBLE AS importance, md5(content) AS content_md5
FROM s
""")
def ingest_job(spark, sf):
    rows, _, _, _ = ingest_job_plan(fx.stimuli_chat(spark, sf), AS_OF)
    return rows.select("scope_id", "seq", "id", "type", "importance", F.md5("content").alias("content_md5"))


@query("ingest_view", oracle=f"""
WITH {thoughts_cte()}, {wm_cte()},
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY seq DESC) AS rn FROM wm
      WHERE scope_id IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations WHERE role = 'user' AND text IS NOT NULL))
SELECT scope_id, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY seq) AS BIGINT) AS pos, id FROM r WHERE rn <= 5
""")
def ingest_view(spark, sf):
    """The working-memory view an ingest answers with: the last five items of each scope that got stimuli."""
    _, _, _, view = ingest_job_plan(fx.stimuli_chat(spark, sf), AS_OF, wm=W.working_memory(fx.thoughts(spark, sf), 4000))
    return view.select("scope_id", "pos", "id")


_ACCEPTED_SQL = """
WITH q AS (SELECT event_id AS seq, 'q:' || event_id AS id FROM events WHERE event_type = 'signup'),
a AS (SELECT event_id AS seq, 'q:' || (event_id - event_id % 3) AS qid, props AS answer_text
      FROM events WHERE event_type = 'purchase'),
acc AS (SELECT a.seq, q.id AS qid, a.answer_text AS content FROM q JOIN a ON a.qid = q.id AND a.seq > q.seq)
"""


@query("answer_job", oracle=_ACCEPTED_SQL + """
SELECT 'mem:' || substr(sha256(concat_ws(chr(1), 'global', CAST(seq AS VARCHAR), qid)), 1, 16) AS id,
       qid, seq, content, 0.4::DOUBLE AS importance,
       '{"source":"interrupt","qid":"' || qid || '"}' AS metadata_json
FROM acc
""")
def answer_job(spark, sf):
    mem, _stim = answer_memories(I.accepted_answers(fx.interrupt_log(spark, sf), fx.answers(spark, sf)))
    return mem.select("id", F.get_json_object("metadata_json", "$.qid").alias("qid"), "seq", "content",
                      "importance", "metadata_json")


@query("answer_cycle", oracle=_ACCEPTED_SQL + f""",
sl AS (SELECT seq, 'user: ' || {py_strip('content')} AS line FROM acc),
sr AS (SELECT *, SUM(length(line)) OVER (ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM sl),
st AS (SELECT 'global' AS scope_id, string_agg(line, chr(10) ORDER BY seq) AS stim_text FROM sr WHERE used <= 6553),
mem AS (SELECT 'global' AS scope_id, seq, content FROM acc),
bq AS (SELECT scope_id, stim_text AS qtext FROM st),
{hash_vec_ctes('qv', 'bq', 'scope_id', 'qtext')},
{hash_vec_ctes('mv', 'mem', 'scope_id, seq, content', 'content')},
hits AS (SELECT *, row_number() OVER (ORDER BY cos DESC, seq) AS rk FROM (
  SELECT mv.seq, mv.content, {cosine_sql('qv.embedding', 'mv.embedding')} AS cos FROM mv JOIN qv USING (scope_id)) QUALIFY rk <= 8),
p AS (SELECT 'global' AS scope_id,
  {sql_lit('Self: ' + DEFAULT_SELF_SUMMARY + chr(10) + 'WM:' + chr(10))} || chr(10) || 'LTM:' || chr(10) ||
  (SELECT string_agg('episodic:' || {py_strip('content')}, chr(10) ORDER BY rk) FROM hits) || chr(10) || 'Stimuli:' || chr(10) ||
  (SELECT stim_text FROM st) || chr(10) || {sql_lit(PROMPT_TAIL)} AS prompt),
{thought_ctes('p')}
SELECT scope_id, 'thought:' || substr(sha256(concat_ws(chr(1), scope_id, '5000000')), 1, 16) AS thought_id, thought FROM tg_t
""")
def answer_cycle(spark, sf):
    """The cycle that runs on the accepted answers: they are its stimuli and already in its store."""
    wm = W.working_memory(fx.thoughts(spark, sf), 4000)
    store = fx.memories(spark, sf, null_embedding_every=0).limit(0)
    _, _, res = answer_job_plan(fx.interrupt_log(spark, sf), fx.answers(spark, sf), wm, store, AS_OF, 5_000_000)
    return res.report.select("scope_id", "thought_id", "thought")


@query("counters", oracle="""
SELECT (SELECT count(*) FROM conversations WHERE role = 'user') + (SELECT count(*) FROM events) AS stimuli_ingested,
       (SELECT count(*) FROM conversations) AS cycles_run
""")
def counters(spark, sf):
    stim = fx.stimuli_chat(spark, sf).select("scope_id", "seq").unionByName(
        fx.stimuli_events(spark, sf).select("scope_id", "seq"))
    return service_counters(stim, fx.thoughts(spark, sf))
