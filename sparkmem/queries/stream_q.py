"""Streaming queries (I1-I5): each stages a file stream derived from the
tables under the session's checkpoint folder, drains it with availableNow and
reads the sink back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import working as W
from ..registry import query
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import io as IO
from ..sql_text import T0, redact_sql, thoughts_cte
from ..streaming import jobs as J
from .cycle_q import cycle_sql

AS_OF = T0 + 3600.0


STAGED_BATCHES = 4


def _stream(spark, df, key, name):
    src = scratch_path(spark, f"{name}-src")
    per = J.stage(df, src, STAGED_BATCHES, key)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per).parquet(src)


@query("stream_ingest", oracle=f"""
WITH e AS (SELECT *, {redact_sql('props')} AS content FROM events WHERE props IS NOT NULL)
SELECT 'stim:' || substr(sha256(concat_ws(chr(1), CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR),
                                          event_type, content)), 1, 16) AS id,
       CAST(user_id AS VARCHAR) AS scope_id, event_id AS seq, 0.3::DOUBLE AS importance
FROM e
""")
def stream_ingest(spark, sf):
    stim = fx.stimuli_events(spark, sf)
    stream = _stream(spark, stim, "seq", "ingest")
    sink = scratch_path(spark, "ingest-sink")
    J.ingest_stream(stream, sink, scratch_path(spark, "ingest-ckpt"), AS_OF)
    return spark.read.parquet(f"{sink}/memories").select("id", "scope_id", "seq", "importance")


@query("stream_wm", oracle=f"""
WITH {thoughts_cte()}
SELECT scope_id, seq, CAST(length(content) AS BIGINT) AS wm_len
FROM thoughts t
WHERE (SELECT SUM(length(u.content)) FROM thoughts u WHERE u.scope_id = t.scope_id AND u.seq >= t.seq) <= 4000
""")
def stream_wm(spark, sf):
    th = fx.thoughts(spark, sf)
    stream = _stream(spark, th, "seq", "wm")
    state = scratch_path(spark, "wm-state")
    last = J.wm_stream(stream, state, scratch_path(spark, "wm-ckpt"), 4000)
    wm = J.latest_state(spark, state, last)
    return wm.select("scope_id", "seq", F.length("content").cast("long").alias("wm_len"))


@query("stream_ingest_documents", oracle=f"""
SELECT md5({redact_sql('text')}) AS content_md5, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1
""")
def stream_ingest_documents(spark, sf):
    """The file reader as a stream: records of {{source, content}}, numbered, redacted and stored per micro-batch."""
    src, sink = scratch_path(spark, "docs-src"), scratch_path(spark, "docs-sink")
    d = fx.table(spark, sf, "documents", "source", F.col("text").alias("content"))
    per = J.stage(d, src, STAGED_BATCHES, fmt="json")
    stream = IO.read_stimuli(spark, src, AS_OF, streaming=True, max_files_per_trigger=2 * per)
    J.ingest_stream(stream, sink, scratch_path(spark, "docs-ckpt"), AS_OF)
    rows = spark.read.parquet(f"{sink}/memories")
    distinct = rows.select("seq").distinct()                # no two rows share a number
    return rows.join(distinct, "seq").groupBy(F.md5("content").alias("content_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_cycle", oracle=cycle_sql(
    seq="greatest((SELECT max(turn) FROM conversations), (SELECT max(doc_id) FROM documents)) + 1") + """
SELECT scope_id, CAST(0 AS BIGINT) AS batch_id, thought_id, stored, CAST(n_interrupts AS INTEGER) AS n_interrupts FROM rep
WHERE scope_id IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations WHERE role = 'user')
""")
def stream_cycle(spark, sf):
    stim = fx.stimuli_chat(spark, sf)
    src = scratch_path(spark, "cycle-src")
    J.stage(stim, src, STAGED_BATCHES)
    stream = spark.readStream.schema(stim.schema).parquet(src)     # one micro-batch drains all that is pending
    out = scratch_path(spark, "cycle-out")
    wm0 = W.working_memory(fx.thoughts(spark, sf), 4000).drop("wm_len", "wm_running")
    J.cycle_stream(stream, fx.memories(spark, sf, null_embedding_every=0), out, scratch_path(spark, "cycle-ckpt"), AS_OF, wm0)
    rep = spark.read.parquet(f"{out}/report")
    return rep.select("scope_id", "batch_id", "thought_id", "stored", F.size("interrupt_ids").alias("n_interrupts"))


@query("idle_cycle", oracle=cycle_sql(
    seq="greatest((SELECT max(turn) FROM conversations), (SELECT max(doc_id) FROM documents)) + 1", stimuli=False) + """
SELECT scope_id, thought_id, thought, stored FROM rep
""")
def idle_cycle(spark, sf):
    """A tick without stimuli: every scope runs its cycle on the query text for an empty input."""
    scopes = fx.table(spark, sf, "conversations", "conv_id").select(F.col("conv_id").cast("string").alias("scope_id"))
    wm0 = W.working_memory(fx.thoughts(spark, sf), 4000).drop("wm_len", "wm_running")
    res = J.run_idle_cycle(scopes, fx.memories(spark, sf, null_embedding_every=0), scratch_path(spark, "idle"), 0, AS_OF, wm0)
    return res.report.select("scope_id", "thought_id", "thought", "stored")


@query("stream_answers", oracle="""
WITH q AS (SELECT event_id AS seq, 'q:' || event_id AS id FROM events WHERE event_type = 'signup'),
a AS (SELECT event_id AS seq, 'q:' || (event_id - event_id % 3) AS qid, props AS answer_text
      FROM events WHERE event_type = 'purchase')
SELECT 'mem:' || substr(sha256(concat_ws(chr(1), 'global', CAST(a.seq AS VARCHAR), q.id)), 1, 16) AS id,
       a.seq AS seq, a.answer_text AS content, 0.4::DOUBLE AS importance
FROM q JOIN a ON a.qid = q.id AND a.seq > q.seq
""")
def stream_answers(spark, sf):
    """Questions and answers as two streams; each micro-batch takes some files of either, whichever way questions and answers fall into them."""
    sink = scratch_path(spark, "answers-out")
    J.answer_stream(_stream(spark, fx.interrupt_log(spark, sf), "id", "questions"), _stream(spark, fx.answers(spark, sf), "seq", "answers"),
                    sink, scratch_path(spark, "answers-ckpt"))
    rows, _, _ = J.decisions(spark, sink)
    return rows.select("id", "seq", "content", "importance")


@query("stream_late_questions", oracle="""
WITH q AS (SELECT event_id AS seq, 'q:' || event_id AS id FROM events WHERE event_type = 'signup'),
a AS (SELECT event_id AS seq, 'q:' || (event_id - event_id % 3) AS qid, props AS answer_text
      FROM events WHERE event_type = 'purchase')
SELECT a.seq, a.qid, a.answer_text, a.seq > q.seq AS accepted FROM q JOIN a ON a.qid = q.id
""")
def stream_late_questions(spark, sf):
    """Every answer arrives before any question: answers wait in the state store until theirs comes, in a later run of the same query."""
    sink, ckpt = scratch_path(spark, "late-out"), scratch_path(spark, "late-ckpt")
    answers, questions = fx.answers(spark, sf), fx.interrupt_log(spark, sf)
    a, q = scratch_path(spark, "late-a"), scratch_path(spark, "late-q")
    per = J.stage(answers, a, STAGED_BATCHES, "seq")
    questions.limit(0).write.parquet(q)
    for arrived in (False, True):
        if arrived:
            J.stage(questions, q, STAGED_BATCHES, "id", mode="append")
        J.answer_stream(spark.readStream.schema(questions.schema).option("maxFilesPerTrigger", 2 * per).parquet(q),
                        spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 2 * per).parquet(a), sink, ckpt)
    return spark.read.parquet(sink).select("seq", "qid", "answer_text", "accepted")


@query("stream_idle_tick", oracle=cycle_sql(
    seq="greatest((SELECT max(turn) FROM conversations), (SELECT max(doc_id) FROM documents)) + 1") + """
SELECT scope_id, thought_id, thought, stored FROM rep
""")
def stream_idle_tick(spark, sf):
    """A scheduled tick: scopes with pending stimuli and scopes without run their cycle in one micro-batch."""
    stim = fx.stimuli_chat(spark, sf)
    src, ticks, out = scratch_path(spark, "tick-stim"), scratch_path(spark, "ticks"), scratch_path(spark, "tick-out")
    J.stage(stim, src, STAGED_BATCHES)
    conv = fx.table(spark, sf, "conversations", "conv_id", "turn")
    conv.agg(F.lit(AS_OF).alias("as_of")).coalesce(1).write.parquet(ticks)
    scopes = conv.select(F.col("conv_id").cast("string").alias("scope_id")).distinct()
    wm0 = W.working_memory(fx.thoughts(spark, sf), 4000).drop("wm_len", "wm_running")
    J.scheduled_cycles(spark.readStream.schema("as_of double").parquet(ticks), spark.readStream.schema(stim.schema).parquet(src), scopes,
                       fx.memories(spark, sf, null_embedding_every=0), out, scratch_path(spark, "tick-ckpt"), wm0)
    return spark.read.parquet(f"{out}/report").select("scope_id", "thought_id", "thought", "stored")


@query("run_cycles", oracle="""
WITH s AS (SELECT greatest((SELECT max(turn) FROM conversations), (SELECT max(doc_id) FROM documents)) + 1 AS seq)
SELECT DISTINCT CAST(conv_id AS VARCHAR) AS scope_id, seq + n AS cycle_seq,
       'thought:' || substr(sha256(concat_ws(chr(1), CAST(conv_id AS VARCHAR), CAST(seq + n AS VARCHAR))), 1, 16) AS thought_id
FROM conversations, s, range(3) r(n)
""")
def run_cycles(spark, sf):
    """Three cycles on demand, each on the state that the one before left."""
    scopes = fx.table(spark, sf, "conversations", "conv_id").select(F.col("conv_id").cast("string").alias("scope_id"))
    wm0 = W.working_memory(fx.thoughts(spark, sf), 4000).drop("wm_len", "wm_running")
    out = scratch_path(spark, "cycles")
    J.run_cycles(3, scopes, fx.stimuli_chat(spark, sf), fx.memories(spark, sf, null_embedding_every=0), out, AS_OF, wm0)
    return spark.read.parquet(f"{out}/report").select("scope_id", "cycle_seq", "thought_id")


@query("live_counters", oracle="""
SELECT 'stimuli_ingested' AS name, count(*) AS n FROM events WHERE props IS NOT NULL
UNION ALL SELECT 'stimuli_rejected', count(*) FROM events WHERE props IS NULL
""")
def live_counters(spark, sf):
    """Totals of a stream of several batches, from what was observed while they were written."""
    sink = scratch_path(spark, "live-sink")
    J.ingest_stream(_stream(spark, fx.stimuli_events(spark, sf), "seq", "live"), sink, scratch_path(spark, "live-ckpt"), AS_OF)
    return J.live_counters(spark, sink)
