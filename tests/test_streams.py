"""Keyed state of the streams (I3, I4), scheduled ticks (I2), counters (D4), whatever the batches and restarts."""
import random

import pytest
from pyspark.sql import functions as F

from sparkmem.operators import interrupts as I
from sparkmem.operators import working as W
from sparkmem.session import scratch_path
from sparkmem.sources import fixtures as fx
from sparkmem.streaming import jobs as J
from sparkmem.streaming import state as S
from tests.conftest import SF0001

Q = "scope_id string, id string, seq long, created_ts double"
A = "scope_id string, qid string, seq long, answer_text string, answer_ts double"


def append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def read(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def folders(spark):
    return [scratch_path(spark, n) for n in ("q", "a", "sink", "ckpt")]


def test_question_that_comes_three_batches_after_its_answers(spark):
    q, a, sink, ckpt = folders(spark)
    append(spark, [("s", "q9", 1, 0.0)], Q, q)
    append(spark, [("s", "q1", 5, "early", 50.0), ("s", "q1", 2, "too old", 20.0), ("s", "none", 7, "to nobody", 70.0)], A, a)
    J.answer_stream(read(spark, Q, q), read(spark, A, a), sink, ckpt)
    for k in range(2):
        append(spark, [("s", f"other{k}", 10 + k, 0.0)], Q, q)
        append(spark, [("s", f"other{k}", 20 + k, f"o{k}", 0.0)], A, a)
        J.answer_stream(read(spark, Q, q), read(spark, A, a), sink, ckpt)
    assert spark.read.parquet(sink).where("qid = 'q1'").count() == 0
    append(spark, [("s", "q1", 3, 30.0)], Q, q)
    J.answer_stream(read(spark, Q, q), read(spark, A, a), sink, ckpt)
    append(spark, [("s", "q1", 9, "late", 90.0), ("t", "q1", 9, "wrong scope", 90.0)], A, a)       # the question stays open
    J.answer_stream(read(spark, Q, q), read(spark, A, a), sink, ckpt)
    got = {(r.qid, r.answer_text): r.accepted for r in spark.read.parquet(sink).collect()}
    assert got == {("q1", "early"): True, ("q1", "too old"): False, ("other0", "o0"): True, ("other1", "o1"): True, ("q1", "late"): True}
    mem, stim, rejected = J.decisions(spark, sink)
    assert mem.count() == stim.count() == 4 and [r.answer_text for r in rejected.collect()] == ["too old"]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_batches_gives_what_the_batch_join_gives(spark, seed):
    rnd = random.Random(seed)
    questions = [("s" if i % 2 else "t", f"q{i}", rnd.randrange(100), float(i)) for i in range(12)]
    answers = [(rnd.choice("st"), "q1" if i < 30 else f"q{rnd.randrange(14)}", rnd.randrange(100), f"text {i}" if i % 7 else None, float(i)) for i in range(80)]
    rnd.shuffle(questions), rnd.shuffle(answers)
    q, a, sink, ckpt = folders(spark)
    for k in range(3):                                          # three runs, each resumes from the checkpoint
        for part in range(2):
            append(spark, questions[(2 * k + part) * 2:(2 * k + part + 1) * 2], Q, q)
            append(spark, answers[(2 * k + part) * 13:(2 * k + part + 1) * 13 if k * part < 2 else None], A, a)
        J.answer_stream(read(spark, Q, q), read(spark, A, a), sink, ckpt)
    qs, ans = spark.createDataFrame(questions, Q), spark.createDataFrame(answers, A)
    want = I.accepted_answers(qs, ans).select("scope_id", "id", "answer_seq", "answer_text")
    got = J._accepted(spark.read.parquet(sink)).select("scope_id", "id", "answer_seq", "answer_text")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    both = {(s, i) for s, i, _, _ in questions}
    _, _, rejected = J.decisions(spark, sink)
    # an answer to a question that never came waits on; all others are decided
    assert got.count() + rejected.count() == sum((s, i) in both for s, i, *_ in answers)


# --------------------------------------------------------------------------
TH = "scope_id string, id string, content string, tags array<string>, importance double, uncertainty double, ts double, seq long"


def thought(scope, seq, n, tag="t"):
    return (scope, f"{scope}{seq}", None if n is None else "x" * n, [tag, "ü\""], 0.5, 0.1, float(seq), seq)


def test_only_scopes_with_new_rows_are_written(spark):
    src, state, ckpt = (scratch_path(spark, n) for n in ("wm-src", "wm-state", "wm-ckpt"))
    append(spark, [thought(s, i, 30) for s in ("a", "b", "c") for i in range(6)], TH, src)
    J.wm_stream(read(spark, TH, src), state, ckpt, 100)
    append(spark, [thought("b", 9, 50)], TH, src)
    last = J.wm_stream(read(spark, TH, src), state, ckpt, 100)
    assert {r.scope_id for r in spark.read.parquet(f"{state}/version={last}").collect()} == {"b"}
    got = {(r.scope_id, r.seq) for r in J.latest_state(spark, state, last).collect()}
    assert got == {(s, i) for s in "ac" for i in (3, 4, 5)} | {("b", 9), ("b", 5)}
    row = J.latest_state(spark, state, last).where("scope_id = 'b' and seq = 9").first()
    assert (row.content, row.tags, row.importance, row.id) == ("x" * 50, ["t", "ü\""], 0.5, "b9")


def test_any_order_of_arrival_and_odd_rows(spark):
    rnd = random.Random(5)
    rows = [thought(rnd.choice("ab"), i, rnd.choice([None, 0, 5, 40, 90, 200])) for i in range(120)] + [thought(None, 1, 10)]
    rnd.shuffle(rows)
    src, state, ckpt = (scratch_path(spark, n) for n in ("wm-src", "wm-state", "wm-ckpt"))
    for lo in range(0, len(rows), 31):
        append(spark, rows[lo:lo + 31], TH, src)
        last = J.wm_stream(read(spark, TH, src), state, ckpt, 300)
    got = {(r.scope_id, r.seq) for r in J.latest_state(spark, state, last).where("scope_id is not null").collect()}
    want = {(r.scope_id, r.seq) for r in W.working_memory(spark.createDataFrame(rows, TH), 300).where("scope_id is not null").collect()}
    assert got == want


def test_state_is_bounded_by_the_budget():
    rows = S.newest_within([(i, "", 10) for i in range(1000)], 100)
    assert [r[0] for r in rows] == list(range(999, 988, -1))


# --------------------------------------------------------------------------
def test_three_ticks_one_of_them_idle_with_restart(spark):
    scopes = fx.table(spark, SF0001, "conversations", "conv_id").select(F.col("conv_id").cast("string").alias("scope_id")).distinct()
    n = scopes.count()
    wm0 = W.working_memory(fx.thoughts(spark, SF0001), 4000).drop("wm_len", "wm_running")
    mem = fx.memories(spark, SF0001, null_embedding_every=0)
    ticks, stim, out, ckpt = (scratch_path(spark, x) for x in ("ticks", "stim", "out", "ckpt"))
    schema = "scope_id string, seq long, id string, source string, content string, ts double, qid string"
    append(spark, [("0", 1, "i", "chat", "hello there", 0.0, None)], schema, stim)

    def run():
        return J.scheduled_cycles(read(spark, "as_of double", ticks), read(spark, schema, stim), scopes, mem, out, ckpt, wm0, compact_every=2)

    append(spark, [(fx.T0 + 100.0,)], "as_of double", ticks)
    run()
    append(spark, [(fx.T0 + 200.0,)], "as_of double", ticks)      # nothing came: every scope's idle cycle
    run()
    # an accepted answer and a scope that was never seen, waiting through a batch without a tick
    append(spark, [("0", 5, "ans", "user", "the answer", 3.0, "q:1"), ("new", 6, "i2", "chat", "hi", 4.0, None)], schema, stim)
    run()
    append(spark, [(fx.T0 + 300.0,)], "as_of double", ticks)
    last = run()
    rep = spark.read.parquet(f"{out}/report")
    assert {r.batch_id: r["count"] for r in rep.groupBy("batch_id").count().collect()} == {0: n, 1: n, 2: n + 1}
    assert rep.select("thought_id").distinct().count() == 3 * n + 1
    state = J.last_manifest(spark, out, last)
    assert state["tick"] == 2 and state["waiting"] == [] and len(state["memories"]) <= 2
    rows = spark.read.schema(mem.schema).parquet(*state["memories"])
    assert rows.where("content = 'the answer'").select("importance", "type").collect() == [(0.4, "episodic")]
    stamps = {r.created_at for r in rows.where("content <> 'the answer'").select("created_at").distinct().collect()}
    assert stamps <= {fx.T0 + 100.0, fx.T0 + 200.0, fx.T0 + 300.0}         # each tick's own time
    total = {r.name: r.n for r in J.live_counters(spark, out).collect()}
    assert total == {"cycles_run": 3 * n + 1}


def test_accepted_answers_feed_the_next_tick(spark):
    q, a, sink, ckpt = folders(spark)
    ticks, out, ckpt2 = (scratch_path(spark, x) for x in ("ticks", "out", "ckpt"))
    append(spark, [("0", "q1", 1, 0.0)], Q, q)
    append(spark, [("0", "q1", 2, "forty-two", 20.0), ("0", "q1", 0, "no", 20.0)], A, a)
    J.answer_stream(read(spark, Q, q), read(spark, A, a), sink, ckpt)
    append(spark, [(fx.T0,)], "as_of double", ticks)
    scopes = spark.createDataFrame([("0",)], "scope_id string")
    wm0 = W.working_memory(fx.thoughts(spark, SF0001), 4000).drop("wm_len", "wm_running")
    mem = fx.memories(spark, SF0001, null_embedding_every=0)
    last = J.scheduled_cycles(read(spark, "as_of double", ticks), J.accepted_stimuli(spark, sink), scopes, mem, out, ckpt2, wm0)
    state = J.last_manifest(spark, out, last)
    assert state["tick"] == 0
    rows = spark.read.schema(mem.schema).parquet(*state["memories"]).where("importance = 0.4").collect()
    assert [r.content for r in rows] == ["forty-two"]


def test_counters_without_a_scan(spark):
    sink, ckpt, src = (scratch_path(spark, x) for x in ("sink", "ckpt", "src"))
    schema = "scope_id string, seq long, id string, source string, content string, ts double"
    rows = [("s", i, f"i{i}", "chat", "text" if i % 5 else None, 0.0) for i in range(40)]
    for part in (rows[:25], rows[25:]):
        append(spark, part, schema, src)
        J.ingest_stream(read(spark, schema, src), sink, ckpt, 0.0)
    got = {r.name: r.n for r in J.live_counters(spark, sink).collect()}
    assert got == {"stimuli_ingested": spark.read.parquet(f"{sink}/memories").count(), "stimuli_rejected": 8}
    assert got["stimuli_ingested"] == 32


def test_questions_share_parts_of_the_state(spark):
    """a key of the state is a part of the questions; one per question (and lane) called Python for each."""
    q, a, sink, ckpt = folders(spark)
    asked = [("s" if i % 3 else None, f"q{i}", i, 0.0) for i in range(1500)] + [("s", "q1", 90, 0.0), ("s", "q4", None, 0.0), ("s", None, 5, 0.0)]
    told = [("s" if i % 3 else None, f"q{i}", i + i % 2, f"t{i}", float(i)) for i in range(1400)]
    told += [("s", "q1", 2, "again", None), ("s", "q1", None, "no number", 1.0), ("s", None, 6, "to null", 1.0), ("s", "none", 6, "waits", 1.0)]
    append(spark, asked, Q, q)
    append(spark, told, A, a)
    query = (S.decide_answers(read(spark, Q, q), read(spark, A, a)).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= S.PARTS
    first = {}
    for scope, key, seq, _ in asked:
        if seq is not None:
            first[scope, key] = min(seq, first.get((scope, key), seq))
    want = [(str(s), str(k), seq, t, ts, seq is not None and seq > first[s, k]) for s, k, seq, t, ts in told if (s, k) in first]
    got = [(str(r.scope_id), str(r.qid), r.seq, r.answer_text, r.answer_ts, r.accepted) for r in spark.read.parquet(sink).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_batch_is_not_one_file(spark):
    """what stages a stream writes as many files a batch as there are cores, whatever the keys."""
    path = scratch_path(spark, "staged")
    per = J.stage(spark.range(400), path, 4, "id")
    files = len(spark.read.parquet(path).inputFiles())
    assert per == spark.sparkContext.defaultParallelism and files > 4 * per - 4
