import __spark_entry__ as E
from sparkmem.plans.cycle import run_cycle
from sparkmem.operators import working as W
from sparkmem.sources import fixtures as fx
from sparkmem.streaming import jobs as J
from sparkmem.session import scratch_path
from pyspark.sql import functions as F
from tests.conftest import SF0001


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 50


def test_every_query_runs_on_smallest(spark):
    qs = E.queries()
    for name in ["wm_budget", "keyword_topk", "task_top", "page_gate", "centroids", "counters", "memory_upsert"]:
        assert qs[name](spark, SF0001).columns


def test_cycle_writes_one_thought_per_scope(spark):
    scopes = fx.table(spark, SF0001, "conversations", "conv_id").select(F.col("conv_id").cast("string").alias("scope_id"))
    wm = W.working_memory(fx.thoughts(spark, SF0001), 4000)
    res = run_cycle(scopes, fx.stimuli_chat(spark, SF0001), wm, fx.memories(spark, SF0001, null_embedding_every=0),
                    fx.T0 + 3600, 100)
    n_scopes = scopes.distinct().count()
    assert res.report.count() == n_scopes
    # the new thought is the newest item of each scope's working memory
    newest = res.wm.groupBy("scope_id").agg(F.max("seq").alias("m")).where(F.col("m") == 100).count()
    assert newest == n_scopes


def test_wm_stream_restart_is_exact(spark):
    th = fx.thoughts(spark, SF0001)
    src = scratch_path(spark, "src")
    # the newest half arrives first: the state is exact in any order of arrival
    th.where(F.col("seq") >= 4).repartition(3).write.parquet(src)
    state, ckpt = scratch_path(spark, "state"), scratch_path(spark, "ckpt")

    def stream():
        return spark.readStream.schema(th.schema).option("maxFilesPerTrigger", 1).parquet(src)

    J.wm_stream(stream(), state, ckpt, 300)
    # more data arrives; the query resumes from its checkpoint
    th.where(F.col("seq") < 4).repartition(4).write.mode("append").parquet(src)
    last = J.wm_stream(stream(), state, ckpt, 300)
    got = {(r.scope_id, r.seq) for r in J.latest_state(spark, state, last).collect()}
    exp = {(r.scope_id, r.seq) for r in W.working_memory(th, 300).collect()}
    assert got == exp


def test_stream_without_state_fails(spark):
    import pytest
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        J._tick(spark, scratch_path(spark, "nothing"), 3, None, None, None, None, 0.0, {})


def test_plans_keep_per_scope_work_bounded(spark):
    """E1, F4, F1-batch and C3 plans: row_number filters become WindowGroupLimit
    (partial before the shuffle), and no plan needs a cartesian product."""
    qs = E.queries()
    from tests.conftest import SF001
    for name in ["wm_budget", "task_top", "keyword_topk_batch", "knn_join", "vector_topk"]:
        plan = qs[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name
        if name in ("task_top", "knn_join"):
            assert plan.count("WindowGroupLimit") >= 2, name
        if name == "wm_budget":         # one shuffle by scope for the running sum, after the cut of the input batches
            below = plan[plan.index("hashpartitioning(scope_id"):]
            assert "MapInArrow" in below and plan.index("Window") < plan.index("MapInArrow"), name


def test_two_cycles_chain(spark):
    scopes = fx.table(spark, SF0001, "conversations", "conv_id").select(F.col("conv_id").cast("string").alias("scope_id"))
    wm0 = W.working_memory(fx.thoughts(spark, SF0001), 4000).drop("wm_len", "wm_running")
    mem = fx.memories(spark, SF0001, null_embedding_every=0)
    stim = fx.stimuli_chat(spark, SF0001)
    r1 = run_cycle(scopes, stim, wm0, mem, fx.T0 + 3600, 100)
    r2 = run_cycle(scopes, stim.limit(0), r1.wm, mem, fx.T0 + 3660, 101)  # an idle tick: no stimuli
    top2 = (r2.wm.where(F.col("seq") >= 100).groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == 2).count())
    assert top2 == scopes.distinct().count()
    assert r2.context.where(F.col("query_text") != "general").count() == 0


def test_run_cycles_on_demand(spark):
    scopes = fx.table(spark, SF0001, "conversations", "conv_id").select(F.col("conv_id").cast("string").alias("scope_id")).distinct()
    wm0 = W.working_memory(fx.thoughts(spark, SF0001), 4000).drop("wm_len", "wm_running")
    mem = fx.memories(spark, SF0001, null_embedding_every=0)
    out = scratch_path(spark, "cycles")
    J.run_cycles(2, scopes, fx.stimuli_chat(spark, SF0001), mem, out, fx.T0 + 3600, wm0)
    n = scopes.count()
    rep = spark.read.parquet(f"{out}/report")
    assert rep.count() == 2 * n and rep.select("cycle_seq").distinct().count() == 2
    top = max(r.m for r in wm0.agg(F.max("seq").alias("m")).collect() + mem.agg(F.max("seq").alias("m")).collect())
    assert rep.agg(F.min("cycle_seq")).first()[0] == top + 1
    stored = rep.where("stored").count()
    snap = J.compact_memories(mem, out, 2, scratch_path(spark, "snap"))
    assert snap.count() == mem.count() + stored


def test_hot_scope_keeps_the_budget(spark):
    """One scope with all rows over many partitions: same answer, two levels of row limits."""
    df = spark.range(0, 3000, 1, 40).selectExpr("'s' AS scope_id", "id AS seq", "repeat('x', cast(id % 4 as int)) AS content")
    got = sorted(r.seq for r in W.working_memory(df, 50).collect())
    total, want = 0, []
    for i in range(2999, -1, -1):
        total += i % 4
        if total > 50:
            break
        want.append(i)
    assert got == sorted(want)
