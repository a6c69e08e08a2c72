"""The bucketed store: refreshes equal the fold of the whole log, touch only their buckets, and are read by scope without an exchange."""
import glob
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sparkmem.operators import log as L
from sparkmem.operators import search as S
from sparkmem.operators.store import MemoryStore, bucket_of

LOG = "scope_id string, id string, seq long, op string, type string, content string, embedding array<double>, created_at double"


def row(seq, scope, key, op="upsert"):
    up = op == "upsert"
    return (scope, None if op == "delete_all" else key, seq, op, "episodic" if up else None, f"text {seq}" if up else None,
            [float(seq), 1.0] if up and seq % 5 else None, float(seq) if up else None)


def files(store):
    path = store.location().removeprefix("file:")
    return {b: sorted(glob.glob(f"{path}/bucket={b}/*.parquet")) for b in range(store.buckets)}


def facts(df):
    return sorted((r.scope_id or "", r.id, r.seq, r.content, r.created_at, None if r.embedding is None else tuple(r.embedding)) for r in df.collect())


@pytest.fixture
def name():
    return f"mem_{uuid.uuid4().hex[:10]}"


def test_refreshes_equal_the_fold_of_the_whole_log(spark, name):
    rnd = random.Random(3)
    scopes = [f"s{i}" for i in range(9)] + [None]
    rows = [row(i, rnd.choice(scopes), f"m{rnd.randrange(12)}", rnd.choices(["upsert", "delete", "delete_all"], [20, 3, 1])[0]) for i in range(240)]
    # deletes of null scopes never match a key (SQL equality), so leave them out
    rows = [r for r in rows if r[0] is not None or r[3] == "upsert"]
    log = spark.createDataFrame(rows, LOG)
    store = MemoryStore.create(L.fold_log(spark.createDataFrame(rows[:80], LOG)), name, 4)
    for lo in range(80, 240, 40):
        store.refresh(spark.createDataFrame(rows[lo:lo + 40], LOG))
        assert facts(store.read()) == facts(L.fold_log(spark.createDataFrame(rows[:lo + 40], LOG)))
    assert facts(store.read()) == facts(L.fold_log(log))
    store.drop()


def test_only_touched_buckets_are_read_and_written(spark, name):
    rows = [row(i, f"s{i % 20}", f"m{i}") for i in range(1, 200)]
    store = MemoryStore.create(L.fold_log(spark.createDataFrame(rows, LOG)), name, 8)
    before = files(store)
    (b,) = spark.createDataFrame([("s3",)], "scope_id string").select(bucket_of("scope_id", 8)).first()
    assert store.refresh(spark.createDataFrame([row(500, "s3", "new")], LOG)) == [b]
    after = files(store)
    assert all(after[k] == before[k] for k in range(8) if k != b) and after[b] != before[b]
    assert store.read().where("id = 'new'").count() == 1 and store.read().count() == 200
    assert store.refresh(spark.createDataFrame([], LOG)) == []
    # the last memories of a bucket go: its partition does too
    gone = store.read().where(F.col("bucket") == b).select("scope_id").distinct().collect()
    store.refresh(spark.createDataFrame([row(600 + i, r.scope_id, None, "delete_all") for i, r in enumerate(gone)], LOG))
    assert store.read().where(F.col("bucket") == b).count() == 0 and not os.path.exists(store.location().removeprefix("file:") + f"/bucket={b}")
    store.drop()


def test_one_partition_holds_one_bucket_and_reads_need_no_exchange(spark, name):
    rows = [row(i, f"s{i % 30}", f"m{i}") for i in range(1, 300)]
    store = MemoryStore.create(L.fold_log(spark.createDataFrame(rows, LOG)), name, 8)
    assert all(len(f) <= 1 for f in files(store).values())
    q = spark.createDataFrame([(f"s{i}", [1.0, float(i)]) for i in range(30)], "scope_id string, embedding array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = S.scope_hits(store.read(), q, 3, keep=("id", "type", "content"))
        got = hits.collect()
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    memory_side = [line for line in final.split("\n") if "Exchange" in line and "hashpartitioning" in line]
    assert len(memory_side) == 1 and final.count("FileScan parquet") == 1          # the queries' side only; one scan of the store
    want = {(r.scope_id, r.id, r["rank"]) for r in S.knn_join_scoped(
        store.read(), q.withColumn("qid", F.col("scope_id")), 3).collect()}
    assert {(r.scope_id, r.id, r["rank"]) for r in got} == want and len(want) == 72     # every fifth scope has no vectors
    store.drop()
