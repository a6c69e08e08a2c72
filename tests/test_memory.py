import pytest
from pyspark.sql import functions as F

from sparkmem.operators import log as L
from sparkmem.operators import search as S
from sparkmem.operators.providers import embed_table
from sparkmem.sources import fixtures as fx
from tests.conftest import SF001

LOG = ("scope_id string, seq long, op string, id string, type string, content string, "
       "importance double, created_at double")


def test_upsert_keeps_first_created_at_and_last_values(spark):
    log = spark.createDataFrame([
        ("g", 1, "upsert", "a", "episodic", "v1", 0.1, 10.0),
        ("g", 2, "upsert", "a", "semantic", "v2", 0.2, 20.0),
        ("g", 3, "upsert", "b", "episodic", "b1", 0.3, 30.0),
        ("g", 4, "delete", "b", None, None, None, None),
        ("g", 5, "upsert", "c", "episodic", "c1", 0.5, 50.0),
        ("g", 6, "delete", "c", None, None, None, None),
        ("g", 7, "upsert", "c", "episodic", "c2", 0.6, 70.0),
        ("g", 8, "upsert", "c", "episodic", "c3", 0.7, 80.0),
    ], LOG)
    t = {r.id: r for r in L.fold_log(log).collect()}
    assert set(t) == {"a", "c"}
    assert (t["a"].content, t["a"].type, t["a"].created_at) == ("v2", "semantic", 10.0)
    assert (t["c"].content, t["c"].created_at) == ("c3", 70.0)  # created_at from first upsert after delete


def test_delete_all_barrier(spark):
    log = spark.createDataFrame([
        ("g", 1, "upsert", "a", "episodic", "v1", 0.1, 10.0),
        ("g", 2, "delete_all", None, None, None, None, None),
        ("g", 3, "upsert", "b", "episodic", "b1", 0.3, 30.0),
        ("h", 1, "upsert", "a", "episodic", "h1", 0.3, 30.0),
    ], LOG)
    t = {(r.scope_id, r.id) for r in L.fold_log(log).collect()}
    assert t == {("g", "b"), ("h", "a")}


def test_fold_golden_146_of_150(spark):
    assert L.fold_log(fx.memory_log(spark, SF001)).count() == 146


def test_delete_and_delete_all_results(spark):
    table = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "scope_id string, id string")
    req = spark.createDataFrame([("g", "a", 9), ("g", "zz", 9)], "scope_id string, id string, seq long")
    stones, res = L.delete_memories(table, req)
    assert {(r.id, r.deleted) for r in res.collect()} == {("a", True), ("zz", False)}
    assert stones.where(F.col("op") == "delete").count() == 2
    req2 = spark.createDataFrame([("g", 9, "YES"), ("h", 9, "no")], "scope_id string, seq long, confirm string")
    stones2, res2 = L.delete_all(table, req2)
    got = {r.scope_id: (r.accepted, r.deleted) for r in res2.collect()}
    assert got == {"g": (True, 2), "h": (False, None)}
    assert stones2.count() == 1


def _mem(spark, rows):
    return spark.createDataFrame(rows, "scope_id string, seq long, id string, type string, content string, "
                                       "embedding array<float>, created_at double")


def test_keyword_goldens(spark):
    m = _mem(spark, [("g", 1, "x", "episodic", "aaaa", None, 1.0), ("g", 2, "y", "episodic", "Ababab", None, 2.0),
                     ("g", 3, "z", "episodic", "none", None, 3.0)])
    assert {r.id: r.score for r in S.keyword_search(m, "aa", 5).collect()} == {"x": 2}
    assert {r.id: r.score for r in S.keyword_search(m, "AB", 5).collect()} == {"y": 3}
    assert S.keyword_search(m, "   ", 5).count() == 0
    with pytest.raises(ValueError):
        S.keyword_search(m, "a", -1)


def test_vector_search_edges(spark):
    m = _mem(spark, [("g", 1, "a", "episodic", "a", [1.0, 0.0], 1.0), ("g", 2, "b", "episodic", "b", None, 2.0),
                     ("g", 3, "c", "episodic", "c", [], 3.0), ("g", 4, "d", "episodic", "d", [1.0, 0.0, 0.0], 4.0),
                     ("g", 5, "e", "episodic", "e", [0.0, 1.0], 5.0), ("g", 6, "f", "episodic", "f", [1.0, 0.0], 6.0)])
    hits = S.vector_search(m, [2.0, 0.0], k=5).orderBy("rank").collect()
    assert [h.id for h in hits] == ["a", "f", "e"]  # null, [] and other-dimension rows are skipped; ties by seq
    assert hits[0].sim == pytest.approx(1.0, abs=1e-6)


def test_vector_topk_brute_force(spark):
    import numpy as np
    v = fx.vectors(spark, SF001)
    rows = v.select("seq", "embedding").collect()
    mat = np.array([r.embedding for r in rows], dtype=np.float64)
    seqs = [r.seq for r in rows]
    q = v.where(F.col("seq") < 7).select(F.col("seq").alias("qid"), "embedding")
    got = {}
    for r in S.vector_hits(v, q, k=3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.seq))
    n = np.sqrt((mat * mat).sum(1)) + 1e-8
    for qi in range(7):
        i = seqs.index(qi)
        sims = mat @ mat[i] / (n * n[i])
        order = sorted(range(len(seqs)), key=lambda j: (-sims[j], seqs[j]))[:3]
        assert [s for _, s in sorted(got[qi])] == [seqs[j] for j in order]


def test_hash_embedding_goldens(spark):
    df = embed_table(spark.createDataFrame([("hello world",), ("hello",)], "t string"), "t")
    e = {r.t: r.embedding for r in df.collect()}
    assert len(e["hello world"]) == 256
    assert e["hello world"][:4] == pytest.approx([0.047823, -0.042789, -0.074671, 0.047823], abs=1e-6)
    from sparkmem.functions.vector import np_cosine_matrix
    import numpy as np
    c = np_cosine_matrix(np.array([e["hello"]], dtype=float), np.array([e["hello world"], e["hello"]], dtype=float))
    assert c[0, 0] == pytest.approx(-0.226676, abs=1e-6) and c[0, 1] == pytest.approx(1.0, abs=1e-6)


def test_list_recent_and_filter(spark):
    m = _mem(spark, [("g", i, f"m{i}", "episodic" if i % 2 else "semantic", "c", [1.0] if i > 2 else None,
                      float(i)) for i in range(6)])
    assert [r.id for r in S.list_recent(m, 2).orderBy("rank").collect()] == ["m5", "m4"]
    assert {r.id for r in S.filter_memories(m, type="episodic", has_embedding=True).collect()} == {"m3", "m5"}
