"""The stored vector index: bounds never rule out a pair that counts, and products equal brute force."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmem.operators import consolidate as C
from sparkmem.operators import search as S
from sparkmem.operators import vector_index as V

EPS = 1e-8


def clustered(n, d=16, centres=40, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return c[rng.integers(0, centres, n)] + rng.normal(0, 0.05, (n, d))


def frame(spark, x, extra=()):
    rows = [(str(i), i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id string, seq long, embedding array<double>").repartition(3)


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks from few rows (only the driver's side plans with these)."""
    monkeypatch.setattr(V, "LEAST_ROWS", 16)
    monkeypatch.setattr(V, "SPLITS", 64)
    monkeypatch.setattr(V, "SORTED_AT_ONCE", 1024)


def cosines(x, y):
    return x @ y.T / np.outer(np.sqrt((x * x).sum(1)) + EPS, np.sqrt((y * y).sum(1)) + EPS)


def best(sim, k):
    return [sorted(range(sim.shape[1]), key=lambda j: (-round(sim[i, j], 12), j))[:k] for i in range(len(sim))]


ODD = [("z", 9000, [0.0] * 16), ("none", 9001, None), ("empty", 9002, []), ("nan", 9003, [float("nan")] * 16), ("null", 9004, [None] + [1.0] * 15),
       ("inf", 9005, [float("inf")] + [1.0] * 15), ("short", 9006, [1.0, 2.0])]


def test_blocks_leave_most_pairs_out(spark, small_blocks):
    x = clustered(1200)
    index = V.build_index(frame(spark, x, ODD), "embedding", ["id", "seq"], ["seq"])
    assert index.n_rows == 1202 and index.n_blocks > 60            # the zero vector and the short one are usable, the other odd rows aren't
    pairs = V.near_blocks(index, index, math.acos(0.9))
    rows = pairs.collect()
    n = index.n_blocks * (index.n_blocks + 1) // 2
    assert len({(r.a_block, r.b_block) for r in rows}) == len(rows) < n / 4
    assert all(r.a_block <= r.b_block for r in rows)
    # no matrix is read for it, and no row is multiplied before blocks have met
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "mat:binary" not in plan and "explode" not in plan


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.2])
def test_pairs_equal_brute_force(spark, small_blocks, threshold):
    x = clustered(300, centres=12)
    x[40] = x[3]
    x[41] = x[3] * 2
    df = frame(spark, x, ODD)
    got = {(r.id_a, r.id_b): r.sim for r in C.block_pairs(df, threshold).collect()}
    sim = cosines(x, x)
    want = {(str(i), str(j)) for i in range(300) for j in range(i + 1, 300) if sim[i, j] >= threshold}
    if threshold <= 0:
        want |= {(str(i), "z") for i in range(300)}
    assert set(got) == want
    assert all(abs(s - (sim[int(a), int(b)] if b != "z" else 0)) < 1e-12 for (a, b), s in got.items())


@pytest.mark.parametrize("k,first", [(1, 8192), (5, 8192), (40, 8192), (5, 1 << 25)])
def test_topk_equals_brute_force(spark, small_blocks, k, first):
    x, q = clustered(900), np.concatenate([clustered(30, seed=1), np.random.default_rng(3).normal(size=(30, 16)), np.zeros((1, 16))])
    x[100:400] = x[7]                                               # a third of the rows are copies: ties go by seq
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "qid long, embedding array<double>")
    got = {}
    for r in S.vector_hits(frame(spark, x, ODD), queries, k, first_bytes=first).collect():
        got.setdefault(r.qid, []).append((r["rank"], int(r.seq)))
    full = np.concatenate([x, np.zeros((1, 16))])
    seqs = [*range(900), 9000]
    for i, order in enumerate(best(cosines(q, full), k)):
        assert [s for _, s in sorted(got[i])] == [seqs[j] for j in order]


def test_second_pass_reads_few_blocks(spark, small_blocks):
    x = clustered(1200)
    index = V.build_index(frame(spark, x), "embedding", ["id", "seq"], ["seq"])
    alike = x[np.argsort(-cosines(x[:1], x)[0])[:20]]               # of one cluster
    asked = V.build_index(frame(spark, alike + 0.001), "embedding", ["id"], pivots=index.pivots)
    floors = asked.blocks.select("block", F.lit(0.95).alias("floor"))
    left = V.near_blocks(asked, index, floors=floors).count()
    assert left < asked.n_blocks * index.n_blocks / 4
    assert V.nearest_blocks(asked, index, 4).count() == 4 * asked.n_blocks


def test_links_have_the_components(spark, small_blocks):
    x = clustered(400, centres=9)
    df = frame(spark, x).withColumn("id", F.col("seq"))
    edges = [(r.id_a, r.id_b) for r in C.block_pairs(df, 0.95, links=True).collect()]
    sim = cosines(x, x)

    def comps(pairs):
        label = list(range(400))
        for _ in range(400):
            old = list(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if old == label:
                return label
        return label
    assert comps(edges) == comps([(i, j) for i in range(400) for j in range(i) if sim[i, j] >= 0.95])
    assert len(edges) < (sim >= 0.95).sum() / 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, seq long, embedding array<double>")
    some = frame(spark, clustered(5))
    asked = some.select(F.col("seq").alias("qid"), "embedding")
    assert S.vector_hits(none, asked, 3).count() == 0
    assert S.vector_hits(some, asked.limit(0), 3).count() == 0
    assert C.block_pairs(none, 0.5).count() == 0
    assert S.vector_hits(some, asked, 0).count() == 0


def test_pivots_are_spread():
    x = clustered(200, centres=5)
    p = V.choose_pivots([list(r) for r in x] + [[0.0] * 16, [None] * 16, [1.0, 1.0]])
    assert set(p) == {2, 16} and 5 <= len(p[16]) <= V.PIVOTS and len(p[2]) == 1
    first = V.angles(p[16][:5], p[16][:5]) + np.eye(5)
    assert first.min() > 0.5                                        # one of each cluster before a second of any


def test_stored_blocks_are_read_in_small_groups(spark):
    """a reader holds a row group; without a limit of its own a file of blocks was one group."""
    import pyarrow.parquet as pq
    rows = spark.range(4096).select(F.col("id").alias("seq"), F.expr("transform(sequence(1, 2048), i -> cast(xxhash64(id, i) / 1e18 as float))").alias("v"))
    index = V.build_index(rows, "v", ["seq"], ["seq"])
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.blocks.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert index.n_bytes >= 60 << 20 and sum(g.num_rows for g in groups) == index.n_blocks
    assert max(g.total_byte_size for g in groups) <= V.GROUP_BYTES + 2 * V.BLOCK_BYTES


def test_best_of_ranks_what_reaches_the_floor(spark):
    """rows, ties and copies as a full sort has them, with one floor, a floor per row, or none."""
    import pyarrow as pa
    rnd = np.random.default_rng(3)
    x = np.repeat(rnd.normal(size=(120, 8)), 3, axis=0)[rnd.permutation(360)]
    x[5] = 0
    key = pa.RecordBatch.from_arrays([pa.array(np.arange(360))], ["id"])
    a, b = V.Block(0, key.slice(0, 90), x[:90].copy()), V.Block(1, key, x)
    full = np.array([[V.single_cosines(a, b, np.array([i]), np.array([j]))[0] for j in range(360)] for i in range(90)])
    for k, floor in ((4, -2.0), (7, 0.8), (5, np.linspace(-1, 1, 90)), (400, -2.0)):
        r, c, s = V.best_of(a, b, k, floor)
        least = np.broadcast_to(floor, 90)
        want = {(i, j) for i in range(90) for j in np.lexsort((np.arange(360), -full[i]))[:k] if full[i, j] >= least[i]}
        assert {(i, j) for i, j in zip(r, c) if full[i, j] >= least[i]} == want and (np.diff(r) >= 0).all()
        assert (s == full[r, c]).all() and (np.bincount(r, minlength=90) <= k).all()


@pytest.mark.parametrize("threshold", [0.9, 0.2])
def test_tiles_are_sent_in_turns(spark, small_blocks, monkeypatch, threshold):
    """floats were stored as doubles, blocks of a few rows had tiles of four of them, and all tiles were shuffled at once."""
    monkeypatch.setattr(V, "SIDE_BYTES", 16 << 10)
    monkeypatch.setattr(V, "LEAST_SIDE", 1 << 10)
    monkeypatch.setattr(V, "TURN_BYTES", 1 << 16)
    freed = []
    monkeypatch.setattr(V, "free_disk", lambda spark, *folders: freed.append(folders))
    rnd = np.random.default_rng(5)
    x = (clustered(300, centres=12) @ rnd.normal(size=(16, 64))).astype(np.float32)         # 16 directions of 64
    x[250:] += 0.1 * rnd.normal(size=(50, 64)).astype(np.float32)
    df = frame(spark, x).withColumn("embedding", F.col("embedding").cast("array<float>"))
    index = V.build_index(df, "embedding", ["id", "seq"], ["seq"])
    assert index.axes[64].shape[1] <= 32 and index.n_bytes == x.size * 8
    assert index.blocks.agg(F.sum(F.octet_length("mat"))).first()[0] == x.size * 4
    freed.clear()
    got = {(int(r.id_a), int(r.id_b)): r.sim for r in C.block_pairs(df, threshold).collect()}
    assert sum(not f for f in freed) > 1                            # a turn's shuffle files go before the next
    sim = cosines(x.astype(float), x.astype(float))
    assert set(got) == {(i, j) for i in range(300) for j in range(i + 1, 300) if sim[i, j] >= threshold}
    assert all(abs(s - sim[p]) < 1e-12 for p, s in got.items())


def test_low_products_are_never_less(spark):
    """products along the leading directions leave out no pair, whatever the vectors."""
    import pyarrow as pa
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(200, 4)) @ rnd.normal(size=(4, 24)) + rnd.normal(size=(200, 24)) * np.repeat([0, 0.01, 1, 100], 50)[:, None]
    x[7] = 0
    x *= 10.0 ** rnd.integers(-12, 12, size=(200, 1))
    axes = V.leading_axes([list(r) for r in x[:50]])[24]
    assert axes.shape == (24, 4)
    key = pa.RecordBatch.from_arrays([pa.array(np.arange(200))], ["id"])
    for block in (V.Block(0, key, x, axes), V.Block(0, key, x)):
        low = block.low @ block.low.T
        exact = V.units(x) @ V.units(x).T
        assert (low >= exact - V.loose(24)).all() and (block.low.shape[1] == 24 or np.abs(low - exact)[:50, :50].max() < 1e-5)
