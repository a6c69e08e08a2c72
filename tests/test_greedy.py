"""The greedy fold in rounds equals the plain fold."""
import random

import numpy as np
import pytest

from sparkmem.operators import consolidate as C
from sparkmem.operators import greedy as G

SCHEMA = "scope_id string, seq long, id string, type string, content string, created_at double, embedding array<double>"


def near_copies(n, seed, d=4, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    x = centres[rng.integers(0, 5, n)] + rng.normal(0, spread, (n, d))
    x[rng.integers(0, n, n // 4)] = x[0]                        # copies of one vector all over the order
    return x


def sequential(rows, threshold):
    """Per scope: partition of the ids by the plain rule, newest first."""
    out = set()
    for scope in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == scope), key=lambda r: (-r[5], -r[1], r[2]))
        clusters = []
        for r in mine:
            e = None if r[6] is None else np.array(r[6])
            for c in clusters:
                if e is None or c[0] is None or len(c[0]) != len(e):
                    continue
                m = c[0] / len(c[1])
                if m @ e / ((np.sqrt(m @ m) + 1e-8) * (np.sqrt(e @ e) + 1e-8)) >= threshold:
                    c[0] = c[0] + e
                    c[1].append(r[2])
                    break
            else:
                clusters.append([e, [r[2]]])
        out |= {(scope, frozenset(c[1])) for c in clusters}
    return out


def partition(df):
    groups = {}
    for r in df.collect():
        groups.setdefault((r.scope_id, r.cluster), []).append(r.id)
    return {(k[0], frozenset(v)) for k, v in groups.items()}


@pytest.mark.parametrize("threshold,round_items,seed", [(0.9, 16_384, 1), (0.9, 7, 2), (0.8, 13, 3), (0.97, 5, 4), (0.0, 40, 5)])
def test_rounds_equal_the_plain_fold(spark, threshold, round_items, seed):
    x = near_copies(160, seed)
    rnd = random.Random(seed)
    rows = [("s" if i % 3 else None, i, f"m{i}", "episodic", f"c{i}", float(rnd.randrange(100)), [float(v) for v in r]) for i, r in enumerate(x)]
    if threshold > 0:
        rows += [("s", 900, "none", "episodic", "n", 5.0, None), ("s", 901, "short", "episodic", "n", 5.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = C.cluster_members(df, None, threshold, round_items=round_items)
    assert partition(got) == sequential(rows, threshold)


def test_hot_component_runs_in_rounds(spark, monkeypatch):
    """A component of most rows: no task folds more than a round's items, and every member is a row of its cluster."""
    seen = []
    plain = G.fold_groups
    monkeypatch.setattr(C, "fold_groups", lambda *a: seen.append(a[-1]) or plain(*a[:-1], 25))
    rng = np.random.default_rng(6)
    x = np.array([1.0, 0.0, 0.0]) + rng.normal(0, 0.02, (300, 3))
    rows = [("s", i, f"m{i}", "episodic", "c", float(i), [float(v) for v in r]) for i, r in enumerate(x)]
    semantic, members = C.consolidate_members(spark.createDataFrame(rows, SCHEMA), 0.0, None, 0.95)
    (row,) = semantic.collect()
    assert seen == [G.ROUND_ITEMS] and row.n_members == 300
    got = members.collect()
    assert {r.member for r in got} == {r[2] for r in rows} and {r.semantic_id for r in got} == {row.id}


def test_runs_are_numbered_across_partitions(spark):
    rnd = random.Random(7)
    rows = [(rnd.randrange(3), rnd.randrange(40), i, rnd.choice([1, 1, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "group long, pos long, row long, node long").repartition(6)
    got = G.number_runs(df).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1], r[3]))
    runs, k = {}, -1
    for i, (g, _, row, node) in enumerate(order):
        k += i == 0 or (order[i - 1][0], order[i - 1][3]) != (g, node)
        runs[row] = k
    # rows of one (group, pos, node) are the same to the numbering
    assert {r.row: r.run for r in got} == runs


def test_fold_without_groups(spark):
    empty = spark.createDataFrame([], "group long, run long, node long, n long")
    assert G.fold_groups(empty, spark.createDataFrame([], "node long, embedding array<double>"), 0.9, 4).count() == 0
    assert C.cluster_members(spark.createDataFrame([], SCHEMA), None, 0.9).count() == 0
