import pytest
from pyspark.sql import functions as F

from sparkmem.operators import working as W
from sparkmem.sources import fixtures as fx
from tests.conftest import SF001


def _thoughts(spark, lengths, scope="s"):
    rows = [(scope, i, f"t{i}", "x" * n, ["insight"], 0.5, 0.5, 1000.0 - i) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "scope_id string, seq long, id string, content string, tags array<string>, "
                                       "importance double, uncertainty double, ts double")


def _fifo(lengths, budget):
    """The literal append-and-pop loop."""
    buf, total = [], 0
    for i, n in enumerate(lengths):
        buf.append((i, n))
        total += n
        while buf and total > budget:
            total -= buf.pop(0)[1]
    return [i for i, _ in buf]


@pytest.mark.parametrize("lengths,budget", [
    ([15] * 10, 50), ([10, 60, 5, 5], 50), ([0, 3, 0, 7, 0, 60, 0, 2, 0], 10), ([5, 0, 0], 0),
    ([80], 50), ([], 50), ([1, 2, 3, 0, 4, 0], 500)])
def test_budget_equals_fifo_loop(spark, lengths, budget):
    if not lengths:
        return
    kept = W.working_memory(_thoughts(spark, lengths), budget)
    assert sorted(r.seq for r in kept.collect()) == _fifo(lengths, budget)


def test_reference_scenario_three_remain(spark):
    kept = W.working_memory(_thoughts(spark, [15] * 10), 50).collect()
    assert len(kept) == 3 and sum(len(r.content) for r in kept) <= 50


def test_fifo_loop_on_conversations(spark):
    th = fx.thoughts(spark, SF001)
    rows = th.select("scope_id", "seq", F.length("content").alias("n")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.scope_id, []).append((r.seq, r.n))
    expect = set()
    for s, items in by.items():
        items.sort()
        for i in _fifo([n for _, n in items], 4000):
            expect.add((s, items[i][0]))
    got = {(r.scope_id, r.seq) for r in W.working_memory(th, 4000).collect()}
    assert got == expect


def test_decay_goldens(spark):
    df = spark.createDataFrame([(0.6, 0.0), (0.5, 980.0)], "importance double, ts double")
    a = W.decay_score(df, 900.0, 900).collect()
    assert a[0].score == pytest.approx(0.3)
    b = W.decay_score(spark.createDataFrame([(0.5, 0.0)], "importance double, ts double"), 20.0, 10).first()
    assert b.score == pytest.approx(0.125)
    c = W.decay_score(spark.createDataFrame([(0.5, 0.0)], "importance double, ts double"), 20.0, 0).first()
    assert c.score == pytest.approx(0.5)
    d = W.decay_score(spark.createDataFrame([(0.5, 5.0)], "importance double, ts double"), 0.0, 10).first()
    assert d.score == pytest.approx(0.5)


def test_older_scores_lower(spark):
    df = _thoughts(spark, [15] * 3)
    s = {r.seq: r.score for r in W.decay_score(df, 1000.0, 10).collect()}
    assert s[2] < s[1] < s[0]  # ts falls as seq rises


def test_view_and_recent(spark):
    wm = W.working_memory(_thoughts(spark, [1] * 12), 4000)
    v = W.wm_view(wm, 0).collect()  # n is clamped to 1
    assert [r.seq for r in v] == [11]
    r = sorted(W.recent_thoughts(_thoughts(spark, [1] * 120), 500, 100).collect(), key=lambda x: x.pos)
    assert len(r) == 100 and r[0].seq == 20 and r[-1].seq == 119


def test_summary_budget_and_order(spark):
    wm = _thoughts(spark, [10, 20, 30])
    lines = W.wm_lines(wm, 1000.0, 900, ctx_tokens=1)  # budget int(1*4*.3) = 1 char
    assert lines.count() == 0
    lines = sorted(W.wm_lines(wm, 1000.0, 900).collect(), key=lambda r: r.rank)
    assert lines[0].line.startswith("- ['insight'] ")
    assert [r.seq for r in lines] == [0, 1, 2]  # equal importance, older ts decays more? ts falls with seq
