"""Keyword search over postings of trigrams against a plain scan."""
import random

import numpy as np

from sparkmem.operators import search as S
from sparkmem.operators import text_index as X

MEM = "id string, seq long, content string"


def plain(rows, queries, k):
    out = []
    for qid, q in queries:
        ql = (q or "").lower()
        if not ql.strip():
            continue
        hits = sorted((-(r[2] or "").lower().count(ql), r[1], r[0]) for r in rows if ql in (r[2] or "").lower())
        out += [(qid, i, key, -n) for i, (n, _, key) in enumerate(hits[:k], 1)]
    return sorted(out)


def test_equals_a_scan(spark):
    rnd = random.Random(2)
    words = ["alpha", "Beta", "gamma ray", "ÜÄö", "x", "日本語の文", "a\nb", "aaaa"]
    rows = [(f"m{i}", i, " ".join(rnd.choices(words, k=rnd.randrange(9))) if i % 11 else None) for i in range(300)]
    rows += [(f"copy{i}", 1000 + i, "the same text again") for i in range(150)]
    queries = [(1, "mma r"), (2, "BETA g"), (3, "öä"), (4, "本語の"), (5, "zzz"), (6, "  "), (7, None), (8, "aa"), (9, "a"), (10, "same text"), (11, "aaaa a"),
               (12, "the same text again and more"), (13, " x "), (14, "aaa")]
    mem = spark.createDataFrame(rows, MEM).repartition(3)
    q = spark.createDataFrame(queries, "qid long, query string")
    index = X.build_text_index(mem)
    got = sorted((r.qid, r["rank"], r.id, r.score) for r in X.indexed_search(index, q, 4).collect())
    assert got == plain(rows, queries, 4)
    same = sorted((r.qid, r["rank"], r.id, r.score) for r in S.keyword_search_batch(mem, q, 4).collect())
    assert got == same


def test_texts_are_read_for_candidates_only(spark):
    rows = [(f"m{i}", i, f"common words in every text and number n{i}n") for i in range(400)]
    index = X.build_text_index(spark.createDataFrame(rows, MEM).repartitionByRange(8, "seq"))
    q = spark.createDataFrame([(0, "common words"), (1, "number n77n"), (2, "no such text")], "n long, ql string")
    found = X.candidates(index, q).groupBy("n").count().collect()
    counts = {r["n"]: r["count"] for r in found}
    assert counts[0] == 400 and 1 <= counts[1] <= 5 and 2 not in counts
    # the join with the texts prunes chunks by the candidates
    hits = X.indexed_search(index, spark.createDataFrame([(1, "number n77n")], "qid long, query string"), 5)
    assert [r.id for r in hits.collect()] == ["m77"]
    assert "dynamicpruning" in hits._jdf.queryExecution().executedPlan().toString().lower()


def test_empty_and_odd(spark):
    none = X.build_text_index(spark.createDataFrame([("a", 1, None)], MEM))
    q = spark.createDataFrame([(1, "abc"), (2, "ab")], "qid long, query string")
    assert X.indexed_search(none, q, 3).count() == 0
    assert len(X.trigrams("ab")) == 0 and len(X.trigrams("aaaa")) == 1
    text = "".join(random.Random(1).choices("abcdé日", k=5000))
    whole = X.trigrams(text)
    X.SLICE, keep = 100, X.SLICE
    try:
        assert np.array_equal(X.trigrams(text), whole)
    finally:
        X.SLICE = keep


def test_short_queries_read_a_text_once(spark):
    """queries of one or two characters are counted together, in one pass over a text."""
    rnd = random.Random(5)
    rows = [(f"m{i}", i if i % 9 else None, "".join(rnd.choices("aab é😀\n", k=rnd.randrange(40))) if i % 7 else None) for i in range(500)]
    rows += [("m3", 3, "aaaaa aa"), ("m3", 3, "aaaaa aa"), ("long", 7, "ab" * 3000 + "aaa")]
    queries = [(i, q) for i, q in enumerate(["a", "aa", "é😀", "😀", "b ", " a", "AB", "zz", "\na", "aa"])] + [(1, "aa"), (2, "b")]
    mem = spark.createDataFrame(rows, MEM).repartition(3)
    index = X.build_text_index(mem)
    q = spark.createDataFrame(queries, "qid long, query string")
    keep, X.SHORT_BLOCK, X.SLICE = (X.SHORT_BLOCK, X.SLICE), 3, 64
    try:
        hits = X.indexed_search(index, q, 4)
        plan = hits._jdf.queryExecution().executedPlan().toString().lower()
        got = sorted((r.qid, r["rank"], r.id, r.score) for r in hits.collect())
    finally:
        X.SHORT_BLOCK, X.SLICE = keep
    assert got == sorted((r.qid, r["rank"], r.id, r.score) for r in S.keyword_search_batch(mem, q, 4).collect())
    assert "mapinarrow" in plan and "contains(lc" in plan and "filter(qs" not in plan
