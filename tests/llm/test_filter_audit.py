"""Operator 12 against plain loops over sets."""
import itertools
import random
import re

import numpy as np
import pytest

from sparkmem.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, kept int"
LABELS = "doc_id long, quality int, toxic int, extra string"


def fails(rows):
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        least = min((d for d, u, _ in rows if (u or "") == t and d is not None), default=None)
        out.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                    "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and doc_id > least})
    return out


def expected(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    failed = fails(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                removed = [d for d, x in left if x[f]]
                left = [(d, x) for d, x in left if not x[f]]
                steps.append(("".join(order), step, f, len(left), len(removed), sum(x[f] for _, x in mine) - len(removed),
                              sum(x[f] and sum(x.values()) == 1 for _, x in mine), sum(d in good for d in removed), sum(d in toxic for d in removed)))
        for s in steps:
            out[part, s[0], s[1]] = (*s[3:], sum(x[4] for x in steps if x[2] == s[2]))
    return out


def run(spark, rows, labels, **how):
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS)
    got = A.audit(docs, spark.createDataFrame([(*x, "") for x in labels], LABELS), **how).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def texts(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        w = [rnd.choice(["aa", "Bb", "ccc", "ÜÜ", "d"]) if rnd.random() < 0.3 else f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, 3, 99, 100, 130]))]
        t = rnd.choice([" ", "\n", "\x0b \t"]).join(w)
        t = t.upper() if rnd.random() < 0.2 else t
        yield t + (rnd.choice("#$%&*|") if rnd.random() < 0.2 else "")


@pytest.mark.parametrize("size", [1 << 16, 8])
def test_equals_plain_loops(spark, size):
    pool = list(texts(60, 1))
    rnd = random.Random(2)
    rows = [(i, rnd.choice(pool), rnd.choice(["en", "en", "fr", None])) for i in range(150)]
    rows += [(None, pool[0], "en"), (None, pool[0], "en"), (7, rows[7][1], "en"), (7, "other text", "de"), (500, None, "xx"), (501, "", "xx"), (502, "clean " + " ".join(map(str, range(120))), "zz")]
    labels = [(i, rnd.randrange(2), rnd.randrange(2)) for i in range(0, 150, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (501, None, 1), (10 ** 9, 1, 1)]
    assert run(spark, rows, labels, range_rows=size) == expected(rows, labels)


def test_no_rows_and_no_labels(spark):
    assert run(spark, [], []) == {}
    got = run(spark, [(1, "x" * 10, None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_hot_part_is_cut_into_ranges(spark):
    docs = spark.createDataFrame([(i, "short", "en", 1) for i in range(400)], DOCS).repartition(3)
    lists = A.postings(A.failing_documents(docs, spark.createDataFrame([], LABELS), range_rows=16)).collect()
    assert sum(r.documents for r in lists) == 400 and max(r.documents for r in lists) <= 16 and len(lists) >= 25
    assert all(list(r.A) == sorted(r.A) for r in lists) and sum(len(r.E) for r in lists) == 399


def test_list_operations():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        lists = [np.unique(rnd.integers(lo, lo + rnd.integers(1, 300), rnd.integers(0, 60))) for lo in rnd.integers(0, 500, 5)]
        assert A.union(lists).tolist() == sorted(set().union(*map(set, map(np.ndarray.tolist, lists))))
        a, b = lists[0], lists[1]
        assert A.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert A.intersection_size(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_long_texts_in_slices(monkeypatch):
    rnd = random.Random(4)
    text = " ".join(f"w{rnd.randrange(300)}" for _ in range(2000)) + " " + "y" * 500
    whole = (len(text.split()), len(set(text.split())))
    monkeypatch.setattr(A, "SLICE", 64)
    assert A.word_counts(text.encode()) == whole
    assert A.word_counts(b"\x0b" * 300) == (0, 0)
