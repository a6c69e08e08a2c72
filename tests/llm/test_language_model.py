"""Operator 9: base scores against brute force, the model's sums to one, held-out gain, splits that change nothing."""
import math
import zlib
from collections import Counter

import numpy as np

from sparkmem.llm import language_model as L
from sparkmem.llm.queries import QUERIES
from tests.llm.test_first_ops import ODD

SF0001 = "/root/testdata/sf0.001"


def brute_tokens(t):
    b = (t or "").encode()
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in b.split()] + ["end"]


def test_base_and_gain(spark):
    rows = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op9_language_model"](spark, SF0001).collect()}
    assert len(got) == len(rows)
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    c = Counter(t for r in rows if not held[r.doc_id] for t in brute_tokens(r.text))
    n, v = sum(c.values()), len(c)
    gain = 0.0
    for r in rows:
        g, toks = got[r.doc_id], brute_tokens(r.text)
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(toks), sum(c[t] > 0 for t in toks), n)
        assert math.isclose(g.base_score, base, rel_tol=1e-9) and g.score < 0
        gain += (g.score - g.base_score) * held[r.doc_id]
    assert gain > 0


def test_odd_rows_and_splits(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, i % 4 == 0, "x") for i, t in enumerate(ODD * 3)], "id long, text string, held_out boolean, score string")
    one = {r.id: r for r in L.score(df).collect()}
    monkeypatch.setattr(L, "BLOCK_BYTES", 300)
    two = {r.id: r for r in L.score(df.repartition(5), merge=2, split_tokens=3).collect()}
    assert set(one) == set(two) == set(range(len(ODD) * 3))
    for i in one:
        a, b = one[i], two[i]
        assert (a.n_tokens, a.n_known, a.train_tokens) == (b.n_tokens, b.n_known, b.train_tokens)
        assert math.isclose(a.base_score, b.base_score, rel_tol=1e-9) and math.isclose(a.score, b.score, rel_tol=0.05)
    assert one[1].n_tokens == 1
    assert L.score(df.limit(0)).count() == 0
    none = L.score(df.withColumn("held_out", df.id >= 0)).collect()
    assert all(math.isfinite(r.score) and r.train_tokens == 0 and r.n_known == 0 for r in none)


def test_predictive_sums_to_one():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 30, 3000).astype(np.uint64)
    k = (rng.integers(0, 3, 3000) * 256 + rng.integers(0, 4, 3000)).astype(np.uint16)
    order, first = L._grouped(w, k)
    n = np.diff(np.append(first, len(order)))
    w, k = w[order][first], k[order][first]
    n2 = np.bincount(k, n, minlength=L.CONTEXTS)
    d = [0.4, 0.5, 0.6]
    r = L.Restaurants(w, k, n, L.Totals(n2, np.bincount(k, minlength=L.CONTEXTS).astype(float), np.ones(256), 30.0, d, 30, 3000), 1)
    for _ in range(3):
        r.sweep()
    t2 = np.bincount(r.k2, r.t2, minlength=L.CONTEXTS).astype(float)
    t1 = np.bincount(r.k1, r.t1, minlength=256).astype(float)
    r.tot = q = L.Totals(n2, t2, t1, float(r.t0.sum()), d, 30, 3000)
    p2, p1, p0 = r.probabilities()
    unk = (L.THETA[0] + d[0] * q.t0) / 31 / (L.THETA[0] + q.n0)
    assert math.isclose(p0.sum() + unk, 1.0, rel_tol=1e-9)
    for c in np.unique(k):
        parent = np.zeros(30)
        more1 = (L.THETA[1] + d[1] * q.t1[c >> 8]) / (L.THETA[1] + q.n1[c >> 8])
        parent[:] = more1 * p0
        mine = r.k1 == (c >> 8)
        parent[r.w1[mine]] = p1[mine]
        more2 = (L.THETA[2] + d[2] * q.t2[c]) / (L.THETA[2] + q.n2[c])
        full = more2 * parent
        here = r.k2 == c
        full[r.w[here]] = p2[here]
        assert math.isclose(full.sum() + more2 * more1 * unk, 1.0, rel_tol=1e-9)


def test_table_counts_follow_their_exact_law():
    """Tables of 4 customers: frequencies of the draw against customers seated by the restaurant's rule, weighted."""
    d, theta, p, big, n = 0.5, 1.0, 0.2, 3.0, 4
    rng = np.random.default_rng(1)
    t = L.draw_tables(np.full(40000, n), np.full(40000, p), np.full(40000, big), d, theta, L.stirling(d), rng)
    # all seatings: weight of a new table (theta + d (big + t)) p, of joining (size - d)
    law = Counter()

    def seat(sizes, left, weight):
        if not left:
            law[len(sizes)] += weight
            return
        seat([*sizes, 1], left - 1, weight * (theta + d * (big + len(sizes))) * p)
        for i, s in enumerate(sizes):
            seat([*sizes[:i], s + 1, *sizes[i + 1:]], left - 1, weight * (s - d))
    seat([], n, 1.0)
    total = sum(law.values())
    for k in range(1, n + 1):
        assert abs((t == k).mean() - law[k] / total) < 0.012


def test_context_is_the_whole_previous_word(spark):
    """Words of one class (equal last bytes, 8 equal bits of their hash) keep contexts of their own."""
    from sparkmem.llm.common import span_hash
    first = {}
    for i in range(100000):
        word = f"w{i}zz"
        data = np.frombuffer(word.encode(), np.uint8)
        bits = int(span_hash(data, np.array([0]), np.array([len(data)]))[0]) >> 56
        if bits in first:
            break
        first[bits] = word
    one, two = first[bits], word
    train = [f"{one} red", f"{two} blue"] * 40
    rows = [(i, t, False) for i, t in enumerate(train)] + [(90, f"{one} red", True), (91, f"{one} blue", True),
                                                           (92, f"{two} blue", True), (93, f"{two} red", True)]
    got = {r.id: r.score for r in L.score(spark.createDataFrame(rows, "id long, text string, held_out boolean")).collect()}
    # the held-out texts differ in what follows the same word; a class model can't tell them apart
    assert got[90] > got[91] + 0.5 and got[92] > got[93] + 0.5


def test_contexts_not_learned_hand_down(spark):
    """A pair not learned costs what its context keeps for new dishes: much for a context with one dish, less for one with many."""
    train = ["fixed same"] * 60 + [f"free n{i}" for i in range(60)] + ["other"] * 20
    rows = [(i, t, False) for i, t in enumerate(train)] + [(900, "fixed other", True), (901, "free other", True), (902, "unseen other", True)]
    got = {r.id: r.score for r in L.score(spark.createDataFrame(rows, "id long, text string, held_out boolean")).collect()}
    assert got[901] > got[900] + 0.5 and all(math.isfinite(x) for x in got.values())


def test_ids_beside_a_null_id_stay_as_they_are(spark):
    rows = [(2 ** 60 + 1, "a b", False), (None, "a c", False), (2 ** 60 + 3, "a b", True)]
    docs = spark.createDataFrame(rows, "id long, text string, held_out boolean").coalesce(1)
    got = {r.id: (r.held_out, r.n_tokens) for r in L.score(docs).collect()}
    assert got == {2 ** 60 + 1: (False, 3), None: (False, 3), 2 ** 60 + 3: (True, 3)}


def test_turns_cut_what_is_sent_and_change_no_score(spark):
    """A turn sends its own range of buckets only (disk holds one turn's words), and the turns together are the whole job."""
    import pyarrow as pa
    texts = [f"w{i % 7} x{i % 11} y{i} w{i % 3}" for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(60)), pa.array([i % 5 == 0 for i in range(60)])], ["text", "id", "held_out"])
    sent = [[(r["bucket"], r["block"], r["payload"]) for b in L._send_documents(9, {}, low, high)([batch]) for r in b.to_pylist()]
            for low, high in ((0, 3), (3, 6), (6, 9), (0, 9))]
    for low, rows in zip((0, 3, 6), sent):
        assert rows and all(low <= k < low + 3 or (k < 0 and low == 0) for k, _, _ in rows)
    assert sorted(sent[0] + sent[1] + sent[2]) == sorted(sent[3])
    df = spark.createDataFrame([(i, t, i % 5 == 0) for i, t in enumerate(texts)], "id long, text string, held_out boolean").coalesce(1)
    one, many = ({r.id: tuple(r)[1:5] + (round(r.base_score, 9), round(r.score, 9)) for r in L.score(df, turns=n).collect()} for n in (1, 4))
    assert len(one) == 60 and one == many


def test_contexts_asked_for_are_one_row_per_block_and_bucket():
    """Contexts of pairs not learned, from many buckets of words, are summed before they are dealt to the buckets of contexts."""
    import pandas as pd
    contexts, rng = np.arange(1, 41, dtype=np.uint64) << np.uint64(50), np.random.default_rng(0)
    asked, law = [], Counter()
    for _ in range(30):
        ci, row, times = rng.integers(0, 40, 50), rng.integers(0, 6, 50), rng.integers(1, 4, 50)
        asked.append((7, 2, 0, L._z(contexts, ci.astype("<u4"), row.astype("<u4"), times.astype("<u4"))))
        for c, r, t in zip(ci, row, times):
            law[int(contexts[c]), int(r)] += int(t)
    out = L._sum_block(5)((7,), pd.DataFrame(asked, columns=["block", "kind", "part", "payload"]))
    assert len(out) == out["part"].nunique() <= 5 and set(out["kind"]) == {2}
    got = Counter()
    for part, payload in zip(out["part"], out["payload"]):
        ctx, ci, row, times = L._unz(payload)
        assert (L._bucket(ctx, 5) == part).all()
        for c, r, t in zip(ctx[ci], row, times):
            got[int(c), int(r)] += int(t)
    assert got == law
