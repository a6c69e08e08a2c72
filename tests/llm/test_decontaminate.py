"""Operator 7 on planted passages, paraphrases and odd rows."""
import numpy as np

from sparkmem.llm import decontaminate as D
from sparkmem.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.test_first_ops import ODD


def brute_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_bit_parallel_lcs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 8, rng.integers(1, 90)), rng.integers(0, 8, rng.integers(0, 90))
        assert D.lcs(D._masks(a), len(a), b.tolist()) == brute_lcs(a.tolist(), b.tolist())


def test_every_planted_item_is_found(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text}
    assert want <= got and len(got - want) <= 2


def test_paraphrases_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghijklm"), int(n))) for n in rng.integers(2, 9, 3000)]

    def text(n):
        return " ".join(rng.choice(vocab, n))
    items = [text(40) + ". Answer: " + text(6) for _ in range(300)] + [text(300), "too short", None, ""]
    items += [items[0]]
    clean = [text(int(n)) for n in rng.integers(5, 400, 200)]
    para = []
    for it in items[:20]:
        w = it.split()
        for i in rng.choice(38, 8, replace=False):
            w[i] = "zzz" + w[i]
        para.append(text(90) + " " + " ".join(w).upper() + " " + text(70))
    lost = [" ".join(it.split()[:20]) + " " + text(80) for it in items[20:30]]     # half an item without its answer
    texts = clean + para + [text(500) + "\n" + items[300] + "\n" + text(100)] + ODD + lost
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "id long, text string, cosine double").repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item_id) for r in D.find_leaks(docs, bench).collect()}
    want = {(200 + i, i) for i in range(20)} | {(220, 300), (200, len(items) - 1)}
    assert got == want
    assert D.find_leaks(docs.limit(0), bench).count() == 0
    assert D.find_leaks(docs, bench.limit(0)).count() == 0


def _leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.id, r.item_id): r for r in D.find_leaks(docs, bench).collect()}


def _writer(seed, size=3000):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefghijklm"), int(n))) for n in rng.integers(3, 9, size)]
    return lambda n: " ".join(rng.choice(vocab, n))


def test_copies_of_an_item_do_not_hide_it(spark):
    """A third of the rows hold one item (bare, or among rare words of other items), or both of two rows."""
    text = _writer(5)
    items = [text(20) for _ in range(40)]
    rare = " ".join(items[1:]).split()
    texts = [text(60) for _ in range(60)]
    texts += [items[0] if i % 2 else " ".join(rare[i:i + 15]) + " " + items[0] + " " + " ".join(rare[i + 99:i + 114]) for i in range(30)]
    assert {d for d, m in _leaks(spark, texts, items) if m == 0} == set(range(60, 90))
    assert set(_leaks(spark, [items[0], text(9) + " " + items[0]], items)) == {(0, 0), (1, 0)}


def test_every_place_of_an_item_is_judged(spark):
    """More of the item without its answer early on, less of it with the answer later."""
    text = _writer(6)
    items = [text(40) + ". Answer: " + text(8) for _ in range(30)]
    w = items[0].split()
    early, late = " ".join(w[:35]), " ".join(w[:22] + w[40:])
    texts = [early + " " + text(250) + " " + late + " " + text(40), early + " " + text(250), *(text(200) for _ in range(40))]
    got = _leaks(spark, texts, items)
    assert set(got) == {(0, 0)} and got[0, 0].answer_share == 1.0 and got[0, 0].lcs_share < 0.7


def test_passages_of_long_items_and_short_items(spark):
    text = _writer(7)
    long = [text(300) for _ in range(3)]
    w = long[0].split()
    items = long + [text(30) for _ in range(20)] + ["zzq one", "\u6f22\u5b57\u306e\u554f\u984c", "zzq one", ""]
    texts = [text(100) + " " + " ".join(w[a:a + 64]) + " " + text(100) for a in (48, 64, 100)]       # 64 words of 300
    texts += [text(100) + " " + " ".join(w[100:120]) + " " + text(100)]                              # 20 of 300
    texts += [text(20) + " Zzq, one " + text(20), text(20) + " one zzq " + text(5), "zzq\n" + text(3) + " one", text(9) + " \u6f22\u5b57\u306e\u554f\u984c. " + text(9), "zzq", "one"]
    texts += [text(200) for _ in range(40)]
    assert set(_leaks(spark, texts, items)) == {(0, 0), (1, 0), (2, 0), (4, 23), (4, 25), (7, 24)}
    assert set(_leaks(spark, texts, items[23:])) == {(4, 0), (4, 2), (7, 1)}
