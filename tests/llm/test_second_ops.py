"""Operators 2, 8, 10 against brute force, held-out accuracy and the library."""
import numpy as np
import pyarrow as pa
import pytest

from sparkmem.llm import pieces as P
from sparkmem.llm import quality as Q
from sparkmem.llm import vectors as V
from sparkmem.llm.common import utf8
from sparkmem.llm.queries import QUERIES, tokenizer_path
from tests.conftest import SF001
from tests.llm.test_first_ops import ODD, brute_components

MODEL = "piece_bpe_32k.model"


def brute_links(ids, vecs, threshold):
    linked = []
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for v in vecs]
    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]):
                a, b = np.array(vecs[i], float), np.array(vecs[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    linked.append((ids[i], ids[j]))
    return linked


@pytest.mark.parametrize("cell,block,threshold", [(4096, 2048, 0.9), (20, 8, 0.9), (20, 8, 0.5)])
def test_range_join_equals_brute_force(spark, monkeypatch, cell, block, threshold):
    monkeypatch.setattr(V, "CELL_ROWS", cell)
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    vecs = [*base, *(base[:20] + rng.normal(0, 0.1, (20, 8))), *(base[0] + rng.normal(0, 0.2, (60, 8))), *base[:5], base[0] * 3]
    vecs = [[float(x) for x in v] for v in vecs] + [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7,
                                                    [None] + [1.0] * 7, [1.0, 0.0], [2.0, 0.0], [-0.0, 0.0]]
    ids = [int(i) for i in rng.permutation(len(vecs))]
    df = spark.createDataFrame(list(zip(ids, vecs)), "id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in V.near_duplicates(df, threshold).collect()}
    linked = brute_links(ids, vecs, threshold)
    comp = brute_components(ids, linked)
    n = {i: sum(i in p for p in linked) for i in ids}
    assert got == {i: (n[i], comp[i]) for i in ids}


def test_range_join_null_and_large_ids(spark):
    """A null id beside ids above 2^53: links and ids stay as they are."""
    big = 2 ** 60
    rows = [(big + 1, [1.0, 0.0]), (big + 2, [1.0, 0.01]), (big + 3, [1.0, 0.02]), (None, [0.0, 1.0]), (7, [0.01, 1.0]), (None, [-1.0, 0.0]), (None, None)]
    got = V.near_duplicates(spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)).collect()
    key = sorted(((r.id, r.n_links, r.component_id) for r in got), key=str)
    assert key == sorted([(big + 1, 2, big + 1), (big + 2, 2, big + 1), (big + 3, 2, big + 1), (None, 1, 7), (7, 1, 7), (None, 0, None), (None, 0, None)], key=str)


def test_range_join_stores_each_vector_once(spark, monkeypatch):
    """vectors without structure were copied to every cell above their own, and each pair of blocks was shuffled with both matrices."""
    monkeypatch.setattr(V, "CELL_ROWS", 20)
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    for name, value in (("SORTED_AT_ONCE", 1024), ("SIDE_BYTES", 16 << 10), ("LEAST_SIDE", 4 << 10), ("TURN_BYTES", 1 << 16)):
        monkeypatch.setattr(V.I, name, value)
    kept, freed, old = [], [], V.I.build_index
    monkeypatch.setattr(V.I, "build_index", lambda *a, **b: kept.append(old(*a, **b)) or kept[-1])
    monkeypatch.setattr(V.I, "free_disk", lambda spark, *folders: freed.append(folders))
    vecs = np.random.default_rng(8).normal(size=(400, 32)).astype(np.float32)
    vecs[300:350] = vecs[:50] * 2
    vecs[350:] = vecs[:50] + 0.1
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, embedding array<float>")
    got = {r.id: (r.n_links, r.component_id) for r in V.near_duplicates(df, 0.9).collect()}
    linked = brute_links(list(range(400)), [v.astype(float) for v in vecs], 0.9)
    comp = brute_components(list(range(400)), linked)
    assert got == {i: (sum(i in p for p in linked), comp[i]) for i in range(400)} and len(linked) >= 100
    (index,) = kept
    assert index.n_rows == 350 and index.width == 4 and len(freed) > 2
    assert index.blocks.selectExpr("sum(octet_length(mat))").first()[0] == 350 * 32 * 4


def test_null_id_is_held_out_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (4,)], "doc_id long").select(Q.held_out("doc_id", 1).alias("h")).collect()
    assert [r.h for r in rows] == [False, True]


def test_range_join_empty(spark):
    assert V.near_duplicates(spark.createDataFrame([], "id long, embedding array<float>")).count() == 0


def test_quality_on_held_out_rows(spark):
    out = QUERIES["op8_quality"](spark, SF001)
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and all(0 <= r.score <= 1 for r in rows)
    right = sum(r.predicted == r.quality for r in held)
    assert right / len(held) >= 0.95
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) >= 0.98


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(ODD)], "id long, text string, n_chars long, score int")
    assert {r.score for r in Q.score(docs.drop("score"), None).collect()} == {0.5}
    labels = spark.createDataFrame([(0, 1.0), (3, 0.0), (3, 1.0), (7, None), (6, 0.0)], "id long, label double")
    model = Q.train(docs, labels)
    out = {r.id: r.score for r in Q.score(docs, model).collect()}
    assert len(out) == len(ODD) and all(0 <= s <= 1 for s in out.values())
    assert Q.score(docs.limit(0), model).count() == 0
    assert Q.train(docs, labels.limit(0)) is None


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    d = Q.BUCKETS + Q.STATS
    m = Q.Machine(0.3, rng.normal(size=d), rng.normal(size=(d, Q.RANK)), 0, 1)
    f, x = np.array([3, 9, 77, 500]), np.array([0.5, -1.0, 2.0, 0.1])
    want = 0.3 + m.w[f] @ x + sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(m.margin(1, np.zeros(4, int), f, x)[0][0], want)


def odd_texts():
    rng = np.random.default_rng(0)
    al = list("abcdethe  \n.,'汉é1") + ["the", " and", "ing", "tion", "    "]
    return ([t or "" for t in ODD] + ["a", "  ", "   x", "x   ", "     \n  y", "▁▁ x", " " * 50, " " * 17 + "a", " 漢", "   漢", "\U0001f600", "é" * 40]
            + ["".join(rng.choice(al, int(n))) for n in rng.integers(1, 200, 300)])


def test_bpe_ids_equal_the_library():
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    m = P.Model(tokenizer_path(MODEL))
    assert m.kind == "bpe"
    texts = odd_texts()
    off, data = utf8(pa.array(texts))
    ids, at = m.encode(off, data)
    want = lib.encode(texts)
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == want
    bo, bd = m.decode(ids, at)
    assert [bd[a:z].tobytes().decode() for a, z in zip(bo[:-1], bo[1:])] == [lib.decode(w) for w in want]


def test_unigram_path_is_the_best_of_all():
    """The same pieces read as a unigram model: the sum of scores of the path is the best that exists."""
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    m = P.Model(tokenizer_path(MODEL), kind="unigram")
    score = {lib.id_to_piece(i): lib.get_score(i) for i in range(3, lib.get_piece_size()) if not lib.is_byte(i)}
    texts = ["the end of it", "hello world", "interesting tion", "aéb", "x"]
    off, data = utf8(pa.array(texts))
    ids, at = m.encode(off, data)
    for t, a, z in zip(texts, at[:-1], at[1:]):
        s = "▁" + t.replace(" ", "▁")
        best = [0.0] + [-np.inf] * len(s)
        for i in range(1, len(s) + 1):
            best[i] = max(best[j] + score[s[j:i]] for j in range(max(0, i - 16), i) if s[j:i] in score)
        assert np.isclose(sum(m.score[i] for i in ids[a:z]), best[-1]), t
        assert "".join(lib.id_to_piece(int(i)) for i in ids[a:z]) == s


def test_pieces_query(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(ODD)], "id long, text string, piece_ids string")
    enc = P.encode(docs, tokenizer_path(MODEL))
    back = {r.id: r.text for r in P.decode(enc, tokenizer_path(MODEL)).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert all(r.round_trip for r in P.encode_checked(docs, tokenizer_path(MODEL)).collect())
    assert P.encode(docs.limit(0), tokenizer_path(MODEL)).count() == 0
