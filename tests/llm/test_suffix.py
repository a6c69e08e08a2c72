"""Operator 5 against brute force."""
import hashlib

import numpy as np
import pytest

from sparkmem.llm import suffix as S
from sparkmem.llm.queries import QUERIES
from tests.llm.test_first_ops import ODD

SF0001 = "/root/testdata/sf0.001"


def brute(rows):
    """rows: (id, text) in order of age."""
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            s = hashlib.blake2b(b[p:p + 100], digest_size=16).digest()
            if s in seen:
                gone[p:p + 100] = True
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(np.sum(gone & ~np.append(False, gone[:-1]))) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % S.COVER for a in S.COVER_SET for b in S.COVER_SET} == set(range(S.COVER))


def fixture_rows():
    rng = np.random.default_rng(8)
    word = ["".join(rng.choice(list("abcdeéö"), int(n))) for n in rng.integers(1, 8, 400)]
    para = [" ".join(rng.choice(word, 60)) for _ in range(12)]
    texts = list(ODD) + ["a" * 500, "ab" * 200, "a" * 99, "a" * 100, ("xyz" * 50) + para[0]]
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 5)):
            parts.append(para[rng.integers(0, 12)] if rng.random() < 0.5 else " ".join(rng.choice(word, int(rng.integers(5, 60)))))
        texts.append(" ".join(parts))
    texts += texts[30:60]
    line = "the very same line that stands in nearly every one of the documents of this little fixture table, again and again."
    texts = [t if t is None or i % 3 else t + "\n" + line + "\n" + t[:37] for i, t in enumerate(texts)]
    ids = rng.permutation(len(texts))
    return [(int(i), t) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("hot,block", [(1 << 20, 8 << 20), (0, 4000), (600, 4000)])
def test_equals_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    monkeypatch.setattr(S, "SORT_BYTES", 5000)
    rows = fixture_rows()
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_bytes_2 string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in S.deduplicate(df, "doc_id", "text", hot_bytes=hot).collect()}
    rows = sorted(rows)
    want = dict(zip([i for i, _ in rows], brute(rows)))
    assert got == want


def test_query_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op5_suffix_dedup"](spark, SF0001).collect()}
    assert got == dict(zip([i for i, _ in rows], brute(rows)))


def test_repeated_and_empty(spark):
    t = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 150))
    df = spark.createDataFrame([(1, t), (1, t), (None, t[:120]), (2, None)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in S.deduplicate(df, "doc_id", "text", with_text=True).collect()
                 if r.doc_id != 2)
    # the row without id comes first; of the equal rows the first keeps what it does not repeat
    assert out[0] == (0, 0, t[:120]) and sorted(x[1] for x in out[1:]) == [120, 150]
    assert [r.kept_text for r in S.deduplicate(df, "doc_id", "text", with_text=True).collect() if r.doc_id == 2] == [None]
    assert S.deduplicate(df.limit(0), "doc_id", "text").count() == 0


def test_the_earliest_of_equal_rows_is_the_same_in_any_order_of_arrival():
    """Equal rows in two blocks: each string keeps the one of the smaller block number, however the rows reach a bucket."""
    import pandas as pd
    import pyarrow as pa
    import zstandard
    z = zstandard.ZstdCompressor().compress
    rng = np.random.default_rng(4)
    text = np.frombuffer("".join(rng.choice(list("abcdefgh"), 600)).encode(), np.uint8)

    def sent(block, cut):
        data = np.concatenate([rng.integers(97, 105, cut).astype(np.uint8), text])
        offs = np.array([0, cut, len(data)])
        h = S._block_anchors(offs, data)
        code = np.packbits(np.stack([np.ones(len(h), np.uint8), np.zeros(len(h), np.uint8)])).tobytes()
        cols = [pa.array([block]), *(pa.array([z(x.tobytes())], pa.binary()) for x in (np.array([5, 5]), np.array([1, 2]), offs, data)),
                pa.array([[{"bucket": 0, "code": code}]])]
        batch = pa.RecordBatch.from_arrays(cols, ["block", "ids", "ties", "offs", "data", "codes"])
        return pa.Table.from_batches(list(S._send_contexts(1)(iter([batch])))).to_pandas()

    for tail in (0, 130):                       # 130: other bytes before the text, so contexts differ at its head
        rows = pd.concat([sent(7, tail), sent(9, tail)], ignore_index=True)
        rows = rows[rows["bucket"] == 0]
        for order in (rows, rows[::-1]):
            assert set(S._sort_bucket((0,), order.reset_index(drop=True))["block"]) == {9}


def test_a_phrase_in_every_row_gathers_in_no_bucket(spark, monkeypatch):
    """A fixed phrase between other words: its anchors have a context per row, far more than is sorted at once; they are dealt out."""
    rng = np.random.default_rng(8)
    phrase = "".join(rng.choice(list("abcdefgh"), 120))
    rows = [(i, "".join(rng.choice(list("ijklmnop"), 60)) + phrase + "".join(rng.choice(list("qrstuvwx"), 60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicate(df, "doc_id", "text", hot_bytes=20_000).collect()}
    assert got == dict(zip(range(400), brute(rows)))
    # the groups a bucket would sort: by anchor they hold most of the input, dealt out by string they stay small
    offs = np.cumsum([0, *[len(t) for _, t in rows]])
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    h, n, size = S._block_anchors(offs, data, weigh=True)
    assert size.max() > 40_000 and n[size.argmax()] == 400


def test_weights_count_different_contexts_once():
    rng = np.random.default_rng(9)
    text = np.frombuffer("".join(rng.choice(list("abcdefgh"), 400)).encode(), np.uint8)
    one = S._block_anchors(np.array([0, 400]), text, weigh=True)
    many = S._block_anchors(np.arange(21) * 400, np.tile(text, 20), weigh=True)
    assert (one[0] == many[0]).all() and (one[2] == many[2]).all() and (many[1] == 20 * one[1]).all()
