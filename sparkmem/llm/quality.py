"""Operator 8, quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The pairwise interactions cost time linear in the non-zero features by the sum-of-squares identity in
brackets. Features: words hashed to ``BUCKETS`` (log counts, scaled to length one per text), statistics of
the whole text (shares of upper case, digits, marks, other bytes, lines, repeated and distinct words, lengths) and
the declared length (``n_chars``) against the counted one. The model is fitted in one task on a bounded sample of
labelled rows (``SAMPLE_ROWS``, chosen by a hash of the id) by AdaGrad; its size is fixed, so every task of
the scoring pass carries it. Scoring reads whole texts.

Nulls and odd input: a null text scores like an empty one; a null ``n_chars`` counts as the counted length; a row
without label is never learned from; rows labelled twice count with the mean label; repeated rows give repeated
results; with no labelled row every score is 0.5; an empty table gives an empty result; extra columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, lean, lower_ascii, row_slices, span_hash, utf8, words, written

BUCKETS = 1 << 14
RANK = 8
SAMPLE_ROWS = 6000         # most labelled rows to learn from
EPOCHS = 12
LEAST_VISITS = 24_000      # texts visited at least, over all epochs: a small sample gets more of them
STATS = 13

_UPPER, _DIGIT, _SPACE, _LINE, _MARK, _HIGH = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LINE[10] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?-()"]] = True
_HIGH[128:] = True


def features(offsets: np.ndarray, data: np.ndarray, n_chars: np.ndarray):
    """(row, feature, value) of the hashed words and the dense statistics (rows x STATS) of each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask[data])])
        return np.diff(c[offsets]) / some

    low = lower_ascii(data)
    start, end, row = words(offsets, low)
    h = span_hash(low, start, end)
    feat = (h % np.uint64(BUCKETS)).astype(np.int64)
    count = np.bincount(row, minlength=n)
    key, times = np.unique(row * BUCKETS + feat, return_counts=True)
    r, f = key // BUCKETS, key % BUCKETS
    val = np.log1p(times)
    norm = np.sqrt(np.bincount(r, val * val, minlength=n))
    val = val / norm[r] if len(r) else val
    per_word = np.maximum(count, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    single = (end - start == 1) & (_MARK[low[start]] if len(start) else np.zeros(0, bool))
    top = np.zeros(n)
    np.maximum.at(top, r, times)
    cont = (data & 0xC0) == 0x80
    chars = size - np.diff(np.concatenate([[0], np.cumsum(cont)])[offsets])
    declared = np.where(np.isnan(n_chars), chars, n_chars)
    dense = np.stack([
        share(_UPPER), share(_DIGIT), share(_MARK), share(_HIGH), share(_SPACE), share(_LINE),
        np.bincount(row, again, minlength=n) / per_word, np.bincount(r, minlength=n) / per_word, top / per_word,
        np.bincount(row, single, minlength=n) / per_word, np.minimum(np.log1p(size / per_word), 6.0),
        np.log1p(count), np.minimum(np.abs(np.log1p(declared) - np.log1p(chars)), 10.0)], axis=1)
    return r, f, val, dense


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, data = utf8(b.column(0))
        chars = b.column(1).to_numpy(zero_copy_only=False).astype(float)
        for lo, hi in row_slices(off):
            r, f, v, dense = features(off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]], chars[lo:hi])
            cut = np.searchsorted(r, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(2).slice(lo, hi - lo), pa.array([f[x:z].astype("<u2").tobytes() for x, z in zip(cut[:-1], cut[1:])]),
                 pa.array([v[x:z].astype("<f4").tobytes() for x, z in zip(cut[:-1], cut[1:])]),
                 pa.array([d.astype("<f4").tobytes() for d in dense])], ["label", "f", "v", "s"])


class Machine:
    """Parameters and scoring; features BUCKETS.. are the standardised statistics."""

    def __init__(self, w0, w, v, mean, std):
        self.w0, self.w, self.v, self.mean, self.std = w0, w, v, mean, std

    def margin(self, n: int, r, f, x) -> tuple[np.ndarray, np.ndarray]:
        """Margins and the factor sums (n x RANK)."""
        lin = np.bincount(r, self.w[f] * x, minlength=n)
        vx = self.v[f] * x[:, None]
        s = np.stack([np.bincount(r, vx[:, k], minlength=n) for k in range(vx.shape[1])], axis=1)
        sq = np.bincount(r, (vx * vx).sum(axis=1), minlength=n)
        return self.w0 + lin + 0.5 * ((s * s).sum(axis=1) - sq), s

    def with_stats(self, r, f, x, dense):
        """Append the standardised statistics as features."""
        n = len(dense)
        z = np.clip((dense - self.mean) / self.std, -5, 5)
        rr = np.repeat(np.arange(n), STATS)
        ff = np.tile(np.arange(STATS) + BUCKETS, n)
        return np.concatenate([r, rr]), np.concatenate([f, ff]), np.concatenate([x, z.ravel() / np.sqrt(STATS)])

    def score(self, r, f, x, dense) -> np.ndarray:
        n = len(dense)
        m, _ = self.margin(n, *self.with_stats(r, f, x, dense))
        return 1.0 / (1.0 + np.exp(-np.clip(m, -35, 35)))


def fit(label: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss; rows: (features, values, statistics) of each text."""
    rng = np.random.default_rng(seed)
    dense = np.array([s for _, _, s in rows], np.float64)
    d = BUCKETS + STATS
    m = Machine(0.0, np.zeros(d), rng.normal(0, 0.05, (d, RANK)), dense.mean(axis=0), dense.std(axis=0) + 1e-3)
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    m.w0 = float(np.log(share / (1 - share)))
    gw, gv, g0 = np.full(d, 1e-2), np.full((d, RANK), 1e-2), 1e-2
    rate, decay, batch = 0.15, 1e-5, 64
    for _ in range(max(EPOCHS, -(-LEAST_VISITS // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            some = order[lo:lo + batch]
            n = len(some)
            size = [len(rows[i][0]) for i in some]
            r, f, x = m.with_stats(np.repeat(np.arange(n), size), np.concatenate([rows[i][0] for i in some]).astype(np.int64),
                                   np.concatenate([rows[i][1] for i in some]).astype(np.float64), dense[some])
            z, s = m.margin(n, r, f, x)
            g = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))) - label[some]
            gx = g[r] * x
            uf, inv = np.unique(f, return_inverse=True)
            dw = np.bincount(inv, gx) / n + decay * m.w[uf]
            pair = s[r] - m.v[f] * x[:, None]
            dv = np.stack([np.bincount(inv, gx * pair[:, k]) for k in range(RANK)], axis=1) / n + decay * m.v[uf]
            gw[uf] += dw * dw
            gv[uf] += dv * dv
            m.w[uf] -= rate * dw / np.sqrt(gw[uf])
            m.v[uf] -= rate * dv / np.sqrt(gv[uf])
            d0 = g.mean()
            g0 += d0 * d0
            m.w0 -= rate * d0 / np.sqrt(g0)
    return m


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    label, rows = [], []
    for b in batches:
        label += b.column(0).to_pylist()
        rows += [(np.frombuffer(f, "<u2"), np.frombuffer(v, "<f4"), np.frombuffer(s, "<f4"))
                 for f, v, s in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
    if rows:
        m = fit(np.array(label, np.float64), rows)
        packed = np.concatenate([[m.w0], m.w, m.v.ravel(), m.mean, m.std]).astype("<f8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["model"])


def _unpack(packed: bytes) -> Machine:
    a = np.frombuffer(packed, "<f8")
    d = BUCKETS + STATS
    cut = np.cumsum([1, d, d * RANK, STATS])
    return Machine(a[0], a[1:cut[1]], a[cut[1]:cut[2]].reshape(d, RANK), a[cut[2]:cut[3]], a[cut[3]:])


def held_out(doc_id: str, folds: int) -> Column:
    """Whether crc32 of the id as text is a multiple of ``folds``; a null id is held out of nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes | None:
    """Fitted model from docs (id, text, n_chars) and labels (id, label); None without a labelled row."""
    arrow_conf(docs.sparkSession)
    chosen = (labels.where(F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.avg("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    # at most sample_rows ids of 16 bytes: small whatever the corpus
    rows = (docs.join(F.broadcast(chosen), "id").select("text", F.col("n_chars").cast("double"), "label")
            .mapInArrow(_feature_batches, "label double, f binary, v binary, s binary"))
    model = written(rows.orderBy(F.xxhash64("f", "s"), "label").coalesce(1).mapInArrow(_fit_batches, "model binary"), "quality-model").first()
    return None if model is None else bytes(model[0])


def score(docs: DataFrame, model: bytes | None) -> DataFrame:
    """(id, score) of docs (id, text, n_chars)."""
    arrow_conf(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if model is None else _unpack(model)
        for b in batches:
            off, data = utf8(b.column(1))
            chars = b.column(2).to_numpy(zero_copy_only=False).astype(float)
            for lo, hi in row_slices(off):
                if m is None:
                    s = np.full(hi - lo, 0.5)
                else:
                    s = m.score(*features(off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]], chars[lo:hi]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s)], ["id", "score"])

    return docs.select("id", "text", F.col("n_chars").cast("double").alias("n_chars")).mapInArrow(lean(run), "id long, score double")
