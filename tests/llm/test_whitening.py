"""Operator 13 against a dense eigendecomposition."""
import numpy as np
import pytest

from sparkmem.llm import whitening as W
from sparkmem.llm.queries import QUERIES
from tests.conftest import SF001

SCHEMA = "id long, embedding array<float>, whitened int"


def brute(vecs):
    x = np.floor(np.array(vecs, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return x, n, s, values[::-1], axes[:, ::-1]


def test_query_equals_eigh(spark):
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, n, s, values, axes = brute([r.embedding for r in rows])
    got = QUERIES["op13_whitening"](spark, SF001).toPandas().pivot(index="vec_id", columns="component")
    got = got.loc[[r.vec_id for r in rows]]
    want = (x - s / n) @ axes[:, :8] / np.sqrt(values[:8])
    have = got["whitened"].to_numpy()
    sign = np.sign((want * have).sum(0))
    assert np.abs(want * sign - have).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy()[0], values[:8] / values.sum(), rtol=1e-10)
    assert (got["deviation"].to_numpy()[:, 0] == ((n * x - s) ** 2).sum(1)).all() and (got["n"].to_numpy() == n).all()
    error = np.unique(got["identity_error"].to_numpy())
    assert len(error) == 1 and error[0] < 1e-10


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    vecs = [[float(v) for v in np.float32(r)] for r in rng.normal(size=(40, 5)) * [3, 1, 1, 0.1, 0]]
    rows = [(2 ** 60 + i, v, 1) for i, v in enumerate(vecs)] + [(2 ** 60, vecs[0], 1), (None, vecs[1], 1)]      # a repeated row, a null id
    odd = [(1, None, 1), (2, [], 1), (3, [None] + [1.0] * 4, 1), (4, [float("nan")] * 5, 1), (5, [float("inf")] + [0.0] * 4, 1), (6, [3e38] * 5, 1),
           (8, [1.0, 2.0], 1), (9, [2.0, 1.0], 1), (10, [7.0], 1), (11, [1.0] * 3, 1), (12, [1.0] * 3, 1)]
    got = W.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(3)).collect()
    assert {r.id for r in got} == {i for i, _, _ in rows} | {8, 9}
    x, n, s, values, axes = brute([v for _, v, _ in rows])
    five = [r for r in got if r.id is None or r.id > 100]
    assert n == 42 and all(r.n == 42 for r in five) and max(r.component for r in five) == 4         # the fifth dimension never varies
    want = (x - s / n) @ axes[:, :4] / np.sqrt(values[:4])
    for i, (vec_id, _, _) in enumerate(rows[:40]):
        mine = sorted((r.component, r.whitened) for r in five if r.id == vec_id)
        assert np.allclose(np.abs([w for _, w in mine[::2 if i == 0 else 1]]), np.abs(want[i]), atol=1e-9)
    two = [r for r in got if r.id in (8, 9)]
    assert len(two) == 2 and {round(r.whitened, 9) for r in two} == {1.0, -1.0} and all(r.explained == pytest.approx(1) for r in two)


def test_empty_table(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_deviation_beyond_doubles():
    x = np.array([[0, 2 ** 30], [2 ** 31 + 1, 5]])
    fit = W.Whitening(2, x.sum(0), np.zeros(0), np.zeros((2, 0)), 0.0)
    want = [sum((2 * int(v) - int(t)) ** 2 for v, t in zip(r, x.sum(0))) for r in x]
    assert W._exact_deviation(fit, x).to_pylist() == [v if v < 2 ** 63 else None for v in want]


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (7, 7), (24, 24), (24, 5), (9, 0)])
def test_cholesky_and_jacobi(d, rank):
    rng = np.random.default_rng(d + rank)
    f = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
    a = f @ f.T
    factor = W.pivoted_cholesky(a)
    assert factor.shape[1] <= max(rank, 1) if rank < d else factor.shape[1] <= d
    assert np.allclose(factor @ factor.T, a, atol=1e-13 * max(1, np.abs(a).max()))
    pivots = [int(np.flatnonzero(np.abs(factor[:, k]) == np.abs(factor[:, k]).max())[0]) for k in range(factor.shape[1])]
    for k, p in enumerate(pivots):
        assert (factor[p, k + 1:] == 0).all()                     # triangular in the order of the pivots
    values, vectors = W.eigen(a)
    want = np.linalg.eigvalsh(a)[::-1][:len(values)]
    assert len(values) == rank and np.allclose(values, want, rtol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * max(1, values[0] if rank else 1))


def test_small_eigenvalues_keep_their_digits():
    """Graded scales: eigenvalues over twelve orders of magnitude come out to relative precision."""
    scale = np.logspace(0, -5, 6)
    c = np.eye(6) + 0.1 * np.ones((6, 6))
    a = scale[:, None] * c * scale
    g = W.one_sided_jacobi(W.pivoted_cholesky(a))
    values = np.sort((g * g).sum(0))[::-1]
    assert np.prod(values / scale ** 2) == pytest.approx(np.linalg.det(c), rel=1e-12)
