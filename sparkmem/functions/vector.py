"""Vector column expressions (cosine with ``+1e-8`` on each norm)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COSINE_EPS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    na = _c(norm_a) if norm_a is not None else l2norm(a)
    nb = _c(norm_b) if norm_b is not None else l2norm(b)
    return dot(a, b) / ((na + F.lit(COSINE_EPS)) * (nb + F.lit(COSINE_EPS)))


def has_vector(a) -> Column:
    """Usable for search: not null and not the empty list."""
    return _c(a).isNotNull() & (F.size(_c(a)) > 0)


def np_cosine_matrix(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Cosine matrix (rows of q against rows of m) in float64."""
    qn = np.sqrt((q * q).sum(axis=1)) + COSINE_EPS
    mn = np.sqrt((m * m).sum(axis=1)) + COSINE_EPS
    return (q @ m.T) / np.outer(qn, mn)
