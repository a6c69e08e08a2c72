"""Deterministic provider arithmetic.

* ``add_hash_embedding``: the SHA-256 digest of the UTF-8 text, its 32 bytes
  repeated to ``dim`` values, each mapped to ``(b - 128) / 128`` and divided by
  (L2 norm + 1e-8). The digest is taken in the JVM; an Arrow-batched UDF
  spreads it (one numpy pass per batch), because the 256-element expression tree is too large for
  whole-stage codegen.
* ``seed_mod900`` / ``add_seed``: the 256-bit integer of
  ``sha256(system + "|" + prompt)`` reduced modulo 900 in Catalyst, folding
  eight 32-bit chunks with ``acc * (2**32 mod 900)``. 900 is divisible by 100,
  9 and 15, so every selector the deterministic generator needs
  (``seed % 100``, ``seed % 3``, ``(seed // 3) % 3``, ``(seed // 5) % 3``) is a
  function of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COSINE_EPS, SEED_MODULUS

_TWO32_MOD = (1 << 32) % SEED_MODULUS  # 796


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_hex(text) -> Column:
    return F.sha2(_c(text), 256)


def digest_vectors(digests: np.ndarray, dim: int) -> np.ndarray:
    """(n, dim) float32 matrix of deterministic embeddings of 32-byte digests (n, 32)."""
    vals = (digests.astype(np.float64) - 128.0) / 128.0
    reps, rem = divmod(dim, 32)
    full = np.tile(vals, (1, reps + (1 if rem else 0)))[:, :dim]
    norm = np.sqrt((full * full).sum(axis=1)) + COSINE_EPS
    return (full / norm[:, None]).astype(np.float32)


def _embed_udf(dim: int):
    @F.arrow_udf("array<float>")
    def embed(digests: pa.Array) -> pa.Array:
        n = len(digests)
        mask = digests.is_null()
        raw = np.frombuffer(b"".join(digests.fill_null(bytes(32)).to_pylist()), np.uint8).reshape(n, 32)
        offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(digest_vectors(raw, dim).reshape(-1)), mask=mask)
    return embed


def add_hash_embedding(df: DataFrame, text_col: str, out_col: str = "embedding",
                       dim: int = 256) -> DataFrame:
    """Add the deterministic embedding of ``text_col`` (null text gives null).

    The SHA-256 is taken in the JVM, so only 32 bytes per row reach Python; an
    Arrow-batched UDF spreads them to ``dim`` floats in one numpy pass and
    assembles the list array without per-row Python objects.
    """
    return df.withColumn(out_col, _embed_udf(dim)(F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))))


def seed_fold(h) -> Column:
    """``int(h, 16) % 900`` for a 64-hex-digit column ``h`` (eight 32-bit chunks)."""
    acc = F.lit(0).cast("long")
    for i in range(8):
        chunk = F.conv(F.substring(_c(h), 8 * i + 1, 8), 16, 10).cast("long")
        acc = (acc * F.lit(_TWO32_MOD) + chunk % F.lit(SEED_MODULUS)) % F.lit(SEED_MODULUS)
    return acc


def seed_mod900(system, prompt) -> Column:
    """``int(sha256(system + '|' + prompt).hexdigest(), 16) % 900`` as a long."""
    return seed_fold(sha256_hex(F.concat(_c(system), F.lit("|"), _c(prompt))))


def add_seed(df: DataFrame, system, prompt, out_col: str = "_m") -> DataFrame:
    """Add the seed as its own projection (the digest is computed once per row)."""
    df = df.withColumn("_sh", sha256_hex(F.concat(_c(system), F.lit("|"), _c(prompt))))
    return df.withColumn(out_col, seed_fold("_sh")).drop("_sh")
