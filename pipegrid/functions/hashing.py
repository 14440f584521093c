"""Random numbers as a pure function of (salt, row key).

The same row gets the same number whatever the partitioning, executor or retry, and
any SQL engine with md5 gets it too.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def hash_bits(salt: str, key: Column, salt_column: Column | None = None) -> Column:
    """The first 32 bits of md5(salt || key), as BIGINT in [0, 2^32)."""
    head = F.lit(salt) if salt_column is None else F.concat(F.lit(salt), salt_column)
    digest = F.md5(F.concat(head, key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(salt: str, key: Column, salt_column: Column | None = None) -> Column:
    """Uniform in [0, 1)."""
    return hash_bits(salt, key, salt_column).cast("double") / F.lit(TWO32)


def hash_normal(salt: str, key: Column, salt_column: Column | None = None) -> Column:
    """Standard normal by Box-Muller from two independent uniforms."""
    u1 = hash_uniform(salt + "a:", key, salt_column)
    u2 = hash_uniform(salt + "b:", key, salt_column)
    # 1 - u1 lies in (0, 1], so the logarithm is finite
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def local_uniform(salt: str, key) -> float:
    """The driver-side twin of :func:`hash_uniform`, for model parameters."""
    return int(hashlib.md5(f"{salt}{key}".encode()).hexdigest()[:8], 16) / TWO32


def local_normal(salt: str, key) -> float:
    u1 = local_uniform(salt + "a:", key)
    u2 = local_uniform(salt + "b:", key)
    return math.sqrt(-2.0 * math.log(1.0 - u1)) * math.cos(2.0 * math.pi * u2)
