"""Reproducible randomness: every draw is a hash of (seed, key columns), never ``rand()``.

The same row gets the same draw on any cluster layout, after a retry, and in any SQL engine with md5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def uniform(seed: str, *keys) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of md5(seed|key|...)."""
    text = F.concat_ws("|", F.lit(seed), *[_c(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_between(low, high, seed: str, *keys) -> Column:
    return F.lit(low) + (F.lit(high) - F.lit(low)) * uniform(seed, *keys)


def uniform_int(low: int, high: int, seed: str, *keys) -> Column:
    """Integer in [low, high], both ends included."""
    return (F.lit(low) + F.floor(uniform(seed, *keys) * F.lit(high - low + 1))).cast("bigint")


def gaussian(seed: str, *keys) -> Column:
    """Standard normal by Box-Muller on two independent uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed + "/r", *keys)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed + "/a", *keys))


def content_seed(labels: Column, salt: str = "") -> Column:
    """Seed derived from the ordered label content of a patch (SHA-256 reduced to 32 bits)."""
    text = F.concat(F.array_join(labels.cast("array<string>"), ","), F.lit(salt))
    return F.conv(F.substring(F.sha2(text, 256), 57, 8), 16, 10).cast("bigint")


def _c(k) -> Column:
    return F.col(k) if isinstance(k, str) else k
