"""Reproducible pseudo-random draws and feature hashes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_word(digest: Column, position: int = 0) -> Column:
    """The ``position``-th 32-bit word of a hexadecimal digest, as a non-negative BIGINT."""
    return F.conv(F.substring(digest, 1 + 8 * position, 8), 16, 10).cast("bigint")


def keyed_digest(*parts) -> Column:
    """md5 over the parts joined by colons; equal keys give equal draws on every engine."""
    return F.md5(F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def draw_index(n_rows: int, *parts) -> Column:
    """A uniform row number in ``0..n_rows-1``, keyed by ``parts``.

    Two words make 62 bits for every size of table, so all rows are reachable and equally likely.
    """
    digest = keyed_digest(*parts)
    wide = hex_word(digest, 0) * F.lit(2**30).cast("bigint") + hex_word(digest, 1) % F.lit(2**30).cast("bigint")
    return wide % F.lit(n_rows).cast("bigint")


def unit(*parts) -> Column:
    """A uniform number in [0, 1) of 32 bits, keyed by ``parts``."""
    return hex_word(keyed_digest(*parts)).cast("double") / F.lit(4294967296.0)


def poisson_steps(mean: float) -> list[float]:
    """Distribution function of a Poisson variable at 0, 1, 2, ... up to where 32 bits end."""
    steps, total, k = [], 0.0, 0
    while k <= mean or 1.0 - total > 2.0**-33:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        if steps and total == steps[-1] and k > mean:
            break
        steps.append(total)
        k += 1
    return steps


def poisson(mean: float, *parts) -> Column:
    """A Poisson draw keyed by ``parts``: how many steps of the distribution function lie at or below a uniform number."""
    u = unit(*parts)
    return F.size(F.filter(F.array(*[F.lit(step) for step in poisson_steps(mean)]), lambda step: step <= u))


def gaussian(*parts, scale: float = 0.01) -> Column:
    """A normal draw with standard deviation ``scale``, keyed by ``parts`` (Box-Muller on two digest words)."""
    digest = keyed_digest(*parts)
    uniforms = [(hex_word(digest, p).cast("double") + 1.0) / F.lit(4294967297.0) for p in (0, 1)]
    radius = F.sqrt(F.lit(-2.0) * F.log(uniforms[0]))
    return F.lit(scale) * radius * F.cos(F.lit(2.0 * math.pi) * uniforms[1])


def hash_word(token: Column, method: str = "md5") -> Column:
    """The hash of a string before its sign is taken: 32 bits of md5 as a non-negative BIGINT, or 64 bits of xxhash64."""
    if method == "md5":
        return hex_word(F.md5(token))
    if method == "xxhash64":
        return F.xxhash64(token)
    raise ValueError(f"unknown hash method {method!r}")


def signed_word(word: Column, method: str = "md5") -> Column:
    """The signed hash of a :func:`hash_word`."""
    return F.when(word >= 2**31, word - F.lit(2**32)).otherwise(word) if method == "md5" else word


def signed_hash(token: Column, method: str = "md5") -> Column:
    """A signed integer hash of a string as BIGINT: 32 bits from md5, or 64 bits from xxhash64."""
    return signed_word(hash_word(token, method), method)


def hash_bucket(hashed: Column, n_buckets: int) -> Column:
    """Bucket in ``0..n_buckets-1``; the remainder is taken before the sign, so no value overflows."""
    return F.abs(hashed % F.lit(n_buckets).cast("bigint")).cast("int")


def hash_sign(hashed: Column) -> Column:
    return F.when(hashed >= 0, 1).otherwise(-1)
