"""Seeded row hashes that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_BITS = 32


def key_hash(df: DataFrame, keys: list[str], seed: int = 42) -> Column:
    """A 32-bit hash of the key columns as a non-negative LONG.

    Integer keys are hashed by MD5 of their decimal text, which other engines can
    reproduce; other keys by xxhash64, since engines print doubles differently.
    """
    types = [df.schema[k].dataType for k in keys]
    if all(isinstance(t, T.IntegralType) for t in types):
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
        text = F.concat_ws("|", F.lit(str(seed)), *parts)
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), 64 - HASH_BITS)
