"""Seeded md5 keys: a deterministic stand-in for random draws, the same in every SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: Column | str | int) -> Column:
    """md5 hex of the parts joined with ``|``; Python values are taken as literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_int(key: Column) -> Column:
    """First 32 bits of an md5 hex key as a non-negative BIGINT."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def hash_unit(key: Column) -> Column:
    """Key mapped to [0, 1)."""
    return hash_int(key) / F.lit(4294967296.0)
