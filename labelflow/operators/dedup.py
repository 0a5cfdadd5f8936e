"""Keep-first duplicate removal."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_duplicates_first(
    df: DataFrame, keys: Mapping[str, Column] | list[str], order_col: str = "row_order"
) -> DataFrame:
    """One row per key, the one with the smallest ``order_col`` (unique); a null there is an error.

    An aggregate, not a ranking window: copies collapse on the map side, so a text that makes up a third
    of the table reaches its reducer as one row per task. Grouping is on the full key, hence exact; the
    leading 64-bit hash only keeps the sort from comparing long texts.
    """
    named = dict(keys) if isinstance(keys, Mapping) else {k: F.col(k) for k in keys}
    plain = [] if isinstance(keys, Mapping) else list(keys)
    payload = [c for c in df.columns if c not in plain]
    keyed = df.select("*", *[c.alias(f"__key_{n}") for n, c in named.items()])
    names = [f"__key_{n}" for n in named]
    missing = F.raise_error(F.lit(f"{order_col} must not be null")).cast(dict(df.dtypes)[order_col])
    order = F.coalesce(F.col(order_col), missing)
    first = keyed.groupBy(F.xxhash64(*names).alias("__hash"), *names).agg(
        F.min_by(F.struct(*payload), order).alias("__row")
    )
    out = {c: F.col(f"__row.{c}") for c in payload}
    out.update({c: F.col(f"__key_{c}") for c in plain})
    return first.select(*[out[c].alias(c) for c in df.columns])
