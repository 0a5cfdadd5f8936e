"""Label codings: decode, encode, resolve, stratification key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions.text import lookup


def decode(code: Column, mapping: Mapping[int, str], on_unknown: str = "null") -> Column:
    """Integer code to label name. Unknown codes: ``null``, ``raise``, or any other text as the label."""
    name = lookup(code, mapping)
    if on_unknown == "null":
        return name
    if on_unknown == "raise":
        message = F.concat(F.lit("unknown label code: "), F.coalesce(code.cast("string"), F.lit("null")))
        return F.coalesce(name, F.raise_error(message).cast("string"))
    return F.coalesce(name, F.lit(on_unknown))


def encode_expr(name: Column, names: Sequence[str]) -> Column:
    return lookup(name, {n: i for i, n in enumerate(names)})


def unmapped(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """(label, n) of every label outside ``names``; a missing one reads ``nan``."""
    known = F.coalesce(F.col(col).isin(*names), F.lit(False))
    label = F.coalesce(F.col(col).cast("string"), F.lit("nan")).alias("label")
    return df.filter(~known).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def encode(df: DataFrame, col: str, names: Sequence[str], show: int = 100) -> DataFrame:
    """Label names to ids; fails if :func:`unmapped` has rows, whose first ``show`` the error names."""
    bad = unmapped(df, col, names).orderBy("label").limit(show + 1).collect()
    if bad:
        more = ", and others" if len(bad) > show else ""
        raise ValueError("labels outside the task: " + ", ".join(r["label"] for r in bad[:show]) + more)
    return df.withColumn(col, encode_expr(F.col(col), names).cast("int"))


def resolve(value: Column, names: Sequence[str]) -> Column:
    """A known label name stays; anything else is read as an index into ``names``."""
    text = value.cast("string")
    by_index = F.get(F.array(*[F.lit(n) for n in names]), text.cast("int"))
    return F.when(text.isin(*names), text).otherwise(by_index)


def stratum_key(*cols: Column) -> Column:
    """``lang__label`` key; a missing part reads ``nan``."""
    return F.concat_ws("__", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in cols])
