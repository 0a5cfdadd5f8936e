"""Record contract checks: one array of violation codes per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions import vocab
from labelflow.functions.text import is_supported_language


def _codes(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules])
    )


def unit_interval(c: Column) -> Column:
    return c.between(0.0, 1.0) & ~F.isnan(c)


def request_violations(text: Column) -> Column:
    return _codes(
        ("text_too_short", F.length(text) >= 1),
        ("text_too_long", F.length(text) <= vocab.MAX_TEXT),
    )


def prediction_violations(sentiment: Column, confidence: Column) -> Column:
    return _codes(
        ("bad_sentiment", sentiment.isin(*vocab.SENTIMENTS)),
        ("bad_confidence", unit_interval(confidence)),
    )


def attribution_violations(tokens: Column, values: Column) -> Column:
    return _codes(("length_mismatch", F.size(tokens) == F.size(values)))


def language_violations(lang: Column) -> Column:
    return _codes(("unsupported_language", is_supported_language(lang)))


def split_valid(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``violations``)."""
    checked = df.withColumn("violations", violations)
    return (
        checked.filter(F.size("violations") == 0).drop("violations"),
        checked.filter(F.size("violations") > 0),
    )
