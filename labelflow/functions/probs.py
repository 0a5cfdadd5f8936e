"""Probability vectors: softmax, arg-max, confidence, flags, JSON-safe numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelflow.functions.text import bind


def softmax(logits: Column) -> Column:
    def scaled(z: Column) -> Column:
        return F.transform(z, lambda x: F.exp(x - F.array_max(z)))

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(e, lambda x: x / t))

    return bind(logits, lambda z: bind(scaled(z), shares))


def argmax_index(probs: Column) -> Column:
    """Zero-based index of the first largest entry."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def argmax_label(probs: Column, names: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), argmax_index(probs))


def confidence(probs: Column, digits: int = 4) -> Column:
    """Largest probability, rounded half to even."""
    return F.bround(F.array_max(probs), digits)


def sarcasm_flag(probs: Column) -> Column:
    """Only the first two classes count, ties are not sarcasm."""
    return F.get(probs, F.lit(1)) > F.get(probs, F.lit(0))


def json_safe(value: Column) -> Column:
    """NaN and infinities become null."""
    number = value.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
