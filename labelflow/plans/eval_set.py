"""Evaluation set: test rows of each input, capped per language, plus fixed probe rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.operators.sampling import sample_per_group
from labelflow.sources.readers import select_split, union

# Hand-written Vietnamese irony probes.
IRONY_PROBES = (
    ("Ừ thì đúng là tuyệt vời lắm", "irony"),
    ("Dịch vụ siêu tốt, chờ 2 tiếng mới được phục vụ", "irony"),
    ("Chất lượng hoàn hảo, chỉ bị hỏng ngay ngày đầu tiên thôi", "irony"),
    ("Cảm ơn vì đã phục vụ rất chu đáo", "non_irony"),
    ("Sản phẩm tốt, đáng mua", "non_irony"),
    ("Thức ăn ngon, phục vụ nhiệt tình", "non_irony"),
)


def build_eval_set(
    inputs: Mapping[str, DataFrame], id_col: str, cap: int = 200, seed: int = 42
) -> DataFrame:
    """``inputs``: fallback language -> (id, text, label, source, optional lang and split)."""
    if not inputs:
        raise ValueError("no sentiment inputs for the evaluation set")
    parts = []
    for lang, df in inputs.items():
        rows = select_split(df, "test")
        if "lang" not in rows.columns:
            rows = rows.withColumn("lang", F.lit(lang))
        parts.append(rows.select(id_col, "text", "label", "lang", "source"))
    return sample_per_group(union(parts), "lang", cap, id_col, seed)


def irony_probes(
    spark: SparkSession, rows: Sequence[tuple[str, str]] = IRONY_PROBES
) -> DataFrame:
    return spark.createDataFrame(
        [(text, label, "vi", "manual_probe") for text, label in rows],
        "text string, label string, lang string, source string",
    )
