"""Sinks: CSV frames, JSON reports, the run log, and result exports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions import vocab


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "error") -> None:
    """Fixed column order, every field quoted, quotes doubled, missing values as empty fields."""
    (
        df.select(*columns)
        .write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("split",), mode: str = "error"
) -> None:
    """Parquet, laid out by split so later jobs read only the split they need."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; meant for one-row reports."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("report"))


def write_report(df: DataFrame, path: str, mode: str = "error") -> None:
    report_json(df).write.mode(mode).text(path)


RUN_LOG = (
    "experiment string, run_id string, kind string, key string, value_str string, "
    "value_num double, logged_at timestamp"
)


def run_log_rows(
    spark: SparkSession,
    experiment: str,
    run_id: str,
    metrics: Mapping[str, float] | None = None,
    params: Mapping[str, object] | None = None,
    tags: Mapping[str, object] | None = None,
) -> DataFrame:
    """Driver-side values of one run as log rows; given tags must include all required ones."""
    if tags is not None:
        missing = sorted(set(vocab.RUN_TAGS) - set(tags))
        if missing:
            raise ValueError(f"missing run tags: {missing}")
    rows = [("metric", k, None, float(v)) for k, v in (metrics or {}).items()]
    rows += [("param", k, str(v), None) for k, v in (params or {}).items()]
    rows += [("tag", k, str(v), None) for k, v in (tags or {}).items()]
    df = spark.createDataFrame(rows, "kind string, key string, value_str string, value_num double")
    return _log_shape(df, experiment, run_id)


def metric_log_rows(metrics: DataFrame, experiment: str, run_id: str) -> DataFrame:
    """A (metric, value) frame as log rows, without passing through the driver."""
    return _log_shape(
        metrics.select(
            F.lit("metric").alias("kind"),
            F.col("metric").alias("key"),
            F.lit(None).cast("string").alias("value_str"),
            F.col("value").cast("double").alias("value_num"),
        ),
        experiment,
        run_id,
    )


def _log_shape(df: DataFrame, experiment: str, run_id: str) -> DataFrame:
    return df.select(
        F.lit(experiment).cast("string").alias("experiment"),
        F.lit(run_id).cast("string").alias("run_id"),
        "kind",
        "key",
        "value_str",
        "value_num",
        F.current_timestamp().alias("logged_at"),
    )


COMMITS = "experiment string, run_id string, attempt string, logged_at timestamp"


def append_run_log(rows: DataFrame, path: str) -> None:
    """Adds the rows of one or more runs; a run that is written again replaces its own rows, if repeated in full.

    The rows go under a new attempt first; then one commit record per run names it. Readers see a run's rows only
    through its last commit record, so they find the old rows or the new ones, never both or a part: a job that dies
    before its record leaves nothing visible. The values of one run (parameters, metrics, tags) belong in one call.
    """
    attempt = uuid.uuid4().hex
    stamped = rows.select(*[c for c in rows.columns if c != "attempt"], F.lit(attempt).alias("attempt"))
    stamped.write.mode("append").partitionBy("experiment", "attempt").parquet(f"{path}/rows")
    # read back, so that the record covers what was written even if ``rows`` is not the same when computed again
    spark = rows.sparkSession
    written = spark.read.schema(RUN_LOG + ", attempt string").parquet(f"{path}/rows").filter(F.col("attempt") == attempt)
    runs = written.select("experiment", "run_id", "attempt").distinct().withColumn("logged_at", F.current_timestamp())
    runs.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _last_commits(spark: SparkSession, path: str) -> DataFrame:
    commits = spark.read.schema(COMMITS).parquet(f"{path}/commits")
    last = F.max(F.struct("logged_at", "attempt"))["attempt"]
    return commits.groupBy("experiment", "run_id").agg(last.alias("attempt"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every run's last commit, in the columns of ``RUN_LOG``."""
    rows = spark.read.schema(RUN_LOG + ", attempt string").parquet(f"{path}/rows")
    run, kept = F.struct("experiment", "run_id", "attempt"), _last_commits(spark, path)
    kept = kept.select(run.alias("run"))
    return rows.withColumn("run", run).join(kept, "run", "left_semi").drop("run", "attempt")


def quality_metrics(splits: DataFrame, passed: bool | Column) -> DataFrame:
    """(metric, value): total_samples, passed_quality_checks, {split}_samples, {split}_null_ratio."""
    passed = F.lit(passed) if isinstance(passed, bool) else passed
    per_split = splits.select(
        F.inline(
            F.array(
                F.struct(
                    F.concat("split", F.lit("_samples")).alias("metric"),
                    F.col("samples").cast("double").alias("value"),
                ),
                F.struct(
                    F.concat("split", F.lit("_null_ratio")).alias("metric"),
                    F.col("null_ratio").cast("double").alias("value"),
                ),
            )
        )
    )
    total = splits.agg(
        F.lit("total_samples").alias("metric"),
        F.coalesce(F.sum("samples"), F.lit(0)).cast("double").alias("value"),
    )
    gate = splits.agg(
        F.lit("passed_quality_checks").alias("metric"), F.max(passed.cast("double")).alias("value")
    )
    return per_split.unionByName(total).unionByName(gate)


def export_results(results: DataFrame) -> DataFrame:
    """Display form: quoted text, ``xx.xx%``, ``aspect:sentiment; ...``, empty error for none."""
    pairs = F.transform("aspects", lambda a: F.concat(a["aspect"], F.lit(":"), a["sentiment"]))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return results.select(
        "row",
        quoted(F.replace(F.col("text"), F.lit('"'), F.lit('""'))).alias("text"),
        "sentiment",
        F.format_string("%.2f%%", F.col("confidence") * 100).alias("confidence"),
        quoted(F.array_join(pairs, "; ")).alias("aspects"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def export_lines(results: DataFrame) -> DataFrame:
    """The display form as CSV lines, ready for ``write.text``."""
    return export_results(results).select(F.concat_ws(",", F.col("row").cast("string"), "text", "sentiment", "confidence", "aspects", "error").alias("line"))


def export_with_json(results: DataFrame) -> DataFrame:
    """Results with the aspects as one JSON column."""
    return results.withColumn("aspects_json", F.to_json("aspects")).drop("aspects")
