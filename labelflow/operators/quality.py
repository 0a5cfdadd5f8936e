"""Data-quality report over a sentence/aspect pair.

One grouped pass per frame builds a profile table (a few thousand rows at most for labelled data); every
rule, count and statistic reads the profiles. The only other job is the orphan anti-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions import vocab
from labelflow.operators.frames import Frames
from labelflow.session import materialize

SENTENCE_COLUMNS = ("sentence_id", "text", "sentiment", "split")
ASPECT_COLUMNS = ("sentence_id", "aspect_category", "sentiment")
SPLITS_TYPE = "map<string, struct<samples: long, null_ratio: double, label_distribution: map<string, long>>>"
LENGTHS_TYPE = "struct<mean: double, min: int, max: int, median: double, p95: double>"
FINDING = "severity string, rule string, scope string, detail string"


@dataclass(frozen=True)
class QualityLimits:
    min_samples: int = vocab.MIN_SAMPLES
    max_null_ratio: float = vocab.MAX_NULL_RATIO
    sentiments: tuple[str, ...] = vocab.SENTIMENTS
    aspects: tuple[str, ...] = vocab.ASPECTS


@dataclass
class QualityResult:
    findings: DataFrame
    report: DataFrame
    splits: DataFrame | None = None
    labels: DataFrame | None = None
    profiles: tuple[DataFrame, ...] = field(default=())


def _is_null(c: str) -> Column:
    return F.col(c).isNull().cast("long")


def sentence_profile(sentences: DataFrame, order_col: str = "row_order") -> DataFrame:
    """(split, sentiment, text_len) -> n, null ids, null texts, first row. One pass, map-side combined."""
    return sentences.groupBy(
        F.coalesce(F.col("split").cast("string"), F.lit(vocab.MISSING_SPLIT)).alias("split"),
        "sentiment",
        F.length(F.coalesce("text", F.lit(""))).alias("text_len"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_is_null("sentence_id")).alias("null_ids"),
        F.sum(_is_null("text")).alias("null_texts"),
        F.min(order_col).alias("first_row"),
    )


def aspect_profile(aspects: DataFrame, order_col: str = "row_order") -> DataFrame:
    return aspects.groupBy("aspect_category", "sentiment").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_is_null("sentence_id")).alias("null_ids"),
        F.min(order_col).alias("first_row"),
    )


def split_stats(profile: DataFrame) -> DataFrame:
    """(split, samples, null_ratio): the worst of the three columns' null shares."""
    n = F.sum("n")
    null_sentiment = F.sum(F.when(F.col("sentiment").isNull(), F.col("n")).otherwise(0))
    return profile.groupBy("split").agg(
        n.alias("samples"),
        F.greatest(F.sum("null_ids") / n, F.sum("null_texts") / n, null_sentiment / n).alias(
            "null_ratio"
        ),
    )


def label_distribution(profile: DataFrame) -> DataFrame:
    return profile.groupBy(
        "split", F.coalesce("sentiment", F.lit(vocab.NULL_LABEL)).alias("label")
    ).agg(F.sum("n").alias("n"))


def aspect_distribution(profile: DataFrame) -> DataFrame:
    return profile.groupBy(
        F.coalesce("aspect_category", F.lit(vocab.NULL_LABEL)).alias("label")
    ).agg(F.sum("n").alias("n"))


def text_length_stats(profile: DataFrame) -> DataFrame:
    """One row: mean, min, max, median, p95; zeros for an empty table."""
    lengths = profile.groupBy("text_len").agg(F.sum("n").alias("n"))
    middle = F.percentile(F.col("text_len"), F.array(F.lit(0.5), F.lit(0.95)), F.col("n"))
    row = lengths.agg(
        (F.sum(F.col("text_len").cast("double") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("text_len").alias("min"),
        F.max("text_len").alias("max"),
        middle.alias("q"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return row.select(
        zero(F.col("mean")).alias("mean"),
        zero(F.col("min")).alias("min"),
        zero(F.col("max")).alias("max"),
        zero(F.get("q", F.lit(0))).alias("median"),
        zero(F.get("q", F.lit(1))).alias("p95"),
    )


def invalid_label_counts(profile: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """(label, n, first_row) of every label that is not allowed, a missing one as null."""
    bad = profile.filter(~F.coalesce(F.col(col).isin(*allowed), F.lit(False)))
    return bad.groupBy(F.col(col).alias("label")).agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))


def invalid_labels(
    profile: DataFrame, col: str, allowed: Sequence[str], limit: int = 10
) -> DataFrame:
    """One row: invalid row count and at most ``limit`` distinct examples in first-seen order.

    Missing labels are invalid; they are shown only when nothing else is. All of them:
    :func:`invalid_label_counts`.
    """
    bad = invalid_label_counts(profile, col, allowed)
    total = bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("invalid")).withColumn("one", F.lit(1))
    named = bad.filter(F.col("label").isNotNull()).orderBy("first_row").limit(limit)
    shown = named.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first_row", F.col("label").alias("v")))),
            lambda r: r["v"],
        ).alias("seen")
    ).withColumn("one", F.lit(1))
    return total.join(shown, "one").select(
        "invalid",
        F.when(F.col("invalid") == 0, F.array().cast("array<string>"))
        .when(F.size("seen") == 0, F.array(F.lit(vocab.NULL_LABEL)))
        .otherwise(F.col("seen"))
        .alias("examples"),
    )


def orphan_ids(frames: Frames) -> DataFrame:
    """Distinct aspect ids (as text, missing reads ``nan``) without a sentence."""
    as_text = lambda: F.coalesce(F.col("sentence_id").cast("string"), F.lit("nan"))
    wanted = frames.aspects.select(as_text().alias("sentence_id")).distinct()
    known = frames.sentences.select(as_text().alias("sentence_id"))
    return wanted.join(known, "sentence_id", "left_anti")


def orphan_summary(frames: Frames, limit: int = 5) -> DataFrame:
    """One row: orphan count and the first ``limit`` ids in text order.

    The orphans (normally few) are written once, so the anti-join runs once for both.
    """
    orphans = materialize(orphan_ids(frames), "orphans")
    total = orphans.agg(F.count(F.lit(1)).alias("orphans")).withColumn("one", F.lit(1))
    first = (
        orphans.orderBy("sentence_id")
        .limit(limit)
        .agg(F.sort_array(F.collect_list("sentence_id")).alias("examples"))
        .withColumn("one", F.lit(1))
    )
    return total.join(first, "one").drop("one")


def distribution_warnings(
    distribution: DataFrame, totals: DataFrame, expected: Sequence[str], by: str = "split"
) -> DataFrame:
    """(by, label, n, total, warning) for expected labels that are missing or under-represented.

    Under-represented: fewer than max(5, 5% of the group, rounded up).
    """
    every = totals.filter(F.col("total") > 0).select(
        by, "total", F.explode(F.array(*[F.lit(x) for x in expected])).alias("label")
    )
    found = every.join(distribution, [by, "label"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )
    floor = F.greatest(F.lit(5), F.ceil(F.col("total") * F.lit(0.05)))
    return found.select(
        by,
        "label",
        "n",
        "total",
        F.when(F.col("n") == 0, "missing")
        .when(F.col("n") < floor, "underrepresented")
        .alias("warning"),
    ).filter(F.col("warning").isNotNull())


def row_count_rules(splits: DataFrame, aspects: DataFrame, limits: QualityLimits) -> DataFrame:
    """Too few rows in all, too few rows in a split, no aspect rows."""
    low = F.col("samples") < limits.min_samples
    total = splits.agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("samples")).filter(low)
    empty = aspects.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).filter("n = 0")
    return (
        total.select(*_finding("error", "min_samples", F.lit("dataset"), F.col("samples")))
        .unionByName(
            splits.filter(low).select(
                *_finding("error", "min_samples", F.concat(F.lit("split "), "split"), F.col("samples"))
            )
        )
        .unionByName(
            empty.select(*_finding("error", "no_aspects", F.lit("aspects"), F.col("n")))
        )
    )


def null_ratio_rules(splits: DataFrame, aspects: DataFrame, limits: QualityLimits) -> DataFrame:
    n = F.sum("n")
    nulls = lambda c: F.sum(F.when(F.col(c).isNull(), F.col("n")).otherwise(0)) / n
    worst = aspects.agg(
        F.greatest(F.sum("null_ids") / n, nulls("aspect_category"), nulls("sentiment")).alias(
            "null_ratio"
        )
    )
    high = F.col("null_ratio") > limits.max_null_ratio
    shown = F.format_string("%.6f", F.col("null_ratio"))
    return (
        splits.filter(high)
        .select(*_finding("error", "null_ratio", F.concat(F.lit("split "), "split"), shown))
        .unionByName(
            worst.filter(high).select(*_finding("error", "null_ratio", F.lit("aspects"), shown))
        )
    )


def _finding(severity: str, rule: str, scope: Column, detail: Column) -> list[Column]:
    return [
        F.lit(severity).alias("severity"),
        F.lit(rule).alias("rule"),
        scope.alias("scope"),
        detail.cast("string").alias("detail"),
    ]


def _missing_columns(frames: Frames) -> list[tuple[str, str, str, str]]:
    out = []
    for scope, df, needed in (
        ("sentences", frames.sentences, SENTENCE_COLUMNS),
        ("aspects", frames.aspects, ASPECT_COLUMNS),
    ):
        missing = [c for c in needed if c not in df.columns]
        if missing:
            out.append(("error", "missing_columns", scope, ",".join(missing)))
    return out


def quality_report(
    frames: Frames, limits: QualityLimits = QualityLimits(), order_col: str = "row_order"
) -> QualityResult:
    """All checks. ``findings`` is long (severity, rule, scope, detail); ``report`` is one nested row."""
    spark = frames.sentences.sparkSession
    broken = _missing_columns(frames)
    if broken:
        findings = spark.createDataFrame(broken, FINDING)
        return QualityResult(findings, _unread_report(findings, frames.sentences.count()))

    sp = materialize(sentence_profile(frames.sentences, order_col), "sentence-profile")
    ap = materialize(aspect_profile(frames.aspects, order_col), "aspect-profile")
    splits, labels, categories = split_stats(sp), label_distribution(sp), aspect_distribution(ap)

    parts = [row_count_rules(splits, ap, limits), null_ratio_rules(splits, ap, limits)]
    for rule, profile, col, allowed in (
        ("invalid_sentence_sentiment", sp, "sentiment", limits.sentiments),
        ("invalid_aspect_category", ap, "aspect_category", limits.aspects),
        ("invalid_aspect_sentiment", ap, "sentiment", limits.sentiments),
    ):
        scope = "sentences" if profile is sp else "aspects"
        parts.append(
            invalid_labels(profile, col, allowed)
            .filter("invalid > 0")
            .select(*_finding("error", rule, F.lit(scope), F.array_join("examples", ",")))
        )
    parts.append(
        orphan_summary(frames)
        .filter("orphans > 0")
        .select(
            *_finding(
                "error",
                "orphan_aspects",
                F.lit("aspects"),
                F.concat_ws(":", F.col("orphans").cast("string"), F.array_join("examples", ",")),
            )
        )
    )
    count = F.concat_ws("/", F.col("n").cast("string"), F.col("total").cast("string"))
    detail = F.concat_ws(" ", "label", count)
    by_split = distribution_warnings(
        labels, splits.select("split", F.col("samples").alias("total")), limits.sentiments
    )
    parts.append(
        by_split.select(
            *_finding("warning", "x", F.concat(F.lit("split "), "split"), detail)[2:],
            F.lit("warning").alias("severity"),
            F.concat(F.col("warning"), F.lit("_sentiment")).alias("rule"),
        )
    )
    whole = F.lit("dataset").alias("split")
    by_aspect = distribution_warnings(
        categories.select(whole, "label", "n"),
        categories.agg(F.sum("n").alias("total")).select(whole, "total"),
        limits.aspects,
    )
    parts.append(
        by_aspect.select(
            F.col("split").alias("scope"),
            detail.alias("detail"),
            F.lit("warning").alias("severity"),
            F.concat(F.col("warning"), F.lit("_aspect")).alias("rule"),
        )
    )
    findings = parts[0]
    for part in parts[1:]:
        findings = findings.unionByName(part)
    return QualityResult(
        findings,
        _report(findings, splits, labels, categories, text_length_stats(sp)),
        splits,
        labels.unionByName(categories.withColumn("split", F.lit(None).cast("string"))),
        (sp, ap),
    )


def _checks(findings: DataFrame) -> DataFrame:
    message = F.concat_ws(": ", "rule", "scope", "detail")

    def messages(severity: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("severity") == severity, message)))

    out = findings.agg(messages("error").alias("errors"), messages("warning").alias("warnings"))
    return out.withColumn("checks_passed", F.size("errors") == 0)


def _unread_report(findings: DataFrame, total: int) -> DataFrame:
    """The report of frames that lack columns: the columns of :func:`_report`, nothing but the row count in it."""
    return _checks(findings).select(
        F.lit(total).cast("long").alias("total_samples"),
        F.create_map().cast(SPLITS_TYPE).alias("splits"),
        F.create_map().cast("map<string, long>").alias("aspect_distribution"),
        F.lit(None).cast(LENGTHS_TYPE).alias("text_length_stats"),
        "checks_passed",
        "errors",
        "warnings",
    )


def _label_map() -> Column:
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n"))))


def _report(findings, splits, labels, categories, lengths) -> DataFrame:
    """One row: total_samples, splits, aspect_distribution, text_length_stats, checks, messages.

    It names every split, label and message, so its size is theirs; ``QualityResult.labels`` holds the same
    counts as rows, for columns that are not label-like.
    """
    one = F.lit(1).alias("one")
    checks = _checks(findings).withColumn("one", one)
    per_split = splits.join(labels.groupBy("split").agg(_label_map().alias("label_distribution")), "split")
    split_map = per_split.agg(
        F.coalesce(F.sum("samples"), F.lit(0)).alias("total_samples"),
        F.map_from_entries(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("split", "samples", "null_ratio", "label_distribution")),
                    lambda a, b: F.when(a["split"] < b["split"], -1).otherwise(1),
                ),
                lambda r: F.struct(
                    r["split"].alias("split"),
                    F.struct(
                        r["samples"].alias("samples"),
                        r["null_ratio"].alias("null_ratio"),
                        r["label_distribution"].alias("label_distribution"),
                    ).alias("stats"),
                ),
            )
        ).alias("splits"),
        one,
    )
    aspect_map = categories.agg(_label_map().alias("aspect_distribution"), one)
    stats = lengths.select(F.struct(*lengths.columns).alias("text_length_stats"), one)
    return (
        split_map.join(aspect_map, "one")
        .join(stats, "one")
        .join(checks, "one")
        .select(
            "total_samples",
            "splits",
            "aspect_distribution",
            "text_length_stats",
            "checks_passed",
            "errors",
            "warnings",
        )
    )


def require_passed(result: QualityResult) -> None:
    """Gate for a job: fails when the report has errors."""
    row = result.report.select("checks_passed", "errors").first()
    if not row["checks_passed"]:
        raise ValueError("data quality checks failed: " + "; ".join(row["errors"]))


def retention_check(
    before: DataFrame, after_total: int | DataFrame, expected_min: int, max_loss: float = 0.2
) -> DataFrame:
    """One row: raw and processed counts, loss share, and whether both bounds hold."""
    one = F.lit(1).alias("one")
    raw = before.agg(F.count(F.lit(1)).alias("raw_rows"), one)
    if isinstance(after_total, DataFrame):
        kept = after_total.agg(F.count(F.lit(1)).alias("kept_rows"), one)
    else:
        kept = before.sparkSession.createDataFrame([(after_total, 1)], "kept_rows long, one int")
    loss = 1.0 - F.col("kept_rows") / F.nullif(F.col("raw_rows"), F.lit(0))
    return raw.join(kept, "one").select(
        "raw_rows",
        "kept_rows",
        loss.alias("loss"),
        (F.col("kept_rows") >= expected_min).alias("enough_rows"),
        F.coalesce(loss <= max_loss, F.lit(False)).alias("loss_ok"),
    )


def label_sheet_checks(
    sheet: DataFrame, id_col: str = "id", min_double: int = 50
) -> DataFrame:
    """Findings of an annotation sheet: empty labels, repeated (id, labeler), items with fewer than two
    labels, too few double-labelled items. One pass per item, then counts."""
    per_pair = sheet.groupBy(id_col, "labeler_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.coalesce(F.trim("label"), F.lit("")) == "").cast("long")).alias("empty"),
    )
    per_item = per_pair.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("labelers"),
        F.sum("empty").alias("empty"),
        F.sum((F.col("rows") > 1).cast("long")).alias("repeats"),
    )
    totals = per_item.agg(
        F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_label"),
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicate_id"),
        F.sum((F.col("labelers") < 2).cast("long")).alias("single_label"),
        F.coalesce(F.sum((F.col("labelers") >= 2).cast("long")), F.lit(0)).alias("double_labelled"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = [
        ("empty_label", zero("empty_label"), zero("empty_label") == 0),
        ("duplicate_id", zero("duplicate_id"), zero("duplicate_id") == 0),
        ("single_label", zero("single_label"), zero("single_label") == 0),
        ("double_labelled", zero("double_labelled"), zero("double_labelled") >= min_double),
    ]
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(r).alias("rule"), n.alias("n"), ok.alias("passed"))
                    for r, n, ok in rules
                ]
            )
        )
    )
