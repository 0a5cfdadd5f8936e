"""Quality report parts, retention, annotation sheet checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.catalog.registry import query
from labelflow.catalog.views import Tables, r6, sql
from labelflow.functions import vocab
from labelflow.operators import quality as q
from labelflow.operators.balance import value_counts
from labelflow.operators.frames import label_rows
from labelflow.plans.preprocess import build_dataset
from labelflow.session import materialize

LIMITS = q.QualityLimits(min_samples=150, max_null_ratio=0.01)


def profiles(t: Tables):
    return q.sentence_profile(t.dirty.sentences), q.aspect_profile(t.dirty.aspects)


@query(
    "value_counts_a2_t2",
    sql(
        """SELECT split, coalesce(sentiment, '<null_or_na>') AS label, count(*) AS n,
                  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS pct
           FROM dirty_sentences GROUP BY 1, 2""",
        "dirty_sentences",
    ),
)
def label_counts(t: Tables):
    out = value_counts(t.dirty.sentences, "sentiment", ["split"])
    return out.select("split", "label", "n", r6(F.col("pct")).alias("pct"))


SPLIT_STATS = """
    SELECT coalesce(split, '<missing_split>') AS split, count(*) AS samples,
           greatest(avg((sentence_id IS NULL)::INT), avg((text IS NULL)::INT),
                    avg((sentiment IS NULL)::INT)) AS null_ratio
    FROM dirty_sentences GROUP BY 1"""


@query(
    "split_stats_a3_t1",
    sql(
        "SELECT split, samples, round(null_ratio, 6) AS null_ratio FROM st",
        "dirty_sentences",
        extra={"st": SPLIT_STATS},
    ),
)
def split_stats(t: Tables):
    out = q.split_stats(profiles(t)[0])
    return out.select("split", "samples", r6(F.col("null_ratio")).alias("null_ratio"))


@query(
    "label_distribution_a3",
    sql(
        """SELECT coalesce(split, '<missing_split>') AS split, coalesce(sentiment, '<null_or_na>') AS label,
                  count(*) AS n FROM dirty_sentences GROUP BY 1, 2""",
        "dirty_sentences",
    ),
)
def label_distribution(t: Tables):
    return q.label_distribution(profiles(t)[0])


@query(
    "text_lengths_a4",
    sql(
        """SELECT round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max,
                  round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95
           FROM (SELECT length(coalesce(text, ''))::BIGINT AS n FROM dirty_sentences)""",
        "dirty_sentences",
    ),
)
def text_lengths(t: Tables):
    out = q.text_length_stats(profiles(t)[0])
    return out.select(
        r6(F.col("mean")).alias("mean"),
        F.col("min").cast("long").alias("min"),
        F.col("max").cast("long").alias("max"),
        r6(F.col("median")).alias("median"),
        r6(F.col("p95")).alias("p95"),
    )


def _sql_invalid(frame: str, col: str, allowed) -> str:
    names = ", ".join(f"'{x}'" for x in allowed)
    return f"""
        SELECT '{frame}.{col}' AS field, coalesce(sum(n), 0)::BIGINT AS invalid,
               CASE WHEN coalesce(sum(n), 0) = 0 THEN ''
                    ELSE coalesce((SELECT string_agg(v, ',' ORDER BY o) FROM
                        (SELECT {col} AS v, min(row_order) AS o FROM {frame}
                         WHERE {col} IS NOT NULL AND {col} NOT IN ({names})
                         GROUP BY 1 ORDER BY 2 LIMIT 10)), '<null_or_na>') END AS examples
        FROM (SELECT count(*) AS n FROM {frame} WHERE coalesce({col} NOT IN ({names}), true))"""


FIELDS = (
    ("dirty_sentences", "sentiment", vocab.SENTIMENTS),
    ("dirty_aspects", "aspect_category", vocab.ASPECTS),
    ("dirty_aspects", "sentiment", vocab.SENTIMENTS),
)


@query(
    "invalid_labels_a5",
    sql(
        " UNION ALL ".join(_sql_invalid(*f) for f in FIELDS), "dirty_sentences", "dirty_aspects"
    ),
)
def invalid_labels(t: Tables):
    sp, ap = (materialize(p, "profile") for p in profiles(t))
    parts = []
    for frame, col, allowed in FIELDS:
        out = q.invalid_labels(sp if frame == "dirty_sentences" else ap, col, allowed)
        parts.append(
            out.select(
                F.lit(f"{frame}.{col}").alias("field"),
                "invalid",
                F.array_join("examples", ",").alias("examples"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "row_count_rules_a6",
    sql(
        f"""SELECT 'error' AS severity, 'min_samples' AS rule, 'split ' || split AS scope,
                   samples::VARCHAR AS detail FROM st WHERE samples < {LIMITS.min_samples}
            UNION ALL SELECT 'error', 'min_samples', 'dataset', n::VARCHAR
            FROM (SELECT count(*) AS n FROM dirty_sentences) WHERE n < {LIMITS.min_samples}
            UNION ALL SELECT 'error', 'no_aspects', 'aspects', '0'
            WHERE NOT EXISTS (SELECT 1 FROM dirty_aspects)""",
        "dirty_sentences",
        "dirty_aspects",
        extra={"st": SPLIT_STATS},
    ),
)
def row_count_rules(t: Tables):
    sp, ap = profiles(t)
    return q.row_count_rules(q.split_stats(sp), ap, LIMITS)


@query(
    "null_ratio_rules_a7",
    sql(
        """SELECT 'error' AS severity, 'null_ratio' AS rule, 'split ' || split AS scope,
                  printf('%.6f', null_ratio) AS detail FROM st WHERE null_ratio > 0.01
           UNION ALL SELECT 'error', 'null_ratio', 'aspects', printf('%.6f', r)
           FROM (SELECT greatest(avg((sentence_id IS NULL)::INT), avg((aspect_category IS NULL)::INT),
                                 avg((sentiment IS NULL)::INT)) AS r FROM dirty_aspects) WHERE r > 0.01""",
        "dirty_sentences",
        "dirty_aspects",
        extra={"st": SPLIT_STATS},
    ),
)
def null_ratio_rules(t: Tables):
    sp, ap = profiles(t)
    return q.null_ratio_rules(q.split_stats(sp), ap, LIMITS)


def _sql_warnings(source: str, by: str, label: str, expected) -> str:
    names = "[" + ", ".join(f"'{x}'" for x in expected) + "]"
    return f"""
        SELECT scope, label, n, total, CASE WHEN n = 0 THEN 'missing' ELSE 'underrepresented' END AS warning
        FROM (SELECT g.scope, e.label, g.total,
                     (SELECT count(*) FROM {source} x WHERE {by} = g.scope AND x.{label} = e.label) AS n
              FROM (SELECT {by} AS scope, count(*) AS total FROM {source} GROUP BY 1) g,
                   (SELECT unnest({names}) AS label) e)
        WHERE n < greatest(5, ceil(0.05::DOUBLE * total))"""


@query(
    "distribution_warnings_a8",
    sql(
        _sql_warnings("dirty_sentences", "coalesce(split, '<missing_split>')", "sentiment", vocab.SENTIMENTS)
        + " UNION ALL "
        + _sql_warnings("mapped_aspects", "'dataset'", "aspect_category", vocab.ASPECTS),
        "dirty_sentences",
        "mapped_aspects",
    ),
)
def distribution_warnings(t: Tables):
    sp = profiles(t)[0]
    totals = q.split_stats(sp).select("split", F.col("samples").alias("total"))
    one = q.distribution_warnings(q.label_distribution(sp), totals, vocab.SENTIMENTS)
    whole = F.lit("dataset").alias("split")
    dist = q.aspect_distribution(q.aspect_profile(label_rows(t.aspects)))
    two = q.distribution_warnings(
        dist.select(whole, "label", "n"),
        dist.agg(F.sum("n").alias("total")).select(whole, "total"),
        vocab.ASPECTS,
    )
    return one.unionByName(two).withColumnRenamed("split", "scope")


ROW_ORPHANS = """SELECT DISTINCT coalesce(sentence_id, 'nan') AS sentence_id FROM dirty_aspects
    WHERE coalesce(sentence_id, 'nan') NOT IN (SELECT coalesce(sentence_id, 'nan') FROM dirty_sentences)"""

FINDINGS = f"""
    SELECT 'error' AS severity, 'min_samples' AS rule, 'split ' || split AS scope, samples::VARCHAR AS detail
    FROM st WHERE samples < {LIMITS.min_samples}
    UNION ALL SELECT 'error', 'min_samples', 'dataset', n::VARCHAR
    FROM (SELECT count(*) AS n FROM dirty_sentences) WHERE n < {LIMITS.min_samples}
    UNION ALL SELECT 'error', 'null_ratio', 'split ' || split, printf('%.6f', null_ratio) FROM st
    WHERE null_ratio > 0.01
    UNION ALL SELECT 'error', 'null_ratio', 'aspects', printf('%.6f', r)
    FROM (SELECT greatest(avg((sentence_id IS NULL)::INT), avg((aspect_category IS NULL)::INT),
                          avg((sentiment IS NULL)::INT)) AS r FROM dirty_aspects) WHERE r > 0.01
    UNION ALL SELECT 'error', CASE field WHEN 'dirty_sentences.sentiment' THEN 'invalid_sentence_sentiment'
                WHEN 'dirty_aspects.sentiment' THEN 'invalid_aspect_sentiment'
                ELSE 'invalid_aspect_category' END, CASE WHEN field LIKE 'dirty_s%' THEN 'sentences' ELSE 'aspects' END, examples
    FROM ({" UNION ALL ".join(_sql_invalid(*f) for f in FIELDS)}) WHERE invalid > 0
    UNION ALL SELECT 'error', 'orphan_aspects', 'aspects', (SELECT count(*) FROM orphans) || ':' ||
        (SELECT string_agg(sentence_id, ',' ORDER BY sentence_id) FROM
         (SELECT * FROM orphans ORDER BY 1 LIMIT 5))
    WHERE EXISTS (SELECT 1 FROM orphans)
    UNION ALL SELECT 'warning', warning || '_sentiment', 'split ' || scope, label || ' ' || n || '/' || total
    FROM ({_sql_warnings("dirty_sentences", "coalesce(split, '<missing_split>')", "sentiment", vocab.SENTIMENTS)})
    UNION ALL SELECT 'warning', warning || '_aspect', scope, label || ' ' || n || '/' || total
    FROM ({_sql_warnings("dirty_aspects", "'dataset'", "aspect_category", vocab.ASPECTS)})"""


@query(
    "quality_findings_a16",
    sql(
        FINDINGS,
        "dirty_sentences",
        "dirty_aspects",
        extra={"st": SPLIT_STATS, "orphans": ROW_ORPHANS},
    ),
)
def quality_findings(t: Tables):
    return q.quality_report(t.dirty, LIMITS).findings


@query(
    "quality_summary_a16_k2",
    sql(
        """SELECT count(*) AS total_samples,
                  (SELECT count(*) FROM findings WHERE severity = 'error') AS n_errors,
                  (SELECT count(*) FROM findings WHERE severity = 'warning') AS n_warnings,
                  (SELECT count(*) FROM findings WHERE severity = 'error') = 0 AS checks_passed,
                  (SELECT string_agg(aspect_category || '=' || n, ';' ORDER BY aspect_category) FROM
                   (SELECT aspect_category, count(*) AS n FROM dirty_aspects GROUP BY 1)) AS aspects,
                  (SELECT string_agg(split || '=' || samples, ';' ORDER BY split) FROM st) AS split_samples,
                  (SELECT string_agg(split || '/' || label || '=' || n, ';' ORDER BY split, label) FROM
                   (SELECT coalesce(split, '<missing_split>') AS split, coalesce(sentiment, '<null_or_na>') AS label,
                           count(*) AS n FROM dirty_sentences GROUP BY 1, 2)) AS split_labels,
                  max(length(coalesce(text, '')))::BIGINT AS longest
           FROM dirty_sentences""",
        "dirty_sentences",
        "dirty_aspects",
        extra={"st": SPLIT_STATS, "orphans": ROW_ORPHANS, "findings": FINDINGS},
    ),
)
def quality_summary(t: Tables):
    """The one-row report, read back from its JSON form."""
    from labelflow.sources.sinks import report_json

    text = report_json(q.quality_report(t.dirty, LIMITS).report)
    schema = (
        "total_samples long, splits map<string,struct<samples:long,label_distribution:map<string,long>>>, "
        "aspect_distribution map<string,long>, checks_passed boolean, "
        "errors array<string>, warnings array<string>, text_length_stats struct<max:long>"
    )

    def listed(entries, shown):
        return F.array_join(F.transform(F.array_sort(entries), shown), ";")

    def labels(split):
        counts = F.array_sort(F.map_entries(split["value"]["label_distribution"]))
        return F.transform(counts, lambda n: F.concat(split["key"], F.lit("/"), n["key"], F.lit("="), n["value"]))

    splits = F.transform_values("r.splits", lambda _, v: v["samples"])
    names = F.transform(F.array_sort(F.map_keys("r.splits")), lambda k: F.struct(
        k.alias("key"), F.element_at("r.splits", k).alias("value")))
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return text.select(F.from_json("report", schema).alias("r")).select(
        "r.total_samples",
        F.size("r.errors").cast("long").alias("n_errors"),
        F.size("r.warnings").cast("long").alias("n_warnings"),
        "r.checks_passed",
        listed(F.map_entries("r.aspect_distribution"), pair).alias("aspects"),
        listed(F.map_entries(splits), pair).alias("split_samples"),
        F.array_join(F.flatten(F.transform(names, labels)), ";").alias("split_labels"),
        F.col("r.text_length_stats.max").alias("longest"),
    )


@query(
    "built_quality_a16_m8",
    sql(
        f"""SELECT severity, rule, scope, detail FROM (
            SELECT 'error' AS severity, 'min_samples' AS rule, 'split ' || split AS scope,
                   count(*)::VARCHAR AS detail FROM built GROUP BY split HAVING count(*) < 100
            UNION ALL SELECT 'error', 'min_samples', 'dataset', n::VARCHAR
            FROM (SELECT count(*) AS n FROM built) WHERE n < 100
            UNION ALL SELECT 'warning', warning || '_sentiment', 'split ' || scope, label || ' ' || n || '/' || total
            FROM ({_sql_warnings("built", "split", "sentiment", vocab.SENTIMENTS)})
            UNION ALL SELECT 'warning', warning || '_aspect', scope, label || ' ' || n || '/' || total
            FROM ({_sql_warnings("built_aspects", "'dataset'", "aspect_category", vocab.ASPECTS)}))""",
        "built",
        "built_aspects",
    ),
)
def built_quality(t: Tables):
    return q.quality_report(build_dataset(t.raw)).findings


@query(
    "retention_a17",
    sql(
        """SELECT raw_rows, kept_rows, round(1 - kept_rows::DOUBLE / raw_rows, 6) AS loss,
                  kept_rows >= 500 AS enough_rows, 1 - kept_rows::DOUBLE / raw_rows <= 0.2 AS loss_ok
           FROM (SELECT (SELECT count(*) FROM sentences) AS raw_rows, (SELECT count(*) FROM survivors) AS kept_rows)""",
        "sentences",
        "survivors",
    ),
)
def retention(t: Tables):
    out = q.retention_check(t.sentences, build_dataset(t.raw).sentences, 500)
    return out.withColumn("loss", r6(F.col("loss")))


@query(
    "label_sheet_a28",
    sql(
        """SELECT rule, n, CASE WHEN rule = 'double_labelled' THEN n >= 50 ELSE n = 0 END AS passed FROM (
             SELECT 'empty_label' AS rule, (SELECT count(*) FROM sheet WHERE trim(coalesce(label, '')) = '') AS n
             UNION ALL SELECT 'duplicate_id', (SELECT count(*) FROM
                 (SELECT 1 FROM sheet GROUP BY id, labeler_id HAVING count(*) > 1))
             UNION ALL SELECT 'single_label', (SELECT count(*) FROM
                 (SELECT 1 FROM sheet GROUP BY id HAVING count(DISTINCT labeler_id) < 2))
             UNION ALL SELECT 'double_labelled', (SELECT count(*) FROM
                 (SELECT 1 FROM sheet GROUP BY id HAVING count(DISTINCT labeler_id) >= 2)))""",
        "annotations",
        extra={
            "sheet": """SELECT id, labeler_id, CASE WHEN id LIKE '%7' THEN ' ' ELSE label END AS label
                FROM annotations WHERE NOT (id LIKE '%3' AND labeler_id = 'ann_b')
                UNION ALL SELECT id, labeler_id, label FROM annotations WHERE id LIKE '%11'"""
        },
    ),
)
def label_sheet(t: Tables):
    a = t.annotations
    ident = F.col("id")
    label = F.when(ident.endswith("7"), " ").otherwise(F.col("label")).alias("label")
    sheet = a.filter(~(ident.endswith("3") & (F.col("labeler_id") == "ann_b"))).select("id", "labeler_id", label)
    sheet = sheet.unionByName(a.filter(ident.endswith("11")).select("id", "labeler_id", "label"))
    return q.label_sheet_checks(sheet)
