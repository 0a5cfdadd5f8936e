"""Dataset build: label map, sentiment, cleaning, dedup, cascade, whole build."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.catalog.registry import query
from labelflow.catalog.views import Tables, sql, sql_clean
from labelflow.functions import text as T
from labelflow.operators import frames as fr
from labelflow.operators import quality as ql
from labelflow.operators.dedup import drop_duplicates_first
from labelflow.plans.preprocess import build_dataset, default_steps


@query(
    "dataset_build_m8",
    sql("SELECT split, sentiment, count(*) AS n FROM built GROUP BY 1, 2", "built"),
)
def dataset_build(t: Tables):
    built = build_dataset(t.raw)
    return built.sentences.groupBy("split", "sentiment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dataset_build_rows_m8_w3_p17",
    sql("SELECT sentence_id, md5(text) AS text_md5, sentiment, split FROM built", "built"),
)
def dataset_build_rows(t: Tables):
    out = fr.run_steps(t.raw, default_steps()).frames
    return out.sentences.select("sentence_id", F.md5("text").alias("text_md5"), "sentiment", "split")


@query(
    "dataset_build_aspects_m8_j2",
    sql("SELECT sentence_id, aspect_category, sentiment FROM built_aspects", "built_aspects"),
)
def dataset_build_aspects(t: Tables):
    return build_dataset(t.raw).aspects.select("sentence_id", "aspect_category", "sentiment")


@query(
    "label_map_p1",
    sql("SELECT sentence_id, aspect_category, sentiment FROM mapped_aspects", "mapped_aspects"),
)
def label_map(t: Tables):
    return fr.label_rows(t.aspects).select("sentence_id", "aspect_category", "sentiment")


@query(
    "sentence_sentiment_a1_j1",
    sql(
        """SELECT sentence_id, coalesce(d.sentiment, 'neutral') AS sentiment
           FROM sentences LEFT JOIN derived d USING (sentence_id)""",
        "sentences",
        "derived",
    ),
)
def sentence_sentiment(t: Tables):
    out = fr.attach_sentiment(t.sentences, fr.label_rows(t.aspects))
    return out.select("sentence_id", "sentiment")


@query(
    "clean_text_p2",
    sql("SELECT sentence_id, md5(text) AS text_md5, length(text) AS n_chars FROM cleaned", "cleaned"),
)
def clean_text(t: Tables):
    return fr.clean_rows(t.sentences).select(
        "sentence_id",
        F.md5("text").alias("text_md5"),
        F.length("text").cast("long").alias("n_chars"),
    )


@query(
    "length_filter_p3",
    sql(
        """SELECT sentence_id, length(text) AS n_chars FROM dirty_sentences
           WHERE length(text) BETWEEN 3 AND 2000""",
        "dirty_sentences",
    ),
)
def length_filter(t: Tables):
    return fr.filter_length(t.dirty.sentences).select(
        "sentence_id", F.length("text").cast("long").alias("n_chars")
    )


@query("exact_dedup_w1", sql("SELECT sentence_id, split, row_order FROM firsts", "firsts"))
def exact_dedup(t: Tables):
    out = drop_duplicates_first(fr.clean_rows(t.sentences), ["text"])
    return out.select("sentence_id", "split", "row_order")


@query(
    "normalized_dedup_w2_p14",
    sql(
        f"""SELECT row_order, split FROM dirty_sentences
            QUALIFY row_number() OVER (PARTITION BY {sql_clean("coalesce(text, 'nan')")}
                                       ORDER BY row_order) = 1""",
        "dirty_sentences",
    ),
)
def normalized_dedup(t: Tables):
    rows = t.dirty.sentences
    return drop_duplicates_first(rows, {"text": T.text_key(F.col("text"))}).select("row_order", "split")


@query(
    "aspect_cascade_j2",
    sql(
        """SELECT a.row_order, a.sentence_id FROM dirty_aspects a
           WHERE EXISTS (SELECT 1 FROM dirty_sentences s WHERE s.split = 'train'
                         AND s.sentence_id IS NOT DISTINCT FROM a.sentence_id)""",
        "dirty_aspects",
        "dirty_sentences",
    ),
)
def aspect_cascade(t: Tables):
    kept = t.dirty.sentences.filter("split = 'train'")
    return fr.cascade(kept, t.dirty.aspects).select("row_order", "sentence_id")


ORPHANS = """SELECT DISTINCT coalesce(sentence_id, 'nan') AS sentence_id FROM dirty_aspects
    WHERE coalesce(sentence_id, 'nan') NOT IN (SELECT coalesce(sentence_id, 'nan') FROM dirty_sentences)"""


@query("orphan_aspects_j3_t7", sql(ORPHANS, "dirty_aspects", "dirty_sentences"))
def orphan_aspects(t: Tables):
    return ql.orphan_ids(t.dirty)


@query(
    "orphan_examples_j3_t3",
    sql(
        """SELECT (SELECT count(*) FROM orphans) AS orphans,
                  (SELECT string_agg(sentence_id, ',' ORDER BY sentence_id)
                   FROM (SELECT * FROM orphans ORDER BY sentence_id LIMIT 5)) AS examples""",
        "dirty_aspects",
        "dirty_sentences",
        extra={"orphans": ORPHANS},
    ),
)
def orphan_examples(t: Tables):
    return ql.orphan_summary(t.dirty).select("orphans", F.array_join("examples", ",").alias("examples"))


# Missing labels and ids in the aspects: a missing label is no conflict, and neither enters the derived sentiment.
GAPS = """
    SELECT CASE WHEN row_order % 11 <> 0 THEN sentence_id END AS sentence_id, aspect_category,
           CASE WHEN row_order % 7 <> 0 THEN sentiment END AS sentiment
    FROM aspects"""


@query(
    "missing_labels_n1_n3",
    sql(
        """SELECT k.sentence_id, k.n, k.unlabelled, d.derived FROM (
               SELECT sentence_id, count(*) AS n, count(*) FILTER (sentiment IS NULL) AS unlabelled
               FROM gaps WHERE sentiment IS DISTINCT FROM 'conflict' GROUP BY 1) k
           LEFT JOIN (SELECT sentence_id, CASE WHEN count(DISTINCT sentiment) = 1 THEN min(sentiment)
                             WHEN bool_or(sentiment = 'negative') THEN 'negative' ELSE 'positive' END AS derived
                      FROM gaps WHERE sentiment <> 'conflict' AND sentence_id IS NOT NULL GROUP BY 1) d
           ON k.sentence_id = d.sentence_id""",
        "aspects",
        extra={"gaps": GAPS},
    ),
)
def missing_labels(t: Tables):
    d = F.col("row_order")
    gaps = t.aspects.select(
        F.when(d % 11 != 0, F.col("sentence_id")).alias("sentence_id"),
        "aspect_category",
        F.when(d % 7 != 0, F.col("sentiment")).alias("sentiment"),
    )
    kept = fr.label_rows(gaps)
    counts = kept.groupBy("sentence_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sentiment").isNull()).alias("unlabelled")
    )
    return counts.join(fr.sentence_sentiment(kept), "sentence_id", "left")


def _outcome(run) -> str:
    try:
        run()
    except fr.SchemaError as error:
        return str(error)
    return "ok"


@query(
    "step_conditions_p16_p17",
    sql(
        """SELECT v.outcome, v.what, p.split, CASE WHEN v.outcome = 'ok' THEN p.n ELSE 0 END AS n
           FROM (VALUES ('whole', 'ok'),
                        ('no text, no split', 'sentences frame lacks columns: [''split'', ''text'']'),
                        ('empty aspects', 'sentence and aspect frames must not be empty'),
                        ('step loses text', 'lose dropped required sentence columns: [''text'']'),
                        ('step loses ids', 'cannot cascade after drop: aspects frame lacks ''sentence_id'''),
                        ('nothing left', 'limit_length produced no sentences')) v(what, outcome)
           CROSS JOIN (SELECT split, count(*) AS n FROM sentences GROUP BY 1) p""",
        "sentences",
    ),
)
def step_conditions(t: Tables):
    """What the checks say of the raw frames and of steps that break them; rows per split where they pass."""
    raw = t.raw
    sentences, aspects = raw.sentences, raw.aspects
    lose = fr.Step("lose", lambda f: fr.Frames(f.sentences.drop("text"), f.aspects), ("text",))
    drop = fr.Step("drop", lambda f: fr.Frames(f.sentences, f.aspects.drop("sentence_id")))
    tries = {
        "whole": lambda: fr.check_schema(raw),
        "no text, no split": lambda: fr.check_schema(fr.Frames(sentences.drop("text", "split"), aspects)),
        "empty aspects": lambda: fr.check_schema(fr.Frames(sentences, aspects.filter("false"))),
        "step loses text": lambda: fr.run_steps(raw, [lose]),
        "step loses ids": lambda: fr.run_steps(raw, [drop]),
        "nothing left": lambda: fr.run_steps(raw, [fr.limit_length(0, -1)], strict=True),
    }
    found = F.array(
        *[F.struct(F.lit(what).alias("what"), F.lit(_outcome(run)).alias("outcome")) for what, run in tries.items()]
    )
    counts = sentences.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    rows = counts.select("split", "rows", F.inline(found))
    n = F.when(F.col("outcome") == "ok", F.col("rows")).otherwise(F.lit(0).cast("long"))
    return rows.select("outcome", "what", "split", n.alias("n"))
