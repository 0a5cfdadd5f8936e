"""Splits, samples, oversampling, task mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.catalog.registry import query
from labelflow.catalog.views import Tables, sql, sql_clean, sql_hash, sql_hash_int, sql_split
from labelflow.functions import labels as L
from labelflow.functions import text as T
from labelflow.operators import sampling as sp
from labelflow.operators.dedup import drop_duplicates_first
from labelflow.plans.eval_set import build_eval_set
from labelflow.session import materialize

# Languages pooled to the metrics label, so that every stratum has enough rows on the smallest tables.
LANG = "CASE WHEN lang IN ('en', 'vi') THEN lang ELSE 'other' END"
KEY42 = sql_hash("'42'", "sentence_id")


@query(
    "stratified_split_w3",
    sql(
        "SELECT sentence_id, split FROM halves",
        "sentences",
        extra={
            "halves": sql_split(
                "(SELECT sentence_id, lang, CASE WHEN row_order % 29 <> 0 THEN split END AS split FROM sentences)",
                "lang",
                0.25,
                "sentence_id",
                "val",
                "split = 'train'",
                7,
            )
        },
    ),
)
def stratified_split(t: Tables):
    rows = t.sentences.select(
        "sentence_id", "lang", F.when(F.col("row_order") % 29 != 0, F.col("split")).alias("split")
    )
    return sp.stratified_split(rows, "lang", 0.25, seed=7).select("sentence_id", "split")


@query(
    "train_test_w7_p15",
    sql(
        "SELECT id, stratum, split FROM halves",
        "predictions",
        extra={
            "keyed": f"SELECT id, 'train' AS split, {LANG} || '__' || y_true AS stratum FROM predictions",
            "halves": sql_split("keyed", "stratum", 0.1, "id", "test", "split = 'train'"),
        },
    ),
)
def train_test(t: Tables):
    key = L.stratum_key(T.language_label(F.col("lang")), F.col("y_true"))
    rows = t.predictions.select("id", key.alias("stratum"))
    return sp.train_test_split(rows, "stratum", "id").select("id", "stratum", "split")


@query(
    "train_test_plain_w7",
    sql(
        f"""SELECT sentence_id, CASE WHEN row_number() OVER (ORDER BY {KEY42}, sentence_id)
                   <= ceil(0.1::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
            FROM sentences""",
        "sentences",
    ),
)
def train_test_plain(t: Tables):
    return sp.train_test_split(t.sentences, None, "sentence_id").select("sentence_id", "split")


@query(
    "first_rows_w4",
    sql(
        """SELECT row_number() OVER (ORDER BY row_order) AS row, sentence_id
           FROM (SELECT * FROM sentences ORDER BY row_order LIMIT 32)""",
        "sentences",
    ),
)
def first_rows(t: Tables):
    return sp.first_rows(t.sentences, 32).select(F.col("row").cast("long").alias("row"), "sentence_id")


@query(
    "sample_per_language_w5",
    sql(
        f"""SELECT sentence_id, lang FROM sentences
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {KEY42}, sentence_id) <= 100""",
        "sentences",
    ),
)
def sample_per_language(t: Tables):
    return sp.sample_per_group(t.sentences, "lang", 100).select("sentence_id", "lang")


@query(
    "sample_rows_w6",
    sql(f"SELECT sentence_id FROM sentences ORDER BY {KEY42}, sentence_id LIMIT 100", "sentences"),
)
def sample_rows(t: Tables):
    return sp.sample_rows(t.sentences, 100, "sentence_id").select("sentence_id")


@query(
    "eval_set_m9_s10",
    sql(
        f"""SELECT sentence_id, lang, source, md5(text) AS text_md5 FROM sentences WHERE split = 'test'
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {KEY42}, sentence_id) <= 200""",
        "sentences",
    ),
)
def eval_set(t: Tables):
    rows = t.sentences.withColumn("label", F.lit("neutral"))
    parts = {x: rows.filter(F.col("lang") == x) for x in ("en", "fr", "de", "es")}
    out = build_eval_set(parts, id_col="sentence_id")
    return out.select("sentence_id", "lang", "source", F.md5("text").alias("text_md5"))


def sql_oversample(source: str, label: str, ident: str, target: float) -> str:
    """Copies per row of an oversampled table: (id, label, n)."""
    return f"""
        WITH cls AS (SELECT {label} AS label, count(*) AS c, sum(count(*)) OVER () AS total
                     FROM {source} GROUP BY 1),
        new AS (SELECT label, c, trunc(({target}::DOUBLE * total - c) / (1.0::DOUBLE - {target}::DOUBLE))::BIGINT AS k
                FROM cls WHERE c::DOUBLE / total < {target}::DOUBLE),
        draws AS (SELECT label, ({sql_hash_int("'42'", 'label', 'draw')} % c) + 1 AS rank
                  FROM (SELECT label, c, unnest(generate_series(1, k)) AS draw FROM new)),
        ranked AS (SELECT {ident} AS id, {label} AS label, row_number() OVER (
                       PARTITION BY {label} ORDER BY {sql_hash("'42'", ident)}, {ident}) AS rank FROM {source})
        SELECT r.id, r.label, 1 + count(d.rank) AS n FROM ranked r
        LEFT JOIN draws d ON d.label = r.label AND d.rank = r.rank GROUP BY 1, 2"""


@query(
    "oversample_a9_j7",
    sql("SELECT * FROM copies", "predictions", extra={"copies": sql_oversample("predictions", "y_true", "id", 0.3)}),
)
def oversample(t: Tables):
    """Copies of each row after the smaller classes were raised to 30%."""
    rows = t.predictions.select("id", F.col("y_true").alias("label"))
    out = sp.oversample(rows, "label", "id", 0.3)
    return out.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "task_mix_m7",
    sql(
        f"""SELECT sentence_id, source FROM sentences WHERE lang = 'es'
            UNION ALL
            SELECT sentence_id, source FROM (SELECT * FROM sentences WHERE lang = 'en'
                ORDER BY {KEY42}, sentence_id
                LIMIT (SELECT 3 * count(*) FROM sentences WHERE lang = 'es'))""",
        "sentences",
    ),
)
def task_mix(t: Tables):
    rows = t.sentences.select("sentence_id", "source", "lang")
    out = sp.mix_tasks(rows.filter("lang = 'en'"), rows.filter("lang = 'es'"), "sentence_id")
    return out.select("sentence_id", "source")


# The labelled texts without copies, split 90/10 by language and label.
TRAINING_HALVES = {
    "firsts": f"""SELECT p.id, p.y_true AS label, 'train' AS split, {LANG.replace("lang", "p.lang")} || '__' || p.y_true AS stratum
        FROM predictions p JOIN documents d ON p.id = CAST(d.doc_id AS VARCHAR)
        QUALIFY row_number() OVER (PARTITION BY {sql_clean('d.text')} ORDER BY d.doc_id) = 1""",
    "halves": sql_split("firsts", "stratum", 0.1, "id", "test", "split = 'train'"),
}


@query(
    "training_rows_m4_w2_w7_a9",
    sql(
        """SELECT split, label, count(*) AS rows, sum(n)::BIGINT AS copies FROM (
             SELECT 'train' AS split, label, n FROM copies
             UNION ALL SELECT split, label, 1 FROM halves WHERE split = 'test') GROUP BY 1, 2""",
        "predictions",
        extra={
            **TRAINING_HALVES,
            "train": "SELECT * FROM halves WHERE split = 'train'",
            "copies": sql_oversample("train", "label", "id", 0.3),
        },
    ),
)
def training_rows(t: Tables):
    """Dedup on the normalised text, split 90/10 by language and label, oversample the train rows."""
    text = t.sentences.select(F.col("sentence_id").alias("id"), "text", "row_order")
    rows = t.predictions.select("id", F.col("y_true").alias("label"), "lang").join(text, "id")
    rows = drop_duplicates_first(rows, {"text": T.text_key(F.col("text"))}).drop("text")
    rows = rows.withColumn("stratum", L.stratum_key(T.language_label(F.col("lang")), F.col("label")))
    halves = sp.train_test_split(materialize(rows, "training-rows"), "stratum", "id")
    train = sp.oversample(halves.filter("split = 'train'"), "label", "id", 0.3)
    both = train.unionByName(halves.filter("split = 'test'"))
    return both.groupBy("split", "label").agg(
        F.countDistinct("id").alias("rows"), F.count(F.lit(1)).alias("copies")
    )
