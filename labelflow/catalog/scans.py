"""Sources and sinks. Files are written to the session's shared folder, then scanned back whole."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.catalog.registry import query
from labelflow.catalog.views import Tables, sql
from labelflow.functions import vocab
from labelflow.operators import sampling as sp
from labelflow.sources import readers as rd
from labelflow.sources import sinks as sk
from labelflow.session import scratch_path

NOT_XML = r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}]"


@query(
    "review_xml_scan_s1",
    sql(
        """SELECT s.split, s.sentence_id, a.aspect_category, a.sentiment
           FROM sentences s LEFT JOIN (
               SELECT sentence_id, aspect_category, sentiment FROM aspects WHERE sentiment <> 'neutral') a
           USING (sentence_id)""",
        "sentences",
        "aspects",
    ),
)
def review_xml_scan(t: Tables):
    """Reviews written as XML (neutral polarity spelled as one of the "no label" words), read back."""
    polarity = F.when(F.col("sentiment") == "neutral", " None ").otherwise(F.col("sentiment"))
    tags = t.aspects.groupBy("sentence_id").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("aspect_category").alias("_category"), polarity.alias("_polarity")))
        ).alias("aspectCategory")
    )
    path = scratch_path(t.spark, "reviews-xml")
    rows = t.sentences.join(tags, "sentence_id", "left").select(
        F.col("sentence_id").alias("_id"),
        F.regexp_replace("text", NOT_XML, "").alias("text"),
        F.struct("aspectCategory").alias("aspectCategories"),
        "split",
    )
    writer = rows.write.format("xml").option("rootTag", "sentences").option("rowTag", "sentence")
    writer.partitionBy("split").save(path)
    read = rd.read_review_xml(
        t.spark, {s: f"{path}/split={s}" for s in ("train", "test", "missing")}
    )
    return read.sentences.select("split", "sentence_id").join(
        read.aspects.drop("row_order"), "sentence_id", "left"
    )


@query(
    "csv_roundtrip_s2_k1",
    sql(
        """SELECT sentence_id, split, sentiment, md5(text) AS text_md5, row_order::VARCHAR AS row_order
           FROM dirty_sentences""",
        "dirty_sentences",
    ),
)
def csv_roundtrip(t: Tables):
    columns = ["row_order", "sentence_id", "text", "sentiment", "split"]
    path = scratch_path(t.spark, "sentences-csv")
    sk.write_csv(t.dirty.sentences, path, columns)
    rows = rd.read_csv(t.spark, path, columns)
    return rows.select("sentence_id", "split", "sentiment", F.md5("text").alias("text_md5"), "row_order")


@query(
    "typed_csv_scan_s3",
    sql(
        """SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(confidence) AS top
           FROM (SELECT s.lang, s.n_chars, p.confidence FROM sentences s
                 JOIN predictions p ON s.sentence_id = p.id) GROUP BY 1""",
        "sentences",
        "predictions",
    ),
)
def typed_csv_scan(t: Tables):
    schema = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
    path = scratch_path(t.spark, "predictions-csv")
    chars = t.sentences.select(F.col("sentence_id").alias("id"), "n_chars")
    sk.write_csv(t.predictions.join(chars, "id"), path, schema.names)
    rows = rd.read_csv(t.spark, path, schema, multi_line=False)
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("confidence").alias("top")
    )


@query(
    "split_parquet_scan_s4_p7",
    sql(
        "SELECT sentence_id, md5(text) AS text_md5, split FROM sentences WHERE split = 'test'", "sentences"
    ),
)
def split_parquet_scan(t: Tables):
    path = scratch_path(t.spark, "sentences-by-split")
    sk.write_table(t.sentences, path)
    globs = {s: f"{path}/split={s}/*.parquet" for s in ("train", "test")}
    rows = rd.select_split(rd.read_splits(t.spark, globs), "test")
    return rows.select("sentence_id", F.md5("text").alias("text_md5"), "split")


@query(
    "irony_splits_s5_t5",
    sql(
        """SELECT md5(text) AS text_md5, label, 'en' AS lang, split, 'tweet_eval_irony' AS source
           FROM coded_en""",
        "coded_en",
    ),
)
def irony_splits(t: Tables):
    rows = t.coded_en
    parts = {s: rows.filter(F.col("split") == s) for s in ("train", "test")}
    out = rd.union_splits(t.spark, parts, "en", "tweet_eval_irony")
    return out.select(F.md5("text").alias("text_md5"), "label", "lang", "split", "source")


VI = "CASE sentiment WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END"
EN = "CASE label WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' END"


@query(
    "vietnamese_labels_s6_p4",
    sql(f"SELECT sentence_id, {VI} AS label, split FROM coded_vi", "coded_vi"),
)
def vietnamese_labels(t: Tables):
    rows = rd.decode_labels(t.coded_vi, "sentiment", vocab.VI_CODES, "raise")
    return rows.select("sentence_id", F.col("sentiment").alias("label"), "split")


@query(
    "sentiment_sources_s7_t5",
    sql(
        f"""SELECT lang, source, split, label, count(*) AS n FROM (
              SELECT 'en' AS lang, 'multilingual_sentiments' AS source, split, {EN} AS label FROM coded_en
              UNION ALL SELECT 'vi', 'uit_vsfc', split, {VI} FROM coded_vi) GROUP BY ALL""",
        "coded_en",
        "coded_vi",
    ),
)
def sentiment_sources(t: Tables):
    rows = rd.sentiment_union(t.coded_en, t.coded_vi)
    return rows.groupBy("lang", "source", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "request_events_s8",
    sql(
        """SELECT method, endpoint, http_status, lang, count(*) AS n, min(latency_s) AS low,
                  max(latency_s) AS high FROM requests GROUP BY ALL""",
        "requests",
    ),
)
def request_events(t: Tables):
    return t.requests.groupBy("method", "endpoint", "http_status", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.min("latency_s").alias("low"), F.max("latency_s").alias("high")
    )


@query(
    "upload_scan_s9_w4",
    sql(
        "SELECT row_order, sentence_id, md5(text) AS text_md5 FROM sentences",
        "sentences",
    ),
)
def upload_scan(t: Tables):
    """Every row of an uploaded file; the upload's own cap is ``first_rows_w4``."""
    path = scratch_path(t.spark, "upload-csv")
    columns = ["row_order", "sentence_id", "text"]
    sk.write_csv(t.sentences, path, columns)
    rows = rd.read_upload(t.spark, path, columns)
    return rows.select(F.col("row_order").cast("long").alias("row_order"), "sentence_id", F.md5("text").alias("text_md5"))


@query(
    "optional_inputs_s10",
    sql("SELECT lang, count(*) AS n FROM documents GROUP BY 1"),
)
def optional_inputs(t: Tables):
    """One input exists, the other does not and is skipped."""
    read = lambda path: t.spark.read.parquet(path)
    parts = rd.read_optional(
        t.spark, {"en": (t.path("documents"), read), "vi": (t.path("documents_vi"), read)}
    )
    return rd.union(parts).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "run_log_k3",
    sql(
        """SELECT split || '_samples' AS key, count(*)::DOUBLE AS value_num FROM sentences GROUP BY split
           UNION ALL SELECT 'total_samples', count(*)::DOUBLE FROM sentences
           UNION ALL SELECT split || '_null_ratio', 0.0::DOUBLE FROM sentences GROUP BY split
           UNION ALL SELECT 'passed_quality_checks', 1.0::DOUBLE""",
        "sentences",
    ),
)
def run_log(t: Tables):
    splits = t.sentences.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.col("text").isNull().cast("double")).alias("null_ratio"),
    )
    path = scratch_path(t.spark, "run-log")
    rows = sk.metric_log_rows(sk.quality_metrics(splits, True), "data_preprocessing", "run-1")
    for _ in range(2):  # a repeated run replaces its own rows
        sk.append_run_log(rows, path)
    log = sk.read_run_log(t.spark, path).filter("experiment = 'data_preprocessing' AND kind = 'metric'")
    return log.select("key", "value_num")
