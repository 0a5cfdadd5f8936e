"""Streaming queries: run to the end of the available input, then read what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.catalog.expressions import MARKED, SHORT
from labelflow.catalog.monitor import DAY, HOUR, mean6, sql_alerts, sql_mean6, sql_sliding, sql_stamp, sql_windows, stamp
from labelflow.catalog.registry import query
from labelflow.catalog.scored import CLASSES, INTERCEPT, LEXICON, sql_scored
from labelflow.catalog.views import Tables, r6, sql, sql_clean
from labelflow.functions.text import text_key
from labelflow.operators import monitoring as mo
from labelflow.session import scratch_path
from labelflow.sources.readers import REQUEST_SCHEMA
from labelflow.streaming import history as sh
from labelflow.streaming import requests as sr
from labelflow.streaming import scoring as ss

# A window is closed once the watermark (latest event minus ten minutes) has passed its end.
CLOSED = "start + to_seconds({s}) <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM requests)"


def request_stream(t: Tables):
    path = scratch_path(t.spark, "requests")
    t.requests.write.parquet(path)
    return sr.read_requests(t.spark, path, REQUEST_SCHEMA)


def closed_windows(t: Tables, width: int, slide: int | None, by, buckets: bool = False):
    windows = sr.streaming_windows(request_stream(t), width, slide, by, buckets=buckets)
    path = scratch_path(t.spark, "windows")
    sr.write_closed_windows(windows, path, path + "-checkpoint").awaitTermination()
    return t.spark.read.schema(windows.schema).parquet(path)


@query(
    "streaming_windows_r15",
    sql(
        f"""SELECT {sql_stamp('start')} AS start, endpoint, n, n_5xx, {sql_mean6('latency_sum / n')} AS avg_latency
            FROM w WHERE {CLOSED.format(s=DAY)}""",
        "requests",
        extra={"w": sql_windows("day", "endpoint")},
    ),
)
def streaming_windows(t: Tables):
    out = mo.average_latency(closed_windows(t, DAY, None, ["endpoint"]))
    return out.select(stamp(), "endpoint", "n", "n_5xx", mean6(F.col("avg_latency")).alias("avg_latency"))


@query(
    "streaming_sliding_r15",
    sql(
        f"""SELECT {sql_stamp('start')} AS start, endpoint, n, n_5xx, {sql_mean6('latency_sum / n')} AS avg_latency
            FROM w WHERE {CLOSED.format(s=DAY)}""",
        "requests",
        extra={"w": sql_sliding(1, 24, "endpoint")},
    ),
)
def streaming_sliding(t: Tables):
    """Days that begin every hour: hourly sums, then 24 of them per window."""
    out = mo.average_latency(closed_windows(t, DAY, HOUR, ["endpoint"]))
    return out.select(stamp(), "endpoint", "n", "n_5xx", mean6(F.col("avg_latency")).alias("avg_latency"))


@query(
    "streaming_quantiles_r15_r9",
    sql(
        f"""SELECT {sql_stamp('start')} AS start, n, round(quantile_disc(b, 0.95), 6) AS p95_bucket
            FROM (SELECT start, n, unnest(list_transform(lat, lambda x: list_min(list_filter(
                    {list(mo.LES)}::DOUBLE[], lambda le: le >= x)))) AS b FROM w WHERE {CLOSED.format(s=DAY)})
            GROUP BY 1, 2""",
        "requests",
        extra={"w": sql_windows("day")},
    ),
)
def streaming_quantiles(t: Tables):
    """Upper bound of the bucket that holds the 95th percentile, per closed day."""
    w = mo.cumulative_buckets(closed_windows(t, DAY, None, [], buckets=True))
    les = F.array(*[F.lit(x) for x in mo.LES])
    rank = F.ceil(F.element_at("cum", -1) * F.lit(0.95))
    hit = F.array_position(F.transform("cum", lambda c: c >= rank), True).cast("int")
    return w.select(stamp(), "n", r6(F.get(les, hit - 1)).alias("p95_bucket"))


@query(
    "streaming_alerts_r16",
    sql(
        f"""SELECT endpoint, since, {sql_stamp("since::TIMESTAMP + to_seconds(" + str(DAY) + ")")} AS fired_at
            FROM ({sql_alerts('w', "n_5xx::DOUBLE / n > 0.22 AND " + CLOSED.format(s=DAY), 'endpoint', DAY, DAY)})
            WHERE firing""",
        "requests",
        extra={"w": sql_windows("day", "endpoint")},
    ),
)
def streaming_alerts(t: Tables):
    windows = sr.streaming_windows(request_stream(t), DAY, None, ["endpoint"])
    folder = scratch_path(t.spark, "alerts")
    high = F.col("n_5xx") / F.col("n") > 0.22
    sr.alert_stream(windows, folder, high, DAY, DAY).awaitTermination()
    alerts = t.spark.read.schema("endpoint string, since timestamp, fired_at timestamp").parquet(f"{folder}/alerts")
    return alerts.select("endpoint", stamp("since"), stamp("fired_at"))


@query(
    "streaming_scores_r17",
    sql(
        f"""SELECT CASE WHEN {SHORT} THEN 'en' WHEN {MARKED} THEN 'vi' ELSE 'en' END AS lang,
                   CASE WHEN {SHORT} THEN 0.0 WHEN {MARKED} THEN 0.99 ELSE 0.75 END::DOUBLE AS lang_confidence,
                   s.sentiment, s.confidence
            FROM uniq u JOIN scored s ON u.id = s.id""",
        "cleaned",
        extra={"uniq": "SELECT DISTINCT md5(text) AS id, text FROM cleaned", **sql_scored("uniq", "id")},
    ),
)
def streaming_scores(t: Tables):
    """All sentences as one stream batch. Copies score alike, so it does not matter which one is kept."""
    path = scratch_path(t.spark, "texts")
    rows = t.sentences.select("sentence_id", "text", F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    rows.write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    scored = ss.score_stream(stream, LEXICON, CLASSES, INTERCEPT)
    out = scratch_path(t.spark, "scores")
    sr.write_closed_windows(scored, out, out + "-checkpoint").awaitTermination()
    done = t.spark.read.schema(scored.schema).parquet(out)
    return done.select("lang", "lang_confidence", "sentiment", "confidence")


@query(
    "streaming_history_r17",
    sql(
        f"""SELECT md5(k) AS text_key, min(part)::INTEGER AS part FROM (
                SELECT {sql_clean("coalesce(text, 'nan')")} AS k, row_order % 3 AS part FROM sentences) GROUP BY 1""",
        "sentences",
    ),
)
def streaming_history(t: Tables):
    """Sentences in three parts, a day apart: copies in later parts are dropped, long after the watermark has passed."""
    path, folder = scratch_path(t.spark, "parts"), scratch_path(t.spark, "history")
    for part in range(3):
        stamped = t.sentences.where(F.col("row_order") % 3 == part).select(
            "row_order", "text", F.lit(part).alias("part"), F.timestamp_seconds(F.lit(1_700_000_000 + part * DAY)).alias("ts")
        )
        stamped.write.parquet(f"{path}/part={part}")
        stream = t.spark.readStream.schema(stamped.schema).parquet(path)
        sh.first_copies(stream, folder, "row_order").awaitTermination()
    done = t.spark.read.schema(stamped.schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    return done.select(F.md5(text_key(F.col("text"))).alias("text_key"), "part")
