"""Request-log queries. Events are sparse, so windows here are hours and days; lengths are parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.catalog.registry import query
from labelflow.catalog.views import Tables, r6, sql
from labelflow.functions import vocab
from labelflow.operators import monitoring as mo
from labelflow.operators.balance import value_counts
from labelflow.operators.quantiles import exact_quantiles
from labelflow.operators.scoring import run_summary

HOUR, DAY = 3600, 86400
STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(c="start"):
    return F.date_format(c, STAMP).alias(c if isinstance(c, str) else "start")


def mean6(c):
    """Rounded mean of decimal inputs; the small shift keeps exact halves from depending on summing order."""
    return F.round(c + 1e-9, 6)


def sql_mean6(expr: str) -> str:
    return f"round({expr} + 1e-9::DOUBLE, 6)"


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def sql_windows(unit: str, by: str = "", where: str = "true") -> str:
    """Tumbling window sums, one row per (start, by)."""
    keys = f", {by}" if by else ""
    return f"""
        SELECT date_trunc('{unit}', ts) AS start{keys}, count(*) AS n,
               count(*) FILTER (http_status // 100 = 2) AS n_2xx, count(*) FILTER (http_status // 100 = 4) AS n_4xx,
               count(*) FILTER (http_status // 100 = 5) AS n_5xx, sum(latency_s) AS latency_sum,
               list(latency_s) AS lat
        FROM requests WHERE {where} GROUP BY ALL"""


def sql_sliding(step_h: int, width_h: int, by: str = "") -> str:
    """Sliding window sums: every event counted into each window that covers it."""
    keys = f", {by}" if by else ""
    k = width_h // step_h
    return f"""
        SELECT start{keys}, count(*) AS n, count(*) FILTER (http_status // 100 = 5) AS n_5xx,
               count(*) FILTER (http_status // 100 = 4) AS n_4xx, sum(latency_s) AS latency_sum
        FROM (SELECT r.*, time_bucket(INTERVAL '{step_h} hours', ts, TIMESTAMP '1970-01-01')
                     - to_hours(({step_h} * i)::BIGINT) AS start
              FROM requests r, (SELECT unnest(range({k})) AS i)) GROUP BY ALL"""


@query(
    "request_counter_r1",
    sql("SELECT method, endpoint, http_status, count(*) AS n FROM requests GROUP BY 1, 2, 3", "requests"),
)
def request_counter(t: Tables):
    return mo.request_counter(t.requests)


@query(
    "request_rate_r2",
    sql(
        f"SELECT {sql_stamp('start')} AS start, n, round(n / 3600.0::DOUBLE, 6) AS rate FROM w",
        "requests",
        extra={"w": sql_windows("hour")},
    ),
)
def request_rate(t: Tables):
    out = mo.request_rate(mo.request_windows(t.requests, HOUR), HOUR)
    return out.select(stamp(), "n", r6(F.col("rate")).alias("rate"))


@query(
    "endpoint_rate_r3",
    sql(
        f"SELECT {sql_stamp('start')} AS start, endpoint, n, round(n / 3600.0::DOUBLE, 6) AS rate FROM w",
        "requests",
        extra={"w": sql_windows("hour", "endpoint")},
    ),
)
def endpoint_rate(t: Tables):
    out = mo.request_rate(mo.request_windows(t.requests, HOUR, by=["endpoint"]), HOUR)
    return out.select(stamp(), "endpoint", "n", r6(F.col("rate")).alias("rate"))


@query(
    "status_volume_r4",
    sql(
        f"""SELECT {sql_stamp('start')} AS start, c AS status_class, n, round(n / 86400.0::DOUBLE, 9) AS rate FROM (
              SELECT start, '2xx' AS c, n_2xx AS n FROM w UNION ALL SELECT start, '4xx', n_4xx FROM w
              UNION ALL SELECT start, '5xx', n_5xx FROM w)""",
        "requests",
        extra={"w": sql_windows("day")},
    ),
)
def status_volume(t: Tables):
    out = mo.status_volume(mo.request_windows(t.requests, DAY), DAY)
    return out.select(stamp(), "status_class", "n", F.round("rate", 9).alias("rate"))


@query(
    "error_ratio_r5",
    sql(
        f"""SELECT {sql_stamp('start')} AS start, n, n_5xx, round(n_5xx::DOUBLE / n, 6) AS error_ratio FROM w""",
        "requests",
        extra={"w": sql_sliding(1, 6)},
    ),
)
def error_ratio(t: Tables):
    out = mo.error_ratio(mo.request_windows(t.requests, 6 * HOUR, HOUR))
    return out.select(stamp(), "n", "n_5xx", r6(F.col("error_ratio")).alias("error_ratio"))


@query(
    "endpoint_errors_r6",
    sql(
        f"""SELECT {sql_stamp('start')} AS start, endpoint, round(n_4xx / 3600.0::DOUBLE, 9) AS rate_4xx,
                   round(n_5xx / 3600.0::DOUBLE, 9) AS rate_5xx FROM w""",
        "requests",
        extra={"w": sql_windows("hour", "endpoint")},
    ),
)
def endpoint_errors(t: Tables):
    w = mo.request_windows(t.requests, HOUR, by=["endpoint"])
    out = mo.request_rate(mo.request_rate(w, HOUR, "n_4xx", "rate_4xx"), HOUR, "n_5xx", "rate_5xx")
    return out.select(
        stamp(), "endpoint", F.round("rate_4xx", 9).alias("rate_4xx"), F.round("rate_5xx", 9).alias("rate_5xx")
    )


@query(
    "average_latency_r7",
    sql(
        f"""SELECT {sql_stamp('start')} AS start, endpoint, {sql_mean6('latency_sum / n')} AS avg_latency FROM w""",
        "requests",
        extra={"w": sql_sliding(2, 6, "endpoint")},
    ),
)
def average_latency(t: Tables):
    out = mo.average_latency(mo.request_windows(t.requests, 6 * HOUR, 2 * HOUR, ["endpoint"]))
    return out.select(stamp(), "endpoint", mean6(F.col("avg_latency")).alias("avg_latency"))


BOUNDS = "[" + ", ".join(f"{b}::DOUBLE" for b in vocab.LATENCY_BUCKETS) + "]"
LAST = vocab.LATENCY_BUCKETS[-1]


@query(
    "latency_histogram_r8",
    sql(
        f"""SELECT endpoint, le, n FROM (
              SELECT endpoint, b::VARCHAR AS le, count(*) FILTER (latency_s <= b) AS n
              FROM requests, (SELECT unnest({BOUNDS}) AS b) GROUP BY 1, b
              UNION ALL SELECT endpoint, '+Inf', count(*) FROM requests GROUP BY 1)""",
        "requests",
    ),
)
def latency_histogram(t: Tables):
    return mo.histogram_rows(mo.latency_histogram(t.requests, ["endpoint"]), ["endpoint"])


def sql_quantiles(windows: str, keys: str, qs=(0.5, 0.95, 0.99)) -> str:
    """Histogram quantiles from the raw latencies in ``lat`` lists."""
    cols = ", ".join(
        f"max(CASE WHEN q = {q} THEN v END) AS p{round(q * 100)}" for q in qs
    )
    return f"""
        SELECT {keys}, {cols} FROM (
          SELECT {keys}, q, CASE WHEN hit IS NULL THEN {LAST}::DOUBLE
                 ELSE lo + (les[hit] - lo) * (rank - below) / (cum[hit] - below) END AS v
          FROM (SELECT *, CASE WHEN hit > 1 THEN les[hit - 1] ELSE 0 END AS lo,
                       CASE WHEN hit > 1 THEN cum[hit - 1] ELSE 0 END AS below
                FROM (SELECT *, list_position(list_transform(cum, lambda c: c >= rank), true) AS hit
                      FROM (SELECT {keys}, q, les, n * q AS rank, list_transform(les, lambda b:
                                   len(list_filter(lat, lambda x: x <= b))::DOUBLE) AS cum
                            FROM (SELECT *, {BOUNDS} AS les FROM {windows}),
                                 (SELECT unnest({list(qs)}::DOUBLE[]) AS q)))))
        GROUP BY {keys}"""


@query(
    "latency_quantiles_r9",
    sql(
        f"""SELECT {sql_stamp('start')} AS start, endpoint, round(p50, 6) AS p50, round(p95, 6) AS p95,
                   round(p99, 6) AS p99 FROM qs""",
        "requests",
        extra={"w": sql_windows("day", "endpoint"), "qs": sql_quantiles("w", "start, endpoint")},
    ),
)
def latency_quantiles(t: Tables):
    w = mo.cumulative_buckets(mo.request_windows(t.requests, DAY, by=["endpoint"], buckets=True))
    return w.select(
        stamp(),
        "endpoint",
        *[r6(mo.histogram_quantile(q)).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)],
    )


@query(
    "inference_latency_r10_p12",
    sql(
        f"""SELECT {sql_stamp('w.start')} AS start, w.lang, w.n, round(w.n / 86400.0::DOUBLE, 9) AS calls_per_s,
                   {sql_mean6('latency_sum / w.n')} AS avg_latency, round(p95, 6) AS p95
            FROM w JOIN qs ON w.start = qs.start AND w.lang = qs.lang""",
        "requests",
        extra={
            "labelled": "SELECT * REPLACE (CASE WHEN lang IN ('en', 'vi') THEN lang ELSE 'other' END AS lang) FROM requests",
            "w": sql_windows("day", "lang").replace("FROM requests", "FROM labelled"),
            "qs": sql_quantiles("w", "start, lang", (0.95,)),
        },
    ),
)
def inference_latency(t: Tables):
    w = mo.cumulative_buckets(mo.inference_windows(t.requests, DAY))
    out = mo.average_latency(mo.request_rate(w, DAY, out="calls_per_s"))
    return out.select(
        stamp(),
        "lang",
        "n",
        F.round("calls_per_s", 9).alias("calls_per_s"),
        mean6(F.col("avg_latency")).alias("avg_latency"),
        r6(mo.histogram_quantile(0.95)).alias("p95"),
    )


@query(
    "requests_24h_r11",
    sql(
        f"SELECT {sql_stamp('start')} AS start, n FROM w",
        "requests",
        extra={"w": sql_sliding(1, 24)},
    ),
)
def requests_24h(t: Tables):
    return mo.request_windows(t.requests, DAY, HOUR).select(stamp(), "n")


def sql_alerts(series: str, condition: str, keys: str, step_s: int, hold_s: int) -> str:
    """Gaps and islands over true steps."""
    return f"""
        SELECT {keys}, {sql_stamp('min(start)')} AS since, {sql_stamp('max(start)')} AS until,
               date_diff('second', min(start), max(start)) AS held_s,
               date_diff('second', min(start), max(start)) >= {hold_s} AS firing
        FROM (SELECT *, epoch(start)::BIGINT // {step_s} - row_number() OVER (PARTITION BY {keys} ORDER BY start) AS island
              FROM {series} WHERE {condition})
        GROUP BY {keys}, island"""


def alert_columns(df, *by):
    return df.select(*by, stamp("since"), stamp("until"), "held_s", "firing")


@query(
    "high_error_rate_r12_w9",
    sql(
        sql_alerts("w", "n_5xx::DOUBLE / n > 0.22", "endpoint", DAY, DAY),
        "requests",
        extra={"w": sql_windows("day", "endpoint")},
    ),
)
def high_error_rate(t: Tables):
    return alert_columns(mo.error_rate_alert(t.requests, DAY, DAY, 0.22, DAY), "endpoint")


@query(
    "high_error_rate_sliding_r12_w9",
    sql(
        sql_alerts("w", "n_5xx::DOUBLE / n > 0.25", "endpoint", HOUR, 2 * HOUR),
        "requests",
        extra={"w": sql_sliding(1, 12, "endpoint")},
    ),
)
def high_error_rate_sliding(t: Tables):
    out = mo.error_rate_alert(t.requests, 12 * HOUR, HOUR, 0.25, 2 * HOUR)
    return alert_columns(out, "endpoint")


RUNNING = """SELECT start, lang, sum(latency_sum) OVER g / sum(n) OVER g AS lifetime_avg FROM w
    WINDOW g AS (PARTITION BY lang ORDER BY start ROWS UNBOUNDED PRECEDING)"""


@query(
    "running_average_w10",
    sql(
        f"SELECT {sql_stamp('start')} AS start, lang, {sql_mean6('lifetime_avg')} AS lifetime_avg FROM ra",
        "requests",
        extra={"w": sql_windows("hour", "lang"), "ra": RUNNING},
    ),
)
def running_average(t: Tables):
    out = mo.running_average(mo.request_windows(t.requests, HOUR, by=["lang"]), ["lang"])
    return out.select(stamp(), "lang", mean6(F.col("lifetime_avg")).alias("lifetime_avg"))


@query(
    "high_inference_latency_r13_w9_w10",
    sql(
        sql_alerts("ra", "lifetime_avg > 0.5", "lang", DAY, 2 * DAY),
        "requests",
        extra={"w": sql_windows("day", "lang"), "ra": RUNNING},
    ),
)
def high_inference_latency(t: Tables):
    return alert_columns(mo.latency_alert(t.requests, DAY, 0.5, 2 * DAY), "lang")


def _sql_band(v: str, bands) -> str:
    return f"CASE WHEN {v} >= {bands[1]} THEN 'red' WHEN {v} >= {bands[0]} THEN 'yellow' ELSE 'green' END"


@query(
    "panel_bands_r14",
    sql(
        f"""SELECT {sql_stamp('start')} AS start, {_sql_band('n::DOUBLE', (10.0, 20.0))} AS rate_band,
                   {_sql_band('n_5xx::DOUBLE / n', (0.05, 0.1))} AS error_band,
                   {_sql_band('latency_sum / n', (0.1, 0.2))} AS latency_band,
                   {_sql_band('latency_sum / n', (0.3, 0.5))} AS inference_band FROM w""",
        "requests",
        extra={"w": sql_windows("hour")},
    ),
)
def panel_bands(t: Tables):
    """The sparse log never reaches the panel's rate limits, so requests per hour are banded at 10 and 20."""
    w = mo.error_ratio(mo.average_latency(mo.request_windows(t.requests, HOUR)))
    return w.select(
        stamp(),
        mo.color_band(F.col("n").cast("double"), (10.0, 20.0)).alias("rate_band"),
        mo.color_band(F.col("error_ratio"), vocab.ERROR_BANDS).alias("error_band"),
        mo.color_band(F.col("avg_latency"), vocab.LATENCY_BANDS).alias("latency_band"),
        mo.color_band(F.col("avg_latency"), vocab.INFERENCE_BANDS).alias("inference_band"),
    )


@query(
    "error_share_drift_r18",
    sql(
        """SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n,
                  round(avg((http_status = 500)::INT), 6) AS share FROM requests GROUP BY 1""",
        "requests",
    ),
)
def error_share_drift(t: Tables):
    rows = t.requests.withColumn("status", F.col("http_status").cast("string"))
    out = mo.label_share(rows, F.date_format("ts", "yyyy-MM-dd"), "status", "500")
    return out.withColumn("share", r6(F.col("share")))


def sql_shift(source: str, bins: list[str], reference: str) -> str:
    k = len(bins)
    return f"""
        SELECT a.period, any_value(a.n) AS n, round(sum((a.p - b.p) * ln(a.p / b.p)), 6) AS shift
        FROM shares a JOIN shares b ON a.bin = b.bin AND b.period = '{reference}' GROUP BY 1""", {
        "shares": f"""
            SELECT t.period, t.n, x.bin, ((SELECT count(*) FROM {source} s WHERE s.period = t.period AND s.bin = x.bin)
                   + 0.5::DOUBLE) / (t.n + {0.5 * k}::DOUBLE) AS p
            FROM (SELECT period, count(*) AS n FROM {source} GROUP BY 1) t, (SELECT unnest({bins}) AS bin) x"""
    }


SENTIMENT_SHIFT = sql_shift("src", list(vocab.SENTIMENTS), "src0")


@query(
    "label_shift_r18",
    sql(
        SENTIMENT_SHIFT[0],
        "predictions",
        extra={"src": "SELECT source AS period, y_pred AS bin FROM predictions", **SENTIMENT_SHIFT[1]},
    ),
)
def label_shift(t: Tables):
    """Predicted-label distribution of each source against source ``src0``."""
    out = mo.population_shift(t.predictions, F.col("source"), F.col("y_pred"), "src0", vocab.SENTIMENTS)
    return out.withColumn("shift", r6(F.col("shift")))


LENGTH_BINS = ["0-99", "100-499", "500-1999", "2000+"]
LENGTH_SHIFT = sql_shift("src", LENGTH_BINS, "train")


def length_bin(c):
    return (
        F.when(c < 100, LENGTH_BINS[0]).when(c < 500, LENGTH_BINS[1]).when(c < 2000, LENGTH_BINS[2]).otherwise(LENGTH_BINS[3])
    )


@query(
    "length_shift_r18",
    sql(
        LENGTH_SHIFT[0],
        "sentences",
        extra={
            "src": """SELECT split AS period, CASE WHEN length(text) < 100 THEN '0-99' WHEN length(text) < 500
                THEN '100-499' WHEN length(text) < 2000 THEN '500-1999' ELSE '2000+' END AS bin FROM sentences""",
            **LENGTH_SHIFT[1],
        },
    ),
)
def length_shift(t: Tables):
    out = mo.population_shift(
        t.sentences, F.col("split"), length_bin(F.length("text")), "train", LENGTH_BINS
    )
    return out.withColumn("shift", r6(F.col("shift")))


@query(
    "length_distance_r18",
    sql(
        """SELECT period, max(n)::BIGINT AS n, max(m)::BIGINT AS n_reference, round(max(abs(ck / n - cb / m)), 9) AS distance
           FROM (SELECT period, n, m, CAST(sum(k) OVER w AS DOUBLE) AS ck, CAST(sum(b) OVER w AS DOUBLE) AS cb
                        FROM (SELECT p.period, v.value, coalesce(c.k, 0) AS k, coalesce(r.k, 0) AS b,
                                     sum(coalesce(c.k, 0)) OVER (PARTITION BY p.period) AS n,
                                     sum(coalesce(r.k, 0)) OVER (PARTITION BY p.period) AS m
                              FROM (SELECT DISTINCT period FROM counts) p CROSS JOIN (SELECT DISTINCT value FROM counts) v
                              LEFT JOIN counts c ON c.period = p.period AND c.value = v.value
                              LEFT JOIN counts r ON r.period = 'en' AND r.value = v.value)
                 WINDOW w AS (PARTITION BY period ORDER BY value))
           GROUP BY 1""",
        "sentences",
        extra={"counts": "SELECT lang AS period, length(text) AS value, count(*) AS k FROM sentences WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2"},
    ),
)
def length_distance(t: Tables):
    """How far text lengths of each language lie from those of English, without bins."""
    out = mo.distribution_distance(t.sentences, F.col("lang"), F.length("text"), "en")
    return out.select("period", "n", "n_reference", F.round("distance", 9).alias("distance"))


@query(
    "latency_summary_a34",
    sql(
        """SELECT endpoint, q, round(quantile_cont(latency_s, q), 6) AS quantile FROM requests,
             (SELECT unnest([0.5, 0.95]::DOUBLE[]) AS q) GROUP BY 1, 2""".replace(
            "quantile_cont(latency_s, q)",
            "CASE WHEN q = 0.5 THEN quantile_cont(latency_s, 0.5) ELSE quantile_cont(latency_s, 0.95) END",
        ),
        "requests",
    ),
)
def latency_summary(t: Tables):
    """Exact p50 and p95 per endpoint."""
    out = exact_quantiles(t.requests, "latency_s", (0.5, 0.95), ["endpoint"])
    return out.select("endpoint", "q", r6(F.col("quantile")).alias("quantile"))


@query(
    "throughput_summary_a34",
    sql(
        f"""SELECT count(*) AS runs, {sql_mean6('avg(latency_s)')} AS mean_s,
                  round(1000.0::DOUBLE / avg(latency_s), 4) AS samples_per_s FROM requests""",
        "requests",
    ),
)
def throughput_summary(t: Tables):
    out = run_summary(t.requests, "latency_s", 1000)
    return out.select("runs", mean6(F.col("mean_s")).alias("mean_s"), F.round("samples_per_s", 4).alias("samples_per_s"))


@query(
    "status_shares_a2",
    sql(
        """SELECT endpoint, http_status::VARCHAR AS label, count(*) AS n,
                  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY endpoint), 6) AS pct
           FROM requests GROUP BY 1, 2""",
        "requests",
    ),
)
def status_shares(t: Tables):
    return value_counts(t.requests, "http_status", ["endpoint"]).withColumn("pct", r6(F.col("pct")))
