import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelflow.operators import monitoring as mo
from labelflow.sources.readers import REQUEST_SCHEMA
from labelflow.streaming import history as sh
from labelflow.streaming import requests as sr
from labelflow.streaming import scoring as ss

T0 = dt.datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, REQUEST_SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def event(minute, status=200, endpoint="/predict", latency=0.5):
    return (T0 + dt.timedelta(minutes=minute), "POST", endpoint, status, latency, "en")


@pytest.fixture
def request_files(spark, tmp_path):
    """Three files, read one per batch: the errors of /predict last from minute 5 to 24."""
    folder = str(tmp_path / "in")
    for part in range(3):
        rows = []
        for m in range(part * 20, part * 20 + 20):
            rows += [event(m, 500 if 5 <= m < 25 else 200), event(m, 200, "/explain")]
        if part == 2:
            rows.append(event(1, 500))  # far too late
        write(spark, folder, f"f{part}.parquet", rows)
    return folder


def stream(spark, folder):
    return sr.read_requests(
        spark, folder + "/*", REQUEST_SCHEMA, maxFilesPerTrigger="1", recursiveFileLookup="true"
    )


def test_windows_match_batch_without_the_late_row(spark, request_files, tmp_path):
    windows = sr.streaming_windows(stream(spark, request_files), 300, 60, ["endpoint"], delay="5 minutes")
    out = str(tmp_path / "out")
    sr.write_closed_windows(windows, out, str(tmp_path / "cp")).awaitTermination()
    got = {(r["start"].isoformat(), r["endpoint"]): (r["n"], r["n_5xx"]) for r in spark.read.parquet(out).collect()}
    rows = spark.read.schema(REQUEST_SCHEMA).option("recursiveFileLookup", True).parquet(request_files)
    rows = rows.filter(~((F.col("ts") == F.lit(T0 + dt.timedelta(minutes=1))) & (F.col("http_status") == 500)))
    batch = mo.request_windows(rows, 300, 60, ["endpoint"])
    closed = T0 + dt.timedelta(minutes=59 - 5)
    want = {
        (r["start"].isoformat(), r["endpoint"]): (r["n"], r["n_5xx"])
        for r in batch.collect()
        if r["start"] + dt.timedelta(minutes=5) <= closed
    }
    assert got == want and len(want) > 90


def test_alerts_across_batches(spark, request_files, tmp_path):
    windows = sr.streaming_windows(stream(spark, request_files), 60, None, ["endpoint"], delay="1 minute")
    folder = str(tmp_path / "alerts")
    sr.alert_stream(windows, folder, F.col("n_5xx") / F.col("n") > 0.1, 600, 60).awaitTermination()
    alerts = spark.read.parquet(f"{folder}/alerts").collect()
    assert [(r["endpoint"], r["since"], r["fired_at"]) for r in alerts] == [
        ("/predict", T0 + dt.timedelta(minutes=5), T0 + dt.timedelta(minutes=15))
    ]


def write_spans(spark, folder, batch, spans):
    """A file whose events fill minute m of endpoint e, all errors where the condition is to hold."""
    rows = [event(m, 500 if bad else 200, e) for e, m, bad in spans]
    write(spark, folder, f"b{batch}.parquet", rows)


def run_alerts(spark, folder, out):
    """All files not read yet, one per batch; a new query each time, so state comes from the checkpoint."""
    windows = sr.streaming_windows(stream(spark, folder), 60, None, ["endpoint"], delay="0 seconds")
    query = sr.alert_stream(windows, out, F.col("n_5xx") / F.col("n") > 0.5, 120, 60)
    query.awaitTermination()
    return query


def fired(spark, out):
    schema = "endpoint string, since timestamp, fired_at timestamp"
    return sorted((r["endpoint"], (r["since"] - T0).seconds // 60, (r["fired_at"] - T0).seconds // 60)
                  for r in spark.read.schema(schema).parquet(f"{out}/alerts").collect())


def test_alert_state_over_restarts(spark, tmp_path):
    """Stretches over batches and restarts equal those of the batch alert on all rows; states of gone groups expire."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("e", 0, 1), ("e", 1, 1), ("f", 0, 1)],
        [("e", 2, 1), ("f", 1, 0), ("f", 2, 1)],
        [("e", 3, 1), ("e", 4, 0), ("e", 5, 1), ("f", 3, 1), ("f", 4, 1)],
        [("e", 7, 1), ("e", 8, 1), ("e", 9, 1), ("f", 7, 1)],  # minute 6 has no data
        [("e", 10, 0), ("e", 20, 1), ("e", 21, 1), ("e", 22, 1), ("e", 23, 1), ("e", 40, 0)],
    ]
    for i, spans in enumerate(batches):
        write_spans(spark, folder, i, spans)
        query = run_alerts(spark, folder, out)
    got = fired(spark, out)
    assert got == [("e", 0, 2), ("e", 7, 9), ("e", 20, 22), ("f", 2, 4)]
    rows = spark.read.schema(REQUEST_SCHEMA).option("recursiveFileLookup", True).parquet(folder)
    batch = mo.request_windows(rows, 60, None, ["endpoint"]).withColumn("hit", F.col("n_5xx") / F.col("n") > 0.5)
    alerts = mo.alert_intervals(batch, F.col("hit"), 120, 60, ["endpoint"]).where("firing").collect()
    assert sorted((r["endpoint"], (r["since"] - T0.replace(tzinfo=None)).seconds // 60) for r in alerts) == [(e, s) for e, s, _ in got]
    stateful = query.lastProgress["stateOperators"]
    assert "RocksDB" in str(stateful) or any("rocksdb" in k for o in stateful for k in o["customMetrics"])
    assert set(p.name for p in (tmp_path / "out").iterdir()) == {"alerts", "checkpoint"}


def test_one_state_for_all_rows(spark, request_files, tmp_path):
    windows = sr.streaming_windows(stream(spark, request_files), 60, None, [], delay="1 minute")
    out = str(tmp_path / "alerts")
    sr.alert_stream(windows, out, F.col("n_5xx") > 0, 600, 60, by=()).awaitTermination()
    got = spark.read.parquet(f"{out}/alerts").collect()
    assert [(r["since"], r["fired_at"]) for r in got] == [(T0 + dt.timedelta(minutes=5), T0 + dt.timedelta(minutes=15))]


@pytest.mark.parametrize("width,slide", [(600, 240), (300, 180)])
def test_windows_of_uneven_steps(spark, request_files, tmp_path, width, slide):
    """Steps are the longest ones that all windows are made of."""
    windows = sr.streaming_windows(stream(spark, request_files), width, slide, ["endpoint"], delay="2 minutes")
    out = str(tmp_path / "out")
    sr.write_closed_windows(windows, out, str(tmp_path / "cp")).awaitTermination()
    got = {(r["start"].isoformat(), r["endpoint"]): (r["n"], r["n_5xx"], r["latency_sum"]) for r in spark.read.parquet(out).collect()}
    rows = spark.read.schema(REQUEST_SCHEMA).option("recursiveFileLookup", True).parquet(request_files)
    rows = rows.filter(~((F.col("ts") == F.lit(T0 + dt.timedelta(minutes=1))) & (F.col("http_status") == 500)))
    closed = T0 + dt.timedelta(minutes=59 - 2)
    plain = rows.groupBy(F.window("ts", f"{width} seconds", f"{slide} seconds").alias("w"), "endpoint").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("http_status") == 500).alias("bad"), F.sum("latency_s").alias("s"))
    want = {(r["w"]["start"].isoformat(), r["endpoint"]): (r["n"], r["bad"], r["s"]) for r in plain.collect()
            if r["w"]["end"].replace(tzinfo=None) <= closed}
    assert got == want and want


def test_score_stream(spark, tmp_path):
    rows = [(str(i), t, T0 + dt.timedelta(seconds=i)) for i, t in enumerate(["Good food here", " good  FOOD here", "bad", "", None])]
    spark.createDataFrame(rows, "sentence_id string, text string, ts timestamp").write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("sentence_id string, text string, ts timestamp").parquet(str(tmp_path / "in"))
    lex = {"good": (-1.0, 0.0, 1.0), "bad": (1.0, 0.0, -1.0)}
    out = ss.score_stream(texts, lex, ("negative", "neutral", "positive"), (0.0, 0.5, 0.0))
    sr.write_closed_windows(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["sentiment"], r["lang"], r["lang_confidence"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("negative", "en", 0.0), ("positive", "en", 0.75)]  # blank and missing texts are dropped


TEXT_ROWS = "n long, text string"


def run_history(spark, folder, out, bits, then=None):
    stream = spark.readStream.schema(TEXT_ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    sh.first_copies(stream, out, "n", then=then, buckets=4, bits=bits).awaitTermination()


@pytest.mark.parametrize("bits", [8, 1 << 12])
def test_copies_of_history(spark, tmp_path, bits):
    """Eight bits a filter are soon full, so every key is a false or true hit; the rows are the same."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = [["A b", "a  B", None, "nan", "x1", "x2"], ["x3", "a b", "x1 ", "x4"], ["X2", "x5", "NaN", "x3", "x5", "", " "]]
    want, seen, n = [], set(), 0
    for i, batch in enumerate(texts):
        rows = [(n + j, t) for j, t in enumerate(batch)]
        n += len(batch)
        spark.createDataFrame(rows, TEXT_ROWS).coalesce(1).write.parquet(f"{folder}/b{i}")
        run_history(spark, folder, out, bits, lambda df: df.select("n"))
        for m, t in rows:
            key = " ".join(("nan" if t is None else t).lower().split())
            if key not in seen:
                seen.add(key)
                want.append(m)
    got = spark.read.schema("n long").option("recursiveFileLookup", True).parquet(f"{out}/rows").collect()
    assert sorted(r["n"] for r in got) == want
    left = sorted(p.name for p in (tmp_path / "out" / "filters").iterdir())
    assert left == ["batch=1", "batch=2"]


def test_filters_lose_no_key(spark):
    keys = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("key")).withColumn("bucket", F.lit(1))
    none = spark.createDataFrame([], sh.FILTERS)
    filters = sh.updated_filters(keys.where("key < '8'"), none, 1 << 13)
    filters = sh.updated_filters(keys.where("key >= '8'"), filters, 1 << 13)
    asked = sh.unseen_keys(keys, filters, 1 << 13)
    assert asked.where("maybe").count() == 500
    other = spark.range(500, 1500).select(F.md5(F.col("id").cast("string")).alias("key")).withColumn("bucket", F.lit(1))
    assert sh.unseen_keys(other, filters, 1 << 13).where("maybe").count() < 60
    assert sh.unseen_keys(other, none, 1 << 13).where("maybe").count() == 0
