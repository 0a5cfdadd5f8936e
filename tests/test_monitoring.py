import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.functions import vocab
from labelflow.operators import chat as ch
from labelflow.operators import monitoring as mo
from labelflow.operators.quantiles import exact_quantiles

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, method string, endpoint string, http_status int, latency_s double, lang string"


def requests(spark, n=400, minutes=60, seed=1):
    rnd = random.Random(seed)
    rows = [
        (
            T0 + dt.timedelta(seconds=rnd.uniform(0, minutes * 60)),
            "POST",
            rnd.choice(["/predict", "/explain"]),
            rnd.choice([200, 200, 200, 404, 500]),
            round(rnd.expovariate(3), 4),
            rnd.choice(["en", "vi", "fr"]),
        )
        for _ in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_counter(spark):
    rows, df = requests(spark)
    got = {(r["endpoint"], r["http_status"]): r["n"] for r in mo.request_counter(df).collect()}
    assert sum(got.values()) == len(rows)
    assert got[("/explain", 404)] == sum(r[2] == "/explain" and r[3] == 404 for r in rows)


@pytest.mark.parametrize("width, slide", [(60, None), (300, 60)])
def test_windows_brute_force(spark, width, slide):
    rows, df = requests(spark)
    out = mo.error_ratio(mo.average_latency(mo.request_rate(mo.request_windows(df, width, slide, ["endpoint"]), width)))
    step = slide or width
    got = {(r["start"], r["endpoint"]): r for r in out.collect()}
    want = set()
    for ts, _, endpoint, *_ in rows:
        base = int((ts - T0).total_seconds() // step) * step
        want |= {(T0 + dt.timedelta(seconds=base - k * step), endpoint) for k in range(width // step)}
    assert set(got) == want
    for (start, endpoint), r in got.items():
        inside = [x for x in rows if x[2] == endpoint and start <= x[0] < start + dt.timedelta(seconds=width)]
        assert r["n"] == len(inside) and r["rate"] == pytest.approx(len(inside) / width)
        assert r["error_ratio"] == pytest.approx(sum(x[3] == 500 for x in inside) / len(inside))
        assert r["avg_latency"] == pytest.approx(sum(x[4] for x in inside) / len(inside))


def test_status_volume(spark):
    rows, df = requests(spark)
    out = mo.status_volume(mo.request_windows(df, 3600), 3600)
    got = {r["status_class"]: r["n"] for r in out.collect()}
    assert got == {c: sum(str(x[3])[0] == c[0] for x in rows) for c in ("2xx", "4xx", "5xx")}
    with pytest.raises(ValueError):
        mo.request_windows(df, 100, 60)


def quantile(q, values):
    les = list(vocab.LATENCY_BUCKETS)
    cum = [sum(v <= b for v in values) for b in les] + [len(values)]
    rank = q * len(values)
    hit = next(i for i, c in enumerate(cum) if c >= rank)
    if hit == len(les):
        return les[-1]
    low, below = (les[hit - 1], cum[hit - 1]) if hit else (0.0, 0)
    return low + (les[hit] - low) * (rank - below) / (cum[hit] - below)


def test_histogram_quantiles(spark):
    rows, df = requests(spark)
    hist = mo.latency_histogram(df, ["endpoint"])
    for q in (0.01, 0.5, 0.95, 0.99):
        for r in hist.select("endpoint", mo.histogram_quantile(q).alias("v")).collect():
            assert r["v"] == pytest.approx(quantile(q, [x[4] for x in rows if x[2] == r["endpoint"]]))
    long = mo.histogram_rows(hist, ["endpoint"])
    assert long.count() == 2 * 15 and long.filter("le = '+Inf'").agg(F.sum("n")).first()[0] == len(rows)


def test_histogram_edges(spark):
    df = spark.createDataFrame([([0] * 15,), ([0] * 14 + [5],), ([4] * 15,)], "cum array<long>")
    assert [r[0] for r in df.select(mo.histogram_quantile(0.5)).collect()] == [None, 10.0, pytest.approx(0.0025)]


def test_inference_labels(spark):
    _, df = requests(spark)
    assert {r["lang"] for r in mo.inference_windows(df, 3600).collect()} == {"en", "vi", "other"}


def series(spark, values, step=60):
    rows = [(T0 + dt.timedelta(seconds=i * step), "e", float(v)) for i, v in values]
    return spark.createDataFrame(rows, "start timestamp_ntz, endpoint string, v double")


def test_alert_needs_every_step(spark):
    values = [(0, 1), (1, 1), (2, 0), (3, 1), (5, 1), (6, 1), (7, 1), (8, None or 0), (10, 1)]
    df = series(spark, values)
    out = mo.alert_intervals(df, F.col("v") > 0.5, 120, 60, ["endpoint"]).orderBy("since").collect()
    got = [((r["since"] - T0).seconds // 60, (r["until"] - T0).seconds // 60, r["firing"]) for r in out]
    assert got == [(0, 1, False), (3, 3, False), (5, 7, True), (10, 10, False)]


def test_running_average(spark):
    df = spark.createDataFrame(
        [(T0 + dt.timedelta(minutes=i), "en", n, s) for i, (n, s) in enumerate([(1, 0.2), (3, 2.2), (1, 0.1)])],
        "start timestamp_ntz, lang string, n long, latency_sum double",
    )
    got = [r["lifetime_avg"] for r in mo.running_average(df, ["lang"]).orderBy("start").collect()]
    assert got == pytest.approx([0.2, 0.6, 0.5])


def test_bands(spark):
    df = spark.createDataFrame([(0.04,), (0.05,), (0.1,), (None,)], "v double")
    assert [r[0] for r in df.select(mo.color_band(F.col("v"), vocab.ERROR_BANDS)).collect()] == ["green", "yellow", "red", None]


def test_shift(spark):
    df = spark.createDataFrame([("a", "x")] * 6 + [("a", "y")] * 4 + [("b", "x")] * 2, "p string, b string")
    got = {r["period"]: r["shift"] for r in mo.population_shift(df, F.col("p"), F.col("b"), "a", ["x", "y"]).collect()}
    q, p = np.array([6.5, 4.5]) / 11, np.array([2.5, 0.5]) / 3
    assert got["a"] == 0.0 and got["b"] == pytest.approx(float(((p - q) * np.log(p / q)).sum()))


@pytest.mark.parametrize("n", [1, 2, 7, 500, 30_000])
def test_exact_quantiles(spark, n):
    rnd = random.Random(n)
    values = [round(rnd.gauss(0, 1), 3) for _ in range(n)]
    df = spark.createDataFrame([(v, "g") for v in values] + [(1.0, "h"), (3.0, "h"), (None, "h")], "v double, g string")
    qs = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, "v", qs, ["g"]).collect()}
    for q in qs:
        assert got[("g", q)] == pytest.approx(float(np.quantile(values, q)))
    assert got[("h", 0.5)] == 2.0
    whole = {r["q"]: r["quantile"] for r in exact_quantiles(df.filter("g = 'g'"), "v", qs).collect()}
    assert whole == {q: got[("g", q)] for q in qs}


def nearest(turns):
    out, last = {}, None
    for turn, role, text in sorted(turns):
        if role == "assistant":
            out[turn] = (last[0], last[1].strip() or None) if last else (None, None)
        if role == "user":
            last = (turn, text)
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_preceding_user(spark, block):
    rnd = random.Random(5)
    turns = [(t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["hi", "  ", f"text {t}"])) for t in range(60)]
    df = spark.createDataFrame([(c, *t) for c in (1, 2) for t in turns[c:]], "conv_id long, turn long, role string, text string")
    got = ch.preceding_user_text(df, block=block).collect()
    for c in (1, 2):
        assert {r["turn"]: (r["user_turn"], r["source_text"]) for r in got if r["conv_id"] == c} == nearest(turns[c:])
    assert {r["conv_id"]: r["messages"] for r in ch.message_counts(df).collect()} == {1: 59, 2: 58}


@pytest.mark.parametrize("seed", range(2))
def test_distribution_distance(spark, seed):
    rng = random.Random(seed)
    rows = [("a", float(rng.randrange(40))) for _ in range(300)] + [("b", float(rng.randrange(60))) for _ in range(170)]
    rows += [("c", 7.0)] * 200 + [("d", -1.0), (None, 3.0), ("a", None), ("b", float("inf"))]
    df = spark.createDataFrame(rows, "p string, v double").repartition(6)
    got = {r["period"]: r for r in mo.distribution_distance(df, F.col("p"), F.col("v"), "a").collect()}
    groups = {p: sorted(v for q, v in rows if q == p and v is not None) for p in "abcd"}
    for p, own in groups.items():
        share = lambda xs, x: sum(v <= x for v in xs) / len(xs)
        want = max(abs(share(own, x) - share(groups["a"], x)) for x in own + groups["a"])
        assert got[p]["distance"] == pytest.approx(want) and got[p]["n"] == len(own) and got[p]["n_reference"] == 300
        assert got[p]["critical"] == pytest.approx(1.3581 * math.sqrt((len(own) + 300) / (len(own) * 300)), rel=1e-4)
    assert set(got) == set(groups) and got["a"]["distance"] == 0
    none = {r["period"]: r["distance"] for r in mo.distribution_distance(df, F.col("p"), F.col("v"), "zz").collect()}
    assert none == dict.fromkeys("abcd") and mo.distribution_distance(df.limit(0), F.col("p"), F.col("v"), "a").count() == 0
