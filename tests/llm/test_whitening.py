"""Whitening against a direct eigendecomposition, and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import whitening
from labelflow.llm.whitening import Spectrum

SCHEMA = "vec_id long, embedding array<float>, label int"


def scatter(x):
    y = x - x.mean(axis=0)
    return y.T @ y


@pytest.mark.parametrize("width,n,kind", [
    (24, 400, "plain"), (1, 9, "plain"), (7, 3, "plain"), (8, 60, "rounded"), (6, 200, "equal"), (16, 300, "graded"), (5, 40, "constant"),
])
def test_rank_one_updates(width, n, kind):
    rng = np.random.default_rng(width * n)
    x = rng.normal(size=(n, width)) * 8
    if kind == "rounded":
        x = np.round(x / 6)
    if kind == "equal":
        x = np.round(x / 8)
        x[:, 3] = x[:, 2]
    if kind == "graded":
        x *= np.logspace(0, -7, width)
    if kind == "constant":
        x[:] = x[0]
    whole, parts = Spectrum(width), [Spectrum(width) for _ in range(3)]
    for i, row in enumerate(x):
        whole.add(row)
        parts[i % 3 if n > 3 else 0].add(row)
    parts[0].join(parts[1])
    parts[2].join(parts[0])
    want = scatter(x)
    for s in (whole, parts[2]):
        assert s.count == n and np.allclose(s.mean, x.mean(axis=0), atol=1e-12)
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(width), atol=1e-11)
        assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, want, atol=1e-11 * max(1.0, np.abs(want).max()))
        assert np.allclose(s.values, np.linalg.eigvalsh(want), atol=1e-11 * max(1.0, np.abs(want).max()))
        assert (np.diff(s.values) >= 0).all()


def ints(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def check(rows, got, kept):
    """The rows of ``whiten`` against numpy on the same vectors."""
    used = [(i, ints(v)) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in used}))
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    v = y.T @ y / n
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == len(used) * kept
    white = {}
    for r in got:
        k = r["component"]
        assert r["n"] == n and r["explained"] == pytest.approx(values[k - 1] / np.trace(v), rel=1e-6)
        assert r["identity_error"] < 1e-9
        white.setdefault(r["vec_id"], []).append((k, r["whitened"], r["deviation"]))
    points = {}
    for i, x in used:
        own = sorted(white[i])[: kept] if i is not None else None
        if own is None:
            continue
        assert {d for *_, d in own} == {sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))}
        points[tuple(x)] = [w for _, w, _ in own]
    w = np.array([points[tuple(x)] for x in fit])
    assert np.allclose(w.T @ w / n, np.eye(kept), atol=1e-8)
    # each component is an eigenvector: projections give it back, whatever its sign
    axes = np.linalg.lstsq(y, w * np.sqrt(values[:kept]), rcond=None)[0]
    assert np.allclose(v @ axes, axes * values[:kept], atol=1e-7 * values[0])


@pytest.mark.parametrize("parts", [1, 40])
def test_whiten(spark, parts):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=20) * np.linspace(1, 3, 20)]) for i in range(90)]
    good += [(1000 + i, good[7][1]) for i in range(40)]  # a hot copy
    bad = [
        (2000, None), (2001, [float("nan")] * 20), (2002, [None] + [0.5] * 19), (2003, [float("inf")] * 20), (2004, []), (2005, [1.0]),
        (2006, [float("-inf")] + [0.0] * 19),
    ]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], SCHEMA).repartition(parts)
    df = df.withColumn("x", F.lit("?")).withColumn("n", F.lit(1)).withColumn("grp", F.lit(2)).withColumn("component", F.lit(3))
    got = whitening.whiten(df).collect()
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    check(good, got, 16)


def test_whiten_odd_tables(spark):
    def whiten(rows):
        return sorted((r.asDict() for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()),
                      key=lambda r: (str(r["vec_id"]), r["component"]))

    assert whiten([]) == [] and whiten([(1, None, 1), (2, [], 1)]) == []
    one = whiten([(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (None, [0.5, 0.25], 1)])
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in one)
    assert all(r["n"] == 1 and r["identity_error"] is None for r in one)
    flat = whiten([(i, [float(i), 1.0, 2.0 * i], 1) for i in range(5)])  # rank one
    assert [r["whitened"] is None for r in flat] == [False, True, True] * 5
    assert flat[0]["identity_error"] < 1e-9 and flat[0]["explained"] == pytest.approx(1.0)
    far = whiten([(1, [3e14, 1.0], 1), (2, [-3e14, 0.0], 1)])  # the exact sum of squares passes a long
    assert all(r["deviation"] is None for r in far) and abs(abs(far[0]["whitened"]) - 1) < 1e-9
