"""Request-log monitoring: rates, ratios, latency histograms and quantiles, alerts, drift.

Input rows: ts, method, endpoint, http_status, latency_s, lang. Durations are whole seconds. Events are
first summed per step (map-side combined); sliding windows, running averages and alerts then work on those
few rows, so a sliding window does not multiply the event rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions import vocab
from labelflow.operators.metrics import ratio
from labelflow.session import materialize

SUMS = ("n", "n_2xx", "n_4xx", "n_5xx", "latency_sum")
LES = tuple(float(b) for b in vocab.LATENCY_BUCKETS)


def status_class(status: Column) -> Column:
    return F.concat(F.substring(status.cast("string"), 1, 1), F.lit("xx"))


def request_counter(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint", "http_status").agg(F.count(F.lit(1)).alias("n"))


def _bucket_name(i: int) -> str:
    return f"le_{i}"


def event_sums(with_buckets: bool, value: str) -> list[Column]:
    family = status_class(F.col("http_status"))
    count = lambda c: F.count(F.when(c, 1))
    sums = [
        F.count(F.lit(1)).alias("n"),
        count(family == "2xx").alias("n_2xx"),
        count(family == "4xx").alias("n_4xx"),
        count(family == "5xx").alias("n_5xx"),
        F.sum(value).alias("latency_sum"),
    ]
    if with_buckets:
        sums += [count(F.col(value) <= le).alias(_bucket_name(i)) for i, le in enumerate(LES)]
    return sums


def _shifted(start: Column, steps: int, step: int) -> Column:
    """Starts of all windows of ``steps`` steps that contain the step at ``start``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: start - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), i * step),
    )


def request_windows(
    requests: DataFrame,
    width: int,
    slide: int | None = None,
    by: Sequence[str] = (),
    ts: str = "ts",
    buckets: bool = False,
    value: str = "latency_s",
) -> DataFrame:
    """(start, by..., n, n_2xx, n_4xx, n_5xx, latency_sum[, le_0...]) per tumbling or sliding window."""
    step = slide or width
    if width % step:
        raise ValueError("width must be a multiple of slide")
    base = (
        requests.groupBy(F.window(ts, f"{step} seconds").alias("w"), *by)
        .agg(*event_sums(buckets, value))
        .withColumn("start", F.col("w.start"))
        .drop("w")
    )
    sums = list(SUMS) + ([_bucket_name(i) for i in range(len(LES))] if buckets else [])
    if width == step:
        return base.select("start", *by, *sums)
    moved = base.withColumn("start", F.explode(_shifted(F.col("start"), width // step, step)))
    return moved.groupBy("start", *by).agg(*[F.sum(c).alias(c) for c in sums])


def request_rate(windows: DataFrame, width: int, n: str = "n", out: str = "rate") -> DataFrame:
    return windows.withColumn(out, F.col(n) / F.lit(float(width)))


def error_ratio(windows: DataFrame, out: str = "error_ratio") -> DataFrame:
    return windows.withColumn(out, ratio(F.col("n_5xx"), F.col("n")))


def average_latency(windows: DataFrame, out: str = "avg_latency") -> DataFrame:
    return windows.withColumn(out, F.col("latency_sum") / F.nullif(F.col("n"), F.lit(0)))


def status_volume(windows: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """(start, by..., status_class, n, rate) with one row per class, zeros included."""
    return windows.select(
        "start",
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("status_class"), F.col(f"n_{c}").alias("n"))
                    for c in ("2xx", "4xx", "5xx")
                ]
            )
        ),
    ).withColumn("rate", F.col("n") / F.lit(float(width)))


def cumulative_buckets(windows: DataFrame) -> DataFrame:
    """The ``le_i`` columns plus +Inf as one array ``cum``."""
    names = [_bucket_name(i) for i in range(len(LES))]
    return windows.withColumn("cum", F.array(*[F.col(c) for c in names], F.col("n"))).drop(*names)


def latency_histogram(
    requests: DataFrame, by: Sequence[str] = (), value: str = "latency_s"
) -> DataFrame:
    """(by..., n, latency_sum, cum): cumulative bucket counts over the whole table."""
    out = requests.groupBy(*by).agg(*event_sums(True, value))
    return cumulative_buckets(out).drop("n_2xx", "n_4xx", "n_5xx")


def histogram_rows(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., le, n); the last bound reads ``+Inf``."""
    bounds = F.array(*[F.lit(str(b)) for b in LES], F.lit("+Inf"))
    return histogram.select(
        *by, F.inline(F.arrays_zip(bounds.alias("le"), F.col("cum").alias("n")))
    )


def histogram_quantile(q: float, cum: Column | str = "cum") -> Column:
    """Quantile by linear interpolation inside the first bucket that reaches rank q * n.

    The first bucket starts at 0; in +Inf the last finite bound is returned; null for an empty histogram.
    """
    cum = F.col(cum) if isinstance(cum, str) else cum
    rank = F.element_at(cum, -1) * F.lit(float(q))
    hit = F.array_position(F.transform(cum, lambda c: c >= rank), True).cast("int")  # 1-based
    les = F.array(*[F.lit(b) for b in LES])
    previous = lambda a: F.coalesce(F.get(a, hit - 2), F.lit(0))
    low, below = previous(les), previous(cum)
    inside = (rank - below) / F.nullif(F.get(cum, hit - 1) - below, F.lit(0))
    value = low + (F.get(les, hit - 1) - low) * F.coalesce(inside, F.lit(0.0))
    return F.when(F.element_at(cum, -1) > 0, F.when(hit > len(LES), F.lit(LES[-1])).otherwise(value))


def inference_windows(
    requests: DataFrame, width: int, slide: int | None = None, lang: str = "lang", **how
) -> DataFrame:
    """Latency windows by low-cardinality language label."""
    from labelflow.functions.text import language_label

    labelled = requests.withColumn("lang", language_label(F.col(lang)))
    return request_windows(labelled, width, slide, ["lang"], buckets=True, **how)


def running_average(
    windows: DataFrame, by: Sequence[str] = (), order: str = "start"
) -> DataFrame:
    """Lifetime average latency up to each window: running sum over running count.

    Runs over per-window sums, not over events.
    """
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(order)
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumn(
        "lifetime_avg", F.sum("latency_sum").over(upto) / F.sum("n").over(upto)
    )


def alert_intervals(
    series: DataFrame, condition: Column, hold: int, step: int, by: Sequence[str], ts: str = "start"
) -> DataFrame:
    """(by..., since, until, held_s, firing): stretches where the condition holds at every step.

    A step without data ends a stretch. It fires once it has lasted ``hold`` seconds.
    """
    true = series.filter(F.coalesce(condition, F.lit(False)))
    group = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(ts)
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(group), F.col(ts))
    marked = true.withColumn("__new", F.coalesce((gap != step).cast("long"), F.lit(1)))
    numbered = marked.withColumn(
        "__stretch", F.sum("__new").over(group.rowsBetween(Window.unboundedPreceding, 0))
    )
    out = numbered.groupBy(*by, "__stretch").agg(
        F.min(ts).alias("since"), F.max(ts).alias("until"), F.count(F.lit(1)).alias("steps")
    )
    held = F.timestamp_diff("SECOND", F.col("since"), F.col("until"))
    return out.select(
        *by, "since", "until", "steps", held.alias("held_s"), (held >= hold).alias("firing")
    )


def error_rate_alert(
    requests: DataFrame,
    width: int = 300,
    slide: int = 60,
    threshold: float = 0.1,
    hold: int = 60,
) -> DataFrame:
    """Share of 5xx answers per endpoint above the threshold for ``hold`` seconds.

    The rule states this intent; read literally, its expression divides each 5xx series by itself.
    """
    series = error_ratio(request_windows(requests, width, slide, ["endpoint"]))
    return alert_intervals(series, F.col("error_ratio") > threshold, hold, slide, ["endpoint"])


def latency_alert(
    requests: DataFrame,
    step: int = 60,
    threshold: float = 0.5,
    hold: int = 300,
    by: Sequence[str] = ("lang",),
) -> DataFrame:
    """Lifetime average latency above the threshold for ``hold`` seconds."""
    series = running_average(request_windows(requests, step, by=by), by)
    return alert_intervals(series, F.col("lifetime_avg") > threshold, hold, step, by)


def color_band(value: Column, bands: tuple[float, float]) -> Column:
    yellow, red = bands
    return F.when(value >= red, "red").when(value >= yellow, "yellow").when(
        value.isNotNull(), "green"
    )


def label_share(
    df: DataFrame, period: Column, label_col: str, label: str = "negative"
) -> DataFrame:
    """(period, n, share) of one label over time."""
    hit = F.coalesce((F.col(label_col) == label).cast("double"), F.lit(0.0))
    return df.groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("share")
    )


def population_shift(
    df: DataFrame, period: Column, bin_col: Column, reference: str, bins: Sequence[str]
) -> DataFrame:
    """(period, n, shift): sum over bins of (p - q) * ln(p / q) against the reference period.

    Shares are smoothed by half a row per bin, so empty bins stay finite. ``bins`` is the closed bin list.
    """
    counts = df.groupBy(period.alias("period"), bin_col.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per = counts.groupBy("period").agg(
        *[F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bins)]
    )
    total = sum((F.col(f"b{i}") for i in range(len(bins))), F.lit(0))
    shares = F.array(
        *[(F.col(f"b{i}") + 0.5) / (total + 0.5 * len(bins)) for i in range(len(bins))]
    )
    wide = per.select("period", total.alias("n"), shares.alias("p"))
    base = wide.filter(F.col("period") == reference).select(F.col("p").alias("q"))  # one row
    return (
        wide.withColumn("__one", F.lit(1))
        .join(F.broadcast(base.withColumn("__one", F.lit(1))), "__one")
        .select(
            "period",
            "n",
            F.aggregate(
                F.zip_with("p", "q", lambda p, q: (p - q) * F.ln(p / q)), F.lit(0.0), lambda a, x: a + x
            ).alias("shift"),
        )
    )


def _running_sum(df: DataFrame, by: Sequence[str], order: str, col: str) -> DataFrame:
    """Add ``upto``: the sum of ``col`` over rows of the group up to and including this one; ``order`` is unique there.

    A range-partitioned sort, sums within its partitions, and the totals of the partitions before.
    """
    placed = df.orderBy(*by, order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("__part", F.shiftright("__at", 33)).drop("__at"), "sorted-values")
    sums = placed.groupBy(*by, "__part").agg(F.sum(col).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("__inside", F.sum(col).over(inside)).join(sums, [*by, "__part"])
    return rows.withColumn("upto", F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before")


def distribution_distance(df: DataFrame, period: Column, value: Column, reference: str) -> DataFrame:
    """(period, n, n_reference, distance, critical): two-sample Kolmogorov-Smirnov distance to the reference period.

    The distance is the largest gap between the two cumulative shares over all values, so it needs no bins;
    ``critical`` is its asymptotic 5 % bound. Missing values are left out; NaN counts as the largest value. The
    reference period has distance 0; without a reference there is none (null).

    Rows are first counted per (value, period). Between two values of a period only the reference's share moves,
    and only upwards, so the gap is largest at a value or just before one: the reference's share is needed at the
    values of the periods only. Both running sums are distributed; neither a period nor a frequent value is one task.
    """
    named = df.select(period.cast("string").alias("period"), value.cast("double").alias("value"))
    counted = named.where("period IS NOT NULL AND value IS NOT NULL").groupBy("period", "value").agg(
        F.count(F.lit(1)).alias("k")
    )
    counted = materialize(counted, "values")
    of_reference = F.sum(F.when(F.col("period") == reference, F.col("k")).otherwise(0))
    points = _running_sum(counted.groupBy("value").agg(of_reference.alias("base")), [], "value", "base")
    points = points.select("value", "base", F.col("upto").alias("base_upto"))
    m = counted.agg(of_reference).first()[0] or 0
    rows = _running_sum(counted, ["period"], "value", "k").join(points, "value")
    sizes = counted.groupBy("period").agg(F.sum("k").alias("n"))
    rows = rows.join(sizes, "period")
    share = lambda a, n: a / F.nullif(n, F.lit(0))
    here = F.abs(share(F.col("upto"), F.col("n")) - share(F.col("base_upto"), F.lit(m)))
    just_before = F.abs(
        share(F.col("upto") - F.col("k"), F.col("n")) - share(F.col("base_upto") - F.col("base"), F.lit(m))
    )
    found = rows.groupBy("period").agg(
        F.first("n").alias("n"), F.lit(m).cast("long").alias("n_reference"), F.max(F.greatest(here, just_before)).alias("distance")
    )
    both = (F.col("n") + F.lit(m)) / F.nullif(F.col("n") * F.lit(m), F.lit(0))
    return found.withColumn("critical", F.lit(1.3581015157406195) * F.sqrt(both))
