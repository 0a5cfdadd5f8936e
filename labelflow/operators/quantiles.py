"""Exact quantiles with linear interpolation, without one task seeing a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY
CELLS = 4096


def _brackets(keyed: DataFrame, qs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by..., n, brackets): per quantile two values between which it lies, from a mergeable sketch.

    The margin covers the sketch's error and the rows that a rank may be off in a small group. It is the next of a
    few fixed margins, the last of which spans the whole group, because the sketch takes constants only.
    """
    margins = [MARGIN * 4.0**i for i in range(8)]
    sides = {
        side: [F.lit(min(1.0, max(0.0, q + sign * m))) for q in qs for m in margins]
        for side, sign in (("lo", -1), ("hi", 1))
    }
    sketch = keyed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx("v", F.array(*ranks), ACCURACY).alias(side) for side, ranks in sides.items()],
    )
    step = F.ceil(F.log(F.lit(1.0) + F.lit(2.0 / MARGIN) / F.col("n")) / F.log(F.lit(4.0)))
    step = F.least(step, F.lit(len(margins) - 1)).cast("int")
    brackets = [
        F.struct(F.lit(float(q)).alias("q"), *[F.get(x, step + i * len(margins)).alias(x) for x in ("lo", "hi")])
        for i, q in enumerate(qs)
    ]
    return sketch.select(*by, "n", F.array(*brackets).alias("brackets"))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def exact_quantiles(
    df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., q, quantile) for any numeric column; missing values and NaN do not count.

    A sketch brackets each quantile. The bracket is cut into CELLS ranges of equal width, whose rows are counted
    (all rows below it count as one value), and only values in the ranges with the quantile's two neighbouring ranks
    are ranked. Groups of every size take this way.
    """
    by = list(by)
    v = F.col(value).cast("double")
    keyed = df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("v"))
    bounds = _brackets(keyed, qs, by)
    if by:
        theirs = [f"__{c}" for c in by]
        bounds = bounds.select(*[F.col(c).alias(t) for c, t in zip(by, theirs)], "n", "brackets")
        joined = keyed.join(bounds, _same(by, theirs))
    else:
        one = F.lit(1).alias("__one")
        joined = keyed.select("v", one).join(F.broadcast(bounds.select("n", "brackets", one)), "__one")  # one row
    rows = joined.select(*by, "n", "v", F.explode("brackets").alias("b")).filter(F.col("v") <= F.col("b.hi"))
    width = F.col("b.hi") - F.col("b.lo")
    share = F.when((width > 0) & (width < float("inf")), (F.col("v") - F.col("b.lo")) / width).otherwise(0.0)
    cell = F.when(F.col("v") < F.col("b.lo"), -1).otherwise(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
    inside = F.when(F.col("v") >= F.col("b.lo"), F.col("v")).alias("v")
    values = rows.select(*by, "n", F.col("b.q").alias("q"), cell.cast("int").alias("cell"), inside)
    values = values.groupBy(*by, "n", "q", "cell", "v").agg(F.count(F.lit(1)).alias("c"))

    position = F.col("q") * (F.col("n") - 1)
    floor, ceil = F.floor(position), F.ceil(position)
    counted = values.groupBy(*by, "n", "q", "cell").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "n", "q").orderBy("cell"))
    counted = counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    holds = (F.col("upto") > floor) & (F.col("before") <= ceil)
    mine = [*by, "q", "cell"]
    picked = counted.filter(holds).select(*[F.col(c).alias(f"p_{c}") for c in mine], "before")

    near = values.join(picked, _same(mine, [f"p_{c}" for c in mine]))
    order = Window.partitionBy(*by, "n", "q", "cell", "before").orderBy("v")
    ranked = near.withColumn("reached", F.col("before") + F.sum("c").over(order))
    at = lambda rank: F.min(F.when(F.col("reached") > rank, F.col("v")))
    between = F.col("a") + (F.col("b") - F.col("a")) * (position - floor)
    return (
        ranked.groupBy(*by, "n", "q")
        .agg(at(floor).alias("a"), at(ceil).alias("b"))
        .select(*by, "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("quantile"))
    )
