"""Exact quantiles by selection of order statistics: no task's state holds a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch gives a value whose rank is off by a group's size / ACCURACY at most; MARGIN times that is kept to each side.
ACCURACY, MARGIN = 10_000, 3


def _bounds(at: Sequence[float], accuracy: int) -> tuple[list[Column], list[Column]]:
    """Aggregates that lie at or below, and at or above, the values at each wanted rank and beside it.

    Groups of up to ``accuracy`` values are whole within them; in larger ones the margin is some ranks at least.
    """
    asked, spare = [], MARGIN / accuracy
    for p in at:
        asked += [max(0.0, p - spare), min(1.0, p + spare)]
    told = F.percentile_approx("_v", F.array(*(F.lit(float(p)) for p in asked)), accuracy)
    few = F.count("_v") <= accuracy
    low = [F.min("_v") if asked[2 * i] <= 0 else F.when(few, F.min("_v")).otherwise(told[2 * i]) for i in range(len(at))]
    high = [F.max("_v") if asked[2 * i + 1] >= 1 else F.when(few, F.max("_v")).otherwise(told[2 * i + 1]) for i in range(len(at))]
    return low, high


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """by, n and quantiles (an array in the order of ``at``) of each group's values, with linear interpolation.

    The results are those of Spark's ``percentile``: nulls don't count, and groups with nothing else have null quantiles.

    1. A sketch of fixed size gives, for each wanted rank, a value surely at or below it and one surely at or above.
    2. Rows meet their group's bounds. A value between the two of a rank is counted for itself, all others by the place
       they have among the bounds only, so what is shuffled is a small share of the distinct values, summed beforehand.
    3. Running sums of these counts in order give the values at the wanted ranks. They pass a task as a sorted stream.

    Rows are read twice, by 1 and 2. A hot group is spread in both, as its rows are summed where they are.
    """
    by, names = list(by), [f"_by_{i}" for i in range(len(by))]
    values = rows.select(*by, F.col(value).cast("double").alias("_v"))
    low, high = _bounds(at, accuracy)
    sketch = values.groupBy(*by).agg(F.count("_v").alias("_total"), F.array(*low).alias("_low"), F.array(*high).alias("_high"))
    same = F.lit(True)
    for k, name in zip(by, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(name))
    met = values.join(sketch.withColumnsRenamed(dict(zip(by, names, strict=True))), same).drop(*names)
    # Written out, as functions over arrays are not compiled.
    v, inside, place = F.col("_v"), F.lit(False), F.lit(0)
    for i in range(len(at)):
        inside = inside | ((v >= F.col("_low")[i]) & (v <= F.col("_high")[i]))
        # Whatever lies in no range comes behind all that lies in the last range before it.
        place = place + F.when(F.col("_low")[i] <= v, 1).otherwise(0)
    counted = met.withColumns({"_place": F.when(F.col("_v").isNotNull(), place), "_near": F.when(inside, F.col("_v"))})
    counted = counted.groupBy(*by, "_total", "_place", "_near").agg(F.count("_place").alias("_n"))
    run = Window.partitionBy(*by).orderBy("_place", F.asc_nulls_last("_near")).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_behind", F.sum("_n").over(run))
    position = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    holds = lambda rank: F.max(F.when((rank < F.col("_behind")) & (rank >= F.col("_behind") - F.col("_n")), F.col("_near")))
    ends = []
    for i, p in enumerate(at):
        ends += [holds(F.floor(position(p))).alias(f"_lo_{i}"), holds(F.ceil(position(p))).alias(f"_hi_{i}")]
    picked = counted.groupBy(*by).agg(F.max("_total").alias("n"), *ends)

    def between(i: int, p: float) -> Column:
        where, lo, hi = F.lit(float(p)) * (F.col("n") - 1), F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        found = F.when(lo == hi, lo).otherwise((F.ceil(where) - where) * lo + (where - F.floor(where)) * hi)
        lost = (F.col("n") > 0) & (lo.isNull() | hi.isNull())
        return F.when(lost, F.raise_error(F.lit("a wanted rank lies outside of its bounds")).cast("double")).otherwise(found)

    return picked.select(*by, "n", F.when(F.col("n") > 0, F.array(*(between(i, p) for i, p in enumerate(at)))).alias("quantiles"))
