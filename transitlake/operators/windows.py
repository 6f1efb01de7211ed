"""Ordered operators within groups. All take the group's keys and its order; each is one sort of one partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from transitlake.functions.values import safe_div

RUN = ("filename", "index_run_start")
ORDER = ("index_loc",)


def over(keys: Sequence[str] = RUN, order: Sequence = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: Sequence[str] = RUN, order: Sequence = ORDER) -> WindowSpec:
    return over(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def backwards(keys: Sequence[str] = RUN, order: Sequence = ORDER) -> WindowSpec:
    """The group from its end. What is ahead of a row is read by a running window over it, in linear time."""
    return over(keys, [F.desc(c) for c in order])


def from_here(keys: Sequence[str] = RUN, order: Sequence = ORDER) -> WindowSpec:
    """For F.last: this row and those ahead, the nearest last."""
    return backwards(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def ahead(keys: Sequence[str] = RUN, order: Sequence = ORDER) -> WindowSpec:
    """For F.last: the rows ahead without this one, the nearest last."""
    return backwards(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def change_id(value: Column, keys: Sequence[str] = RUN, order: Sequence = ORDER) -> Column:
    """1 for the first run of equal values, one more at each change."""
    before = F.lag(value).over(over(keys, order))
    return F.sum(F.when(before.isNull() | (value != before), 1).otherwise(0)).over(so_far(keys, order)).cast("long")


def change_id_where(value: Column, defined: Column, keys: Sequence[str] = RUN, order: Sequence = ORDER) -> Column:
    """change_id among rows with ``defined`` only; null in others."""
    held = F.when(defined, value)
    earlier = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(held, ignorenulls=True).over(earlier)
    changed = F.when(defined & (before.isNull() | (value != before)), 1).otherwise(0)
    return F.when(defined, F.sum(changed).over(so_far(keys, order)).cast("long"))


def fill(value: Column, keys: Sequence[str] = RUN, order: Sequence = ORDER) -> Column:
    """Forward, then backward fill within the group."""
    return F.coalesce(F.last(value, ignorenulls=True).over(so_far(keys, order)), F.last(value, ignorenulls=True).over(from_here(keys, order)))


def last_known(value: Column, keys: Sequence[str] = RUN, order: Sequence = ORDER) -> Column:
    return F.last(value, ignorenulls=True).over(so_far(keys, order))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_i", F.row_number().over(over(keys, order))).where("_i = 1").drop("_i")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_one(df, keys, [F.desc(c) for c in order])


def drop_last(df: DataFrame, keys: Sequence[str] = RUN, order: Sequence[str] = ORDER) -> DataFrame:
    """All rows but the last of each group."""
    return df.withColumn("_i", F.row_number().over(over(keys, [F.desc(c) for c in order]))).where("_i > 1").drop("_i")


def nondecreasing(df: DataFrame, value: str, keys: Sequence[str], order: Sequence, strict: bool = False) -> DataFrame:
    """Rows whose value is no less than all before: what repeated deletion of falling rows leaves, in one pass."""
    most = F.max(value).over(over(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    ok = F.col(value) > most if strict else F.col(value) >= most
    return df.withColumn("_ok", most.isNull() | ok).where("_ok").drop("_ok")


def asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], forward: bool = False) -> DataFrame:
    """Each left row with the latest right row at or before it (forward: the first at or after it), by keys.

    Left rows without a match keep nulls. Right columns besides ``by`` get the suffix _asof.
    """
    mine, theirs = [c for c in left.columns if c not in by], [c for c in right.columns if c not in by]
    l_side = left.select(*by, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.struct(*mine).alias("_l"))
    r_side = right.select(*by, F.col(on).alias("_at"), F.lit(0).alias("_side"), F.struct(*theirs).alias("_r"))
    both = l_side.unionByName(r_side, allowMissingColumns=True)
    if forward:
        found = F.last("_r", ignorenulls=True).over(so_far(by, [F.desc("_at"), "_side"]))
    else:
        found = F.last("_r", ignorenulls=True).over(so_far(by, ["_at", "_side"]))
    matched = both.withColumn("_m", found).where("_side = 1")
    return matched.select(*by, *(F.col(f"_l.{c}").alias(c) for c in mine), *(F.col(f"_m.{c}").alias(f"{c}_asof") for c in theirs))


def rolling_speeds(pings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Adds next values one and three rows on, their differences, and speeds fps_next and fps_next3."""
    w = over(keys)
    out = pings
    for c in ("odom_ft", "sec_past_st"):
        out = out.withColumn(f"{c}_next", F.lead(c, 1).over(w)).withColumn(f"{c}_next3", F.lead(c, 3).over(w))
    marg = lambda c, n: F.col(f"{c}_next{n}") - F.col(c)
    return out.withColumns(
        {
            "odom_ft_marg": marg("odom_ft", ""),
            "secs_marg": marg("sec_past_st", ""),
            "fps_next": safe_div(marg("odom_ft", ""), marg("sec_past_st", "")),
            "fps_next3": safe_div(marg("odom_ft", "3"), marg("sec_past_st", "3")),
        }
    )


def rolling_mean(value: Column, rows: int, keys: Sequence[str] = RUN, order: Sequence = ORDER) -> Column:
    """Mean of the last ``rows`` rows, nulls skipped; null until there are as many."""
    w = over(keys, order).rowsBetween(1 - rows, 0)
    return F.when(F.row_number().over(over(keys, order)) >= rows, F.avg(value).over(w))


def first_rows(df: DataFrame, n: int, keys: Sequence[str], order: Sequence) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(over(keys, order))).where(F.col("_i") <= n).drop("_i")


def groups_where(df: DataFrame, keep: Column, keys: Sequence[str]) -> DataFrame:
    """All rows of the groups in which ``keep`` holds somewhere."""
    return df.withColumn("_any", F.bool_or(F.coalesce(keep, F.lit(False))).over(Window.partitionBy(*keys))).where("_any").drop("_any")


def sessions(start: Column, gap, keys: Sequence[str], order: Sequence) -> Column:
    """Session number, from 1: a new one where the start is ``gap`` or more after the one before."""
    before = F.lag(start).over(over(keys, order))
    return F.sum(F.when(before.isNull() | (start - before >= gap), 1).otherwise(0)).over(so_far(keys, order)).cast("long")


def reset_offset(value: Column, keys: Sequence[str] = RUN, order: Sequence = ORDER) -> Column:
    """What to add to a counter that falls back to a lower value: the sum of the values it fell from."""
    before = F.lag(value).over(over(keys, order))
    return F.sum(F.when(value < before, before).otherwise(0)).over(so_far(keys, order))


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n groups chosen by the MD5 of their keys and the seed, parted by bars: the same ones each time."""
    told = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    chosen = df.select(*keys).distinct().orderBy(F.md5(told), *keys).limit(n)
    return df.join(chosen, list(keys), "left_semi")
