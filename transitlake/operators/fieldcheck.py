"""Comparison with field observations, and audits of what was lost on the way."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.functions.values import label, seconds_of, seconds_past_midnight
from transitlake.operators.windows import RUN

NEAR_SECONDS = 1000
APPROX_SECONDS = 800


def correct_types(field: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Times of day become timestamps on the observation's date; dwell and signal delay in seconds, null if negative.

    Signal delay is the time from the earlier closing of a door to leaving the stop's zone.
    """
    ts = lambda c: F.try_to_timestamp(F.concat_ws(" ", F.col("date_obs_field"), F.col(c)), F.lit("yyyy-MM-dd HH:mm:ss"))
    times = [c for c in field.columns if c.startswith(("time_", "front_door_", "rear_door_")) and c.endswith("_field")]
    out = field.withColumns({c.replace("_field", "_ts"): ts(c) for c in times})
    closed = F.least("front_door_close_ts", "rear_door_close_ts")
    delay = F.unix_timestamp("time_left_stop_zone_ts") - F.unix_timestamp(closed)
    out = out.withColumns({"dwell_secs": seconds_of(F.col("dwell_time_field")), "signal_delay": F.when(delay >= 0, delay)})
    return out.withColumn("field_qjump_loc", label(F.col("field_qjump_loc"), names)) if names else out


def between_times(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows whose time of day lies between two HH:mm:ss times, both included."""
    s = seconds_past_midnight(F.col(ts))
    return df.where(s.between(seconds_of(F.lit(start)), seconds_of(F.lit(end))))


def near_in_time(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance: float, on: Sequence[str], strict: bool = False) -> DataFrame:
    """Pairs with equal keys whose times differ by the tolerance at most (strict: by less), with delta = right - left.

    Time is cut into buckets as wide as the tolerance, and the bucket is part of the join's key. A left row stands in its
    bucket and both neighbours, a right row in one bucket, so each pair meets once and rows far apart in time never do.
    """
    bucket = lambda c: F.floor(F.col(c) / max(float(tolerance), 1.0))
    dealt = left.withColumn("_bucket", F.explode(F.sequence(bucket(left_time) - 1, bucket(left_time) + 1)))
    met = dealt.join(right.withColumn("_bucket", bucket(right_time)), [*on, "_bucket"]).drop("_bucket")
    delta = F.abs("delta")
    return met.withColumn("delta", F.col(right_time) - F.col(left_time)).where(delta < tolerance if strict else delta <= tolerance)


def match_by_time(field: DataFrame, runs: DataFrame, field_time: str, run_time: str, tolerance: float = NEAR_SECONDS, on: Sequence[str] = ("route", "bus_id")) -> DataFrame:
    """Observations and runs of the same route and bus whose times differ by the tolerance at most."""
    return near_in_time(field, runs, field_time, run_time, tolerance, on)


def match_by_start(field: DataFrame, runs: DataFrame, field_time: str, start: str, approx: str, tolerance: float = APPROX_SECONDS, on: Sequence[str] = ("route", "bus_id")) -> DataFrame:
    """Pairs in which the run starts before the observation and its estimated time is near it."""
    return near_in_time(field, runs, field_time, approx, tolerance, on, strict=True).where(F.col(start) < F.col(field_time))


def coverage(field: DataFrame, keys: Sequence[str], **sources: DataFrame) -> DataFrame:
    """Every observation with has_<source>: 1 if the source has its keys."""
    out = field
    for name, df in sources.items():
        own = df.select(*keys).distinct().withColumn(f"has_{name}", F.lit(1))
        out = out.join(own, list(keys), "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(0)).cast("long"))
    return out


def trend(pairs: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y over x."""
    return pairs.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def compare_field(field: DataFrame, runs: DataFrame, decomposition: DataFrame) -> DataFrame:
    """Observations matched with runs by time, with their decomposition; those without stay, flagged."""
    matched = match_by_time(field, runs, "obs_secs", "pass_secs")
    joined = matched.join(decomposition, list(RUN), "left").select("obs_id", *RUN, "delta", "t_stop1", "t_traffic")
    return coverage(field.join(joined, "obs_id", "left"), ["obs_id"], run=matched, decomposition=joined.where("t_stop1 is not null"))


def attrition_audit(runs: DataFrame, stages: Mapping[str, DataFrame], keys: Sequence[str] = RUN) -> DataFrame:
    """For each run, the first stage (in order) that lacks it; null if all have it."""
    out = runs.select(*keys).distinct()
    for name, df in stages.items():
        own = df.select(*keys).distinct().withColumn(f"_{name}", F.lit(True))
        out = out.join(own, list(keys), "left")
    lost: Column = F.coalesce(*(F.when(F.col(f"_{name}").isNull(), F.lit(name)) for name in stages))
    return out.select(*keys, lost.alias("lost_at"))


def filter_funnel(stages: Mapping[str, DataFrame], keys: Sequence[str] = RUN) -> DataFrame:
    """stage, n_runs: distinct runs after each stage, where stages are tables of their own."""
    rows = [df.agg(F.countDistinct(*keys).alias("n_runs")).select(F.lit(f"{i:02d}_{name}").alias("stage"), "n_runs") for i, (name, df) in enumerate(stages.items())]
    return reduce(DataFrame.unionByName, rows)


def funnel(rows: DataFrame, stages: Mapping[str, Column], keys: Sequence[str] = RUN) -> DataFrame:
    """stage, n_runs where stages are conditions on rows, each on top of those before: one scan, one shuffle by run."""
    held, flags = F.lit(True), {}
    for name, condition in stages.items():
        held = held & F.coalesce(condition, F.lit(False))
        flags[name] = held
    per = rows.groupBy(*keys).agg(*(F.bool_or(c).alias(name) for name, c in flags.items()))
    counted = per.agg(*(F.count_if(F.col(name)).alias(name) for name in flags))
    each = F.array(*(F.struct(F.lit(f"{i:02d}_{name}").alias("stage"), F.col(name).alias("n_runs")) for i, name in enumerate(flags)))
    return counted.select(F.explode(each).alias("s")).select("s.*")


def exclude(df: DataFrame, listed: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Rows whose keys aren't listed."""
    return df.join(listed.select(*keys).distinct(), list(keys), "left_anti")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Keys that only one side has, with the side: empty if both have the same."""
    one = lambda x, y, side: x.select(*keys).distinct().join(y.select(*keys), list(keys), "left_anti").withColumn("only_in", F.lit(side))
    return one(a, b, "left").unionByName(one(b, a, "right"))
