"""Data-quality tables of pings and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from transitlake.functions.geo import bearing, distance, signed_offset_feet
from transitlake.functions.values import safe_div
from transitlake.operators.quantiles import exact_quantiles
from transitlake.operators.windows import RUN, over, rolling_speeds, so_far


def hour_weekday_coverage(rows: DataFrame, kept: Column) -> DataFrame:
    """Kept and all rows by hour and weekday, and their percentage."""
    counted = rows.groupBy("hour", "wday").agg(F.count_if(kept).alias("n_kept"), F.count(F.lit(1)).alias("n_all"))
    return counted.withColumn("percent", F.col("n_kept") * 100.0 / F.col("n_all"))


def _percentiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """A column for each percentile of each group."""
    told = exact_quantiles(rows, by, value, at)
    return told.select(*by, *(F.col("quantiles")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(at)))


def segment_mean_speeds(pings: DataFrame, keys: Sequence[str], at: Sequence[float] = (0.02, 0.25, 0.5, 0.75, 0.98)) -> DataFrame:
    """Percentiles over runs of the mean speed on each segment."""
    per = pings.groupBy(*keys).agg((F.max("odom_ft") - F.min("odom_ft")).alias("feet"), (F.max("sec_past_st") - F.min("sec_past_st")).alias("secs"))
    per = per.withColumn("fps", F.col("feet") / F.when(F.col("secs") != 0, F.col("secs")))
    return _percentiles(per, ["seg_name_id"], "fps", at)


def ping_speed_percentiles(pings: DataFrame, keys: Sequence[str], at: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Percentiles of ping-to-ping speeds of each segment, infinite ones left out."""
    speeds = rolling_speeds(pings, keys).where("fps_next < double('infinity') and fps_next > double('-infinity')")
    return _percentiles(speeds, ["seg_name_id"], "fps_next", at)


def speed_state(fps: Column) -> Column:
    return F.when(fps.isNull(), "undefined").when(fps > 0, "moving").otherwise("stopped")


def state_crosstab(pings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Speed state by vehicle and door state."""
    rows = rolling_speeds(pings, keys).withColumn("speed_state", speed_state(F.col("fps_next"))).withColumn("state", F.concat_ws("_", "veh_state", "door_state"))
    names = ["M_C", "M_O", "S_C", "S_O"]
    counted = rows.groupBy("speed_state").pivot("state", names).agg(F.count(F.lit(1)))
    return counted.select("speed_state", *(F.coalesce(n, F.lit(0)).alias(n.lower()) for n in names))


def state_changes(pings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """How often one state of vehicle and door follows another."""
    state = F.concat_ws("_", "veh_state", "door_state")
    rows = pings.withColumn("from_state", state).withColumn("to_state", F.lead(state).over(over(keys))).where("to_state is not null")
    return rows.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def stopped_in_window_share(pings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Stopped seconds by route, and the share of them inside a stop window."""
    rows = rolling_speeds(pings, keys).where("veh_state = 'S' and secs_marg is not null")
    inside = F.sum(F.when(F.col("stop_window").isNotNull(), F.col("secs_marg")).otherwise(0))
    return rows.groupBy("route").agg(F.sum("secs_marg").alias("stopped_secs"), inside.alias("inside_secs")).withColumn("share", F.col("inside_secs") / F.when(F.col("stopped_secs") != 0, F.col("stopped_secs")))


def completeness(pings: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, nulls of each column, and zero coordinates."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    return pings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *nulls, F.count_if((F.col("lat") == 0) | (F.col("long") == 0)).alias("zero_place"))


def gps_distance(pings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Adds steps and sums of planar GPS distance (x, y in feet) and their difference to the odometer."""
    w = over(keys)
    d = distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    out = pings.withColumns({"gps_step": d, "odom_step": (F.col("odom_ft") - F.lag("odom_ft").over(w)).cast("double")})
    out = out.withColumn("gps_total", F.sum("gps_step").over(so_far(keys)))
    return out.withColumns({"step_difference": F.col("odom_step") - F.col("gps_step"), "total_difference": F.col("odom_ft") - F.min("odom_ft").over(Window.partitionBy(*keys)) - F.col("gps_total")})


def gps_odo_gap(pings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Steps in which only the odometer or only the GPS moved."""
    rows = gps_distance(pings, keys)
    return rows.groupBy(*keys).agg(F.count_if((F.col("odom_step") > 10) & (F.col("gps_step") < 1)).alias("only_odometer"), F.count_if((F.col("odom_step") < 1) & (F.col("gps_step") > 10)).alias("only_gps"))


def speeds_and_accelerations(pings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Adds speed from the row before and the change of that speed a second."""
    w = over(keys)
    secs = F.col("sec_past_st") - F.lag("sec_past_st").over(w)
    out = pings.withColumns({"_secs": secs, "fps": safe_div(F.col("odom_ft") - F.lag("odom_ft").over(w), secs)})
    return out.withColumn("accel", safe_div(F.col("fps") - F.lag("fps").over(w), F.col("_secs"))).drop("_secs")


def undefined_speed_pairs(pings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Adds undefined_pair: a row without a speed next to another such row."""
    rows = rolling_speeds(pings, keys)
    none = F.col("fps_next").isNull()
    w = over(keys)
    pair = none & (F.coalesce(F.lag(none).over(w), F.lit(False)) | F.coalesce(F.lead(none).over(w), F.lit(False)))
    return rows.withColumn("undefined_pair", pair)


def runtime_by_period(runs: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Mean run time by pattern, a column for each period."""
    return runs.groupBy("route", "pattern").pivot("period", list(periods)).agg(F.avg("secs"))


def describe_by(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    told = _percentiles(df, by, value, (0.25, 0.5, 0.75)).withColumnsRenamed({k: f"_{k}" for k in by})
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sums.join(told, same).select(*by, "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def usable_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("route", "pattern").agg(F.count(F.lit(1)).alias("n_runs"))


def top_rows(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the greatest value."""
    return df.orderBy(F.desc(value), *ties).limit(n)


def timespace(pings: DataFrame, n_first: int, keys: Sequence[str] = RUN, by: Sequence[str] = ("wday", "band")) -> DataFrame:
    """Zero-based trajectories of the first runs of each weekday and band. pings: run keys, start_secs and ``by``."""
    group = Window.partitionBy(*keys)
    runs = pings.select(*keys, *by, "start_secs").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("start_secs", *keys)))
    own = pings.join(runs.where(F.col("_i") <= n_first).select(*keys), list(keys), "left_semi")
    return own.withColumns({"feet": F.col("odom_ft") - F.min("odom_ft").over(group), "secs": F.col("sec_past_st") - F.min("sec_past_st").over(group)})


def trajectories(pings: DataFrame, starts: DataFrame, near_feet: float, keys: Sequence[str] = RUN) -> DataFrame:
    """Each run's signed feet and seconds from its ping closest to a segment's start, negative before it.

    pings carry their seg_name_id. starts: seg_name_id, start_lon, start_lat, end_lon, end_lat. Runs that come no nearer than near_feet drop out.
    """
    towards = bearing(F.col("start_lon"), F.col("start_lat"), F.col("end_lon"), F.col("end_lat"))
    met = pings.join(starts, "seg_name_id")
    met = met.withColumn("feet_from_start", signed_offset_feet(F.col("start_lon"), F.col("start_lat"), F.col("long"), F.col("lat"), towards))
    group = Window.partitionBy(*keys, "seg_name_id")
    closest = F.min(F.struct(F.abs("feet_from_start").alias("d"), "index_loc", "sec_past_st")).over(group)
    met = met.withColumn("_c", closest).where(F.col("_c.d") <= near_feet)
    return met.withColumn("secs_from_start", F.col("sec_past_st") - F.col("_c.sec_past_st")).drop("_c")


#: Columns that the completeness table counts nulls of.
COUNTED = ("lat", "long", "odom_ft", "sec_past_st")
#: Groupings of the report's aggregate: name, keys.
REPORT = {
    "state_crosstab": ("speed_state", "state"),
    "state_changes": ("from_state", "to_state"),
    "stopped_in_window_share": ("route",),
    "completeness": RUN,
}


def report_rows(pings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """All tables of the quality report as rows of one, from one scan and one shuffle of pings.

    The windows of all tables share the run's partitioning, and one aggregate with a grouping for each table sums them.
    ``report`` names a row's table; write the result once and take tables from it by report_tables.
    """
    w = over(keys)
    rows = gps_distance(rolling_speeds(pings, keys), keys)
    state = F.concat_ws("_", "veh_state", "door_state")
    stood = F.when((F.col("veh_state") == "S") & F.col("secs_marg").isNotNull(), F.col("secs_marg"))
    rows = rows.withColumns({"speed_state": speed_state(F.col("fps_next")), "state": state, "from_state": state, "to_state": F.lead(state).over(w), "_stood": stood})
    columns = list(dict.fromkeys(c for group in REPORT.values() for c in group))
    sets = [[F.col(c) for c in group] for group in REPORT.values()]
    number = F.grouping_id(*columns)
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.count("to_state").alias("n_followed"),
        F.sum("_stood").alias("stopped_secs"),
        F.sum(F.when(F.col("stop_window").isNotNull(), F.col("_stood")).otherwise(F.when(F.col("_stood").isNotNull(), 0))).alias("inside_secs"),
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in COUNTED),
        F.count_if((F.col("lat") == 0) | (F.col("long") == 0)).alias("zero_place"),
        F.count_if((F.col("odom_step") > 10) & (F.col("gps_step") < 1)).alias("only_odometer"),
        F.count_if((F.col("odom_step") < 1) & (F.col("gps_step") > 10)).alias("only_gps"),
    ]
    # A bit for each column that a grouping leaves out, the first column's highest.
    ids = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in group) for name, group in REPORT.items()}
    name = F.coalesce(*(F.when(F.col("_id") == i, F.lit(name)) for name, i in ids.items()))
    return rows.groupingSets(sets, *columns).agg(number.alias("_id"), *measures).withColumn("report", name).drop("_id")


def report_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables in a (written) result of report_rows."""
    of = lambda name: rows.where(F.col("report") == name)
    kinds = ["M_C", "M_O", "S_C", "S_O"]
    crosstab = of("state_crosstab").groupBy("speed_state").pivot("state", kinds).agg(F.sum("n"))
    share = F.col("inside_secs") / F.when(F.col("stopped_secs") != 0, F.col("stopped_secs"))
    return {
        "state_crosstab": crosstab.select("speed_state", *(F.coalesce(k, F.lit(0)).alias(k.lower()) for k in kinds)),
        "state_changes": of("state_changes").where("to_state is not null").select("from_state", "to_state", F.col("n_followed").alias("n")),
        "stopped_in_window_share": of("stopped_in_window_share").where("stopped_secs is not null").select("route", "stopped_secs", "inside_secs", share.alias("share")),
        "completeness": of("completeness").select(*RUN, "n", *(f"null_{c}" for c in COUNTED), "zero_place"),
        "gps_odo_gap": of("completeness").select(*RUN, "only_odometer", "only_gps"),
    }


def observed(pings: DataFrame, name: str, columns: Sequence[str] = COUNTED) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of their number and gaps that is there once they have been written."""
    seen = Observation(name)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    return pings.observe(seen, F.count(F.lit(1)).alias("n"), *nulls, F.count_if((F.col("lat") == 0) | (F.col("long") == 0)).alias("zero_place")), seen


def quality_report(pings: DataFrame, runs: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """The quality tables by name. With a path, pings are read once: the common table is written there and read again."""
    rows = report_rows(pings)
    if path:
        rows.write.mode("overwrite").partitionBy("report").parquet(path)
        rows = pings.sparkSession.read.schema(rows.schema).parquet(path)
    return report_tables(rows) | {"usable_runs": usable_runs(runs)}
