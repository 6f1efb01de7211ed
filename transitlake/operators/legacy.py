"""The older loader's line machine and its views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions.values import FEET_A_MILE, MPH_A_FPS, extract, half_even, seconds_past_midnight, service_date
from transitlake.operators.runs import PING_FIELDS, TAG, file_fields
from transitlake.operators.windows import over, reset_offset, sessions, so_far

REPEAT_SECONDS = 900
READING_ORDER = ("index_loc",)


def line_kinds(lines: DataFrame) -> DataFrame:
    """Adds kind: run, reading (twelve fields, begins with 3), apc, cal, message or other."""
    line = F.col("line")
    kind = F.when(line.rlike(TAG), "run").when(line.startswith("3") & (F.size(F.split(line, ",")) == len(PING_FIELDS)), "reading")
    return lines.withColumn("kind", kind.when(line.startswith("apc"), "apc").when(line.startswith("cal"), "cal").when(line.startswith("/"), "message").otherwise("other"))


def apc_rows(lines: DataFrame) -> DataFrame:
    """Counts x1 to x6 of APC lines."""
    part = F.split("line", ",")
    own = line_kinds(lines).where("kind = 'apc'")
    return own.select("filename", "line_num", *(F.try_element_at(part, F.lit(i + 2)).try_cast("int").alias(f"x{i + 1}") for i in range(6)))


def message_rows(lines: DataFrame) -> DataFrame:
    """Time and text of messages."""
    own = line_kinds(lines).where("kind = 'message'")
    return own.select("filename", "line_num", F.trim(F.substring("line", 3, 8)).alias("message_time"), F.trim(F.substring("line", 11, 10_000)).alias("message"))


def merge_repeated_runs(runs: DataFrame, gap: int = REPEAT_SECONDS) -> DataFrame:
    """Adds merged_run: the first run of those with the same bus, pattern and date that start less than gap after each other.

    runs: bus_id, route_pattern, run_date, start_seconds and run_id, in order of start.
    """
    keys = ["bus_id", "route_pattern", "run_date"]
    out = runs.withColumn("session", sessions(F.col("start_seconds"), gap, keys, ["start_seconds", "run_id"]))
    return out.withColumn("merged_run", F.min("run_id").over(Window.partitionBy(*keys, "session")))


def corrected_readings(readings: DataFrame, keys=("filename", "index_run_start")) -> DataFrame:
    """Counters made continuous where they fall back; offsets add up."""
    return readings.withColumns({f"{c}_total": F.col(c) + reset_offset(F.col(c), keys, READING_ORDER) for c in ("odom_ft", "sec_past_st")})


def finished_runs(readings: DataFrame, keys=("filename", "index_run_start")) -> DataFrame:
    """Runs whose last odometer reading isn't zero."""
    return readings.groupBy(*keys).agg(F.max_by("odom_ft", "index_loc").alias("last_odom_ft"), F.count(F.lit(1)).alias("n_readings")).where("last_odom_ft <> 0")


def legacy_readings(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, readings, APC rows, messages) of log lines. Run ids are hashes of file and line, not sequences."""
    kinds = line_kinds(lines)
    starts = F.last(F.when(F.col("kind") == "run", F.col("line_num")), ignorenulls=True).over(so_far(["filename"], ["line_num"]))
    owned = kinds.withColumn("run_line", starts)
    part = lambda i: F.regexp_extract("line", TAG, i)
    file = file_fields(F.col("filename"))
    runs = owned.where("kind = 'run'").select(
        F.xxhash64("filename", "line_num").alias("run_id"),
        "filename",
        F.col("line_num").alias("run_line"),
        F.trim(part(1)).alias("route_pattern"),
        part(2).cast("long").alias("bus_id"),
        service_date(extract(F.col("filename"), r"(\d{6})\.txt", 1)).alias("run_date"),
        part(4).alias("run_time"),
        file["file_busid"].alias("file_busid"),
    )
    start = F.split("run_time", ":")
    runs = merge_repeated_runs(runs.withColumn("start_seconds", start[0].cast("int") * 3600 + start[1].cast("int") * 60 + start[2].cast("int")))
    field = F.split("line", ",")
    readings = owned.where("kind = 'reading' and run_line is not null").select("filename", "run_line", F.col("line_num").alias("index_loc"), *(F.trim(field[i]).alias(k) for i, k in enumerate(PING_FIELDS)))
    numbers = {k: F.col(k).try_cast("double") for k in ("lat", "long", "heading", "lat_raw", "long_raw")} | {k: F.col(k).try_cast("long") for k in ("odom_ft", "sec_past_st", "sat_cnt")}
    readings = corrected_readings(readings.withColumns(numbers), ("filename", "run_line"))
    done = finished_runs(readings, ("filename", "run_line")).select("filename", "run_line")
    return runs.join(done, ["filename", "run_line"], "left_semi"), readings.join(done, ["filename", "run_line"], "left_semi"), apc_rows(lines), message_rows(lines)


# The loader's views. Readings: run keys, index_loc, odom_ft, sec_past_st, stop_window and others.

KEYS = ("filename", "index_run_start")


def combined_view(readings: DataFrame, keys=KEYS) -> DataFrame:
    """Differences to the row before, distance since the run's least odometer, and speeds over 1, 2 and 3 rows."""
    w = over(keys)
    feet = lambda n: F.col("odom_ft") - F.lag("odom_ft", n).over(w)
    secs = lambda n: F.col("sec_past_st") - F.lag("sec_past_st", n).over(w)
    speed = lambda n: F.round(F.when(secs(n) > 0, feet(n) / secs(n) * 3600 / FEET_A_MILE).otherwise(0.0), 2)
    least = F.min("odom_ft").over(Window.partitionBy(*keys))
    return readings.withColumns(
        {
            "prev_odo_feet": F.lag("odom_ft").over(w),
            "distance_elapsed": feet(1),
            "trip_distance_elapsed": F.col("odom_ft") - least,
            "prev_time_seconds": F.lag("sec_past_st").over(w),
            "time_elapsed": secs(1),
            **{f"speed{n}": speed(n) for n in (1, 2, 3)},
        }
    )


def trip_adj_view(readings: DataFrame, mark: str = "E01", keys=KEYS) -> DataFrame:
    """Greatest odometer and seconds in the first stop's window."""
    return readings.where(F.col("stop_window") == mark).groupBy(*keys).agg(F.max("odom_ft").alias("adj_feet"), F.max("sec_past_st").alias("adj_secs"))


def gps_reading_view(readings: DataFrame, mark: str = "E01", keys=KEYS) -> DataFrame:
    """Readings from the first stop's window on, counted from there."""
    out = readings.join(trip_adj_view(readings, mark, keys), list(keys)).where(F.col("sec_past_st") - F.col("adj_secs") >= 0)
    return out.withColumns({"odom_ft": F.col("odom_ft") - F.col("adj_feet"), "sec_past_st": F.col("sec_past_st") - F.col("adj_secs")}).drop("adj_feet", "adj_secs")


def data_view(readings: DataFrame, keys=KEYS) -> DataFrame:
    """Speed to the next reading, its 5-mph bin, minutes, and the last stop window so far; rows without a later time go.

    Readings of one second are ordered by index_loc.
    """
    order = ("sec_past_st", "index_loc")
    w = over(keys, order)
    window = F.last("stop_window", ignorenulls=True).over(so_far(keys, order))
    out = readings.withColumns({"next_feet": F.lead("odom_ft").over(w), "next_seconds": F.lead("sec_past_st").over(w), "stop_window_so_far": window})
    out = out.where("sec_past_st <> next_seconds")
    mph = (F.col("next_feet") - F.col("odom_ft")) / (F.col("next_seconds") - F.col("sec_past_st")) * MPH_A_FPS
    return out.withColumns(
        {
            "mph": mph,
            "mph_bin": (F.round(mph / 5) * 5).cast("long"),
            "mins_elapsed": (F.col("next_seconds") - F.col("sec_past_st")) / 60,
            "in_stop_window": F.when(F.substring("stop_window_so_far", 1, 1) == "E", 1).otherwise(0).cast("long"),
        }
    )


def reading_times(readings: DataFrame, start: str = "start_date_time") -> DataFrame:
    """Time of each reading from its run's start, and its seconds past midnight."""
    ts = F.timestamp_seconds(F.unix_timestamp(start) + F.col("sec_past_st"))
    return readings.withColumn("gps_reading_dtm", ts).withColumn("secs_past_midnight", seconds_past_midnight(F.col("gps_reading_dtm")))


def rounded(df: DataFrame, columns, places: int = 2) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), places) for c in columns})
