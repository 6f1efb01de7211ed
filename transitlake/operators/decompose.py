"""Free flow, stop-area phases and travel-time decomposition, for all segments at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions.values import FPS_A_MPH, first_of, last_of, spread
from transitlake.operators.quantiles import exact_quantiles
from transitlake.operators.windows import RUN, change_id, change_id_where, drop_last, fill, rolling_speeds

# Percentiles of free-flow speed, and the share taken as free flow.
PERCENTILES = (0.01, 0.05, 0.10, 0.15, 0.25, 0.50, 0.75, 0.85, 0.90, 0.95, 0.99)
FREE_FLOW = 0.95
MAX_FPS = 73.3
UP_FEET = DOWN_FEET = 150.0
PHASES = ("t_decel_phase", "t_l_initial", "t_stop1", "t_stop", "t_l_addl", "t_accel_phase", "t_nostopnopax", "t_nopax")

SEG = (*RUN, "seg_name_id")
AREA = (*RUN, "seg_name_id", "stop_id")


def filter_to_segment(pings: DataFrame, summary: DataFrame) -> DataFrame:
    """Pings between a run's start and end on each segment, both included."""
    bounds = summary.select(*SEG, "start_index_loc_segment", "end_index_loc_segment")
    joined = pings.join(bounds, list(RUN))
    return joined.where(F.col("index_loc").between(F.col("start_index_loc_segment"), F.col("end_index_loc_segment"))).drop("start_index_loc_segment", "end_index_loc_segment")


def segment_speeds(pings: DataFrame, summary: DataFrame, max_fps: float = MAX_FPS, keys=SEG) -> DataFrame:
    """3-step speeds of pings on segments below the cap."""
    return rolling_speeds(filter_to_segment(pings, summary), keys).where(F.col("fps_next3") < max_fps)


def freeflow(pings: DataFrame, summary: DataFrame, max_fps: float = MAX_FPS, keys=SEG, bounded: bool = False) -> DataFrame:
    """seg_name_id, percentile, fps, mph: percentiles of the 3-step speed below the cap.

    A segment's distinct speeds are one task's state; ``bounded`` selects them in two readings instead (exact_quantiles),
    with the same result, for segments whose speeds outgrow a task.
    """
    at, speeds = F.array(*(F.lit(p) for p in PERCENTILES)), segment_speeds(pings, summary, max_fps, keys)
    if bounded:
        grouped = exact_quantiles(speeds, ["seg_name_id"], "fps_next3", PERCENTILES).withColumnRenamed("quantiles", "p")
    else:
        grouped = speeds.groupBy("seg_name_id").agg(F.percentile("fps_next3", at).alias("p"))
    rows = grouped.select("seg_name_id", F.explode(F.arrays_zip(at.alias("percentile"), F.col("p").alias("fps"))).alias("r"))
    return rows.select("seg_name_id", F.col("r.percentile").alias("percentile"), F.col("r.fps").alias("fps"), (F.col("r.fps") / FPS_A_MPH).alias("mph"))


def free_flow_speed(percentiles: DataFrame) -> DataFrame:
    """seg_name_id, ff: the speed taken as free flow."""
    return percentiles.where(F.col("percentile") == FREE_FLOW).select("seg_name_id", F.col("fps").alias("ff"))


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def stop_area_phases(pings: DataFrame, summary: DataFrame, stops: DataFrame, up: float = UP_FEET, down: float = DOWN_FEET) -> DataFrame:
    """Pings in the area of each segment's stop, with their movement phase.

    stops: run keys, seg_name_id, stop_id, odom_ft_stop. A ping in two areas of a segment counts to the stop further
    on. Missing speeds count as not moving, but don't start or end a change of movement. Fills stay within a group.
    """
    rows = _segment_rows(pings, summary, stops, up, down).where("_own")
    return _with_phases(rows, AREA).drop("_own", "_nth")


def _segment_rows(pings: DataFrame, summary: DataFrame, stops: DataFrame, up: float, down: float) -> DataFrame:
    """Pings of each segment, once for each of its stops, with speeds; _own marks those in a stop's area.

    Stops are joined to the segments' bounds, which are few, so pings are joined once, by run; all windows after that
    keep its partitioning. _nth numbers a segment's stops.
    """
    bounds = summary.select(*SEG, "start_index_loc_segment", "end_index_loc_segment").join(stops.select(*SEG, "stop_id", "odom_ft_stop"), list(SEG), "left")
    nth = F.row_number().over(Window.partitionBy(*SEG).orderBy("odom_ft_stop", "stop_id"))
    rows = pings.join(bounds.withColumn("_nth", nth), list(RUN)).where(F.col("index_loc").between(F.col("start_index_loc_segment"), F.col("end_index_loc_segment")))
    rows = rolling_speeds(rows.drop("start_index_loc_segment", "end_index_loc_segment"), AREA)
    near = _true((F.col("odom_ft") >= F.col("odom_ft_stop") - up) & (F.col("odom_ft") <= F.col("odom_ft_stop") + down))
    last = Window.partitionBy(*SEG, "index_loc").orderBy(F.desc("_near"), F.desc("odom_ft_stop"), F.desc("stop_id"))
    return rows.withColumn("_near", near).withColumn("_own", F.col("_near") & (F.row_number().over(last) == 1)).drop("_near")


def _with_phases(rows: DataFrame, keys) -> DataFrame:
    """Adds door_id, veh_id, at_stop, phase and what they rest on; keys are those of a stop's area."""
    closed = F.col("door_state") == "C"
    known = F.col("fps_next").isNotNull()
    moving = _true(F.col("fps_next") > 0)
    out = rows.withColumns({"_closed": closed, "_moving": moving, "_known": known})
    out = out.withColumns({"door_id": change_id(F.col("_closed"), keys), "_veh": change_id_where(F.col("_moving"), F.col("_known"), keys)})
    out = out.withColumn("veh_id", fill(F.col("_veh"), keys))
    group = Window.partitionBy(*keys)
    open_row, still = F.col("door_state") == "O", F.col("_known") & ~F.col("_moving")
    out = out.withColumns(
        {
            "door_min": F.min(F.when(open_row, F.col("door_id"))).over(group),
            "door_max": F.max(F.when(open_row, F.col("door_id"))).over(group),
            "stop_min": F.min(F.when(still, F.col("veh_id"))).over(group),
            "stop_max": F.max(F.when(still, F.col("veh_id"))).over(group),
            "any_open": F.bool_or(~F.col("_closed")).over(group),
            "_stopped": F.bool_or(still).over(group),
        }
    )
    out = out.withColumn("any_stopped", F.col("_stopped") | F.col("any_open"))

    door, door_min = F.col("door_id"), F.col("door_min")
    by_door = (
        F.when(_true(door < door_min), "t_decel_phase")
        .when(open_row & _true(door == door_min), "t_stop1")
        .when(_true(door > door_min), "t_accel_phase")
        .when(door_min.isNull(), "t_nopax")
        .otherwise("doh")
    )
    veh, lo, hi = F.col("veh_id"), F.col("stop_min"), F.col("stop_max")
    by_veh = (
        F.when(_true(veh < lo), "t_decel_phase")
        .when(_true(veh == lo), "t_stop")
        .when(_true((veh > lo) & (veh <= hi)), "t_l_addl")
        .when(_true(veh > hi), "t_accel_phase")
        .when(lo.isNull(), "t_nostopnopax")
        .otherwise("not relevant")
    )
    out = out.withColumns({"_by_door": by_door, "_by_veh": by_veh})
    with_open = F.bool_or(F.col("_by_door") == "t_stop1").over(Window.partitionBy(*keys, "veh_id"))
    out = out.withColumn("at_stop", F.when(lo.isNull() & (F.col("_by_door") != "t_stop1"), False).otherwise(with_open))
    stands = F.col("at_stop") & _true(F.col("odom_ft_marg") == 0)
    at_stop = (
        F.when(stands & (F.col("_by_door") == "t_decel_phase"), "t_l_initial")
        .when(stands & (F.col("_by_door") == "t_accel_phase"), "t_l_addl")
        .otherwise(F.col("_by_door"))
    )
    at_stop = F.when((at_stop == "t_accel_phase") & _true(door <= F.col("door_max")), "t_l_addl").otherwise(at_stop)
    phase = F.when(~F.col("any_stopped"), "t_nostopnopax").when(~F.col("any_open"), F.col("_by_veh")).otherwise(at_stop)
    return out.withColumn("phase", phase).drop("_closed", "_moving", "_known", "_veh", "_stopped", "_by_door", "_by_veh")


def phase_totals(phases: DataFrame) -> DataFrame:
    """Seconds, extremes and first and last speed of each phase of each run on a segment."""
    return phases.groupBy(*SEG, "phase").agg(
        F.sum("secs_marg").alias("secs"),
        F.min("sec_past_st").alias("sec_min"),
        F.max("sec_past_st").alias("sec_max"),
        F.min("odom_ft").alias("odom_min"),
        F.max("odom_ft").alias("odom_max"),
        first_of("fps_next3").alias("fps_first"),
        last_of("fps_next3").alias("fps_last"),
    )


def phase_columns(totals: DataFrame) -> DataFrame:
    """A row for each run on a segment with a column for each phase, absent phases null."""
    return totals.groupBy(*SEG).pivot("phase", list(PHASES)).agg(F.avg("secs"))


def acceleration_times(totals: DataFrame, ff: DataFrame) -> DataFrame:
    """seg_name_id, t_decacc: time lost in slowing down and speeding up, from the 95th percentile of each rate.

    Only runs that stopped count, and phases of more than one second.
    """
    stopped = totals.where(F.col("phase").isin("t_stop", "t_stop1")).select(*SEG).distinct()
    moving = totals.where(F.col("phase").isin("t_accel_phase", "t_decel_phase")).join(stopped, list(SEG), "left_semi")
    secs = F.col("sec_max") - F.col("sec_min")
    rate = F.abs((F.col("fps_last") - F.col("fps_first")) / F.when(secs != 0, secs))
    rates = exact_quantiles(moving.withColumn("rate", rate).where("rate is not null"), ["seg_name_id", "phase"], "rate", [0.95])
    p95 = F.col("quantiles")[0]
    half = F.abs(F.col("ff") / (2 * F.when(p95 != 0, p95)))
    return rates.join(ff, "seg_name_id").groupBy("seg_name_id").agg(F.sum(half).alias("t_decacc"))


def rate_summary(totals: DataFrame) -> DataFrame:
    """Mean, median and high percentiles of the rates of each segment's phases."""
    secs = F.col("sec_max") - F.col("sec_min")
    rates = totals.withColumn("rate", F.abs((F.col("fps_last") - F.col("fps_first")) / F.when(secs != 0, secs))).where("rate is not null")
    means = rates.groupBy("seg_name_id", "phase").agg(F.avg("rate").alias("mean"))
    told = exact_quantiles(rates, ["seg_name_id", "phase"], "rate", [0.5, 0.9, 0.95]).select("seg_name_id", "phase", *(F.col("quantiles")[i].alias(c) for i, c in enumerate(("median", "p90", "p95"))))
    return means.join(told, ["seg_name_id", "phase"])


def travel_time(pings: DataFrame, summary: DataFrame, phases: DataFrame, ff: DataFrame) -> DataFrame:
    """Each run's time on each segment split into free flow, stop, dwell, stop service and traffic."""
    totals = phase_totals(phases)
    columns = phase_columns(totals)
    whole = filter_to_segment(pings, summary).groupBy(*SEG).agg(spread(F.col("odom_ft")).alias("odom_range"), spread(F.col("sec_past_st")).alias("t_segment"))
    out = summary.select(*SEG).join(whole, list(SEG), "left").join(columns, list(SEG), "left")
    out = out.join(ff, "seg_name_id", "left").join(acceleration_times(totals, ff), "seg_name_id", "left")
    out = out.withColumn("flag_nostop", F.col("t_stop1").isNull() & F.col("t_stop").isNull())
    return split_times(out.na.fill(0.0, [*PHASES, "t_decacc"]))


def travel_times(pings: DataFrame, summary: DataFrame, stops: DataFrame, up: float = UP_FEET, down: float = DOWN_FEET, max_fps: float = MAX_FPS, bounded: bool = False) -> DataFrame:
    """What travel_time gives for stop_area_phases and the free flow of the same pings, in one pass over them.

    Pings are shuffled once, by run. A row for each run on a segment then carries its sums and rates, and percentiles of
    the rates are taken of these rows, a segment's in one task. ``bounded`` selects all of a segment's percentiles by
    exact_quantiles instead: no task holds a segment, but the rows by run are worked out once more for each reading.
    """
    rows = _with_phases(_segment_rows(pings, summary, stops, up, down), (*AREA, "_own"))
    at = lambda p: F.col("_own") & (F.col("phase") == p)
    sums = [F.sum(F.when(at(p), F.col("secs_marg"))).cast("double").alias(p) for p in PHASES]
    moving = ("t_accel_phase", "t_decel_phase")
    ends = []
    for p in moving:
        order, secs = F.when(at(p) & F.col("fps_next3").isNotNull(), F.col("index_loc")), F.when(at(p), F.col("sec_past_st"))
        ends += [F.min_by("fps_next3", order).alias(f"_a_{p}"), F.max_by("fps_next3", order).alias(f"_b_{p}"), (F.max(secs) - F.min(secs)).alias(f"_s_{p}")]
    whole = [spread(F.col("odom_ft")).alias("odom_range"), spread(F.col("sec_past_st")).alias("t_segment"), F.bool_or(at("t_stop") | at("t_stop1")).alias("_stopped")]
    per = rows.groupBy(*SEG).agg(*whole, *sums, *ends)
    per = per.withColumn("flag_nostop", F.col("t_stop1").isNull() & F.col("t_stop").isNull())
    if bounded:
        kinds = []
        for p in moving:
            secs = F.col(f"_s_{p}")
            rate = F.when(F.col("_stopped"), F.abs((F.col(f"_b_{p}") - F.col(f"_a_{p}")) / F.when(secs != 0, secs)))
            kinds.append(F.struct(F.lit(p).alias("kind"), rate.alias("v")))
        # All of a segment's percentiles are one selection: of the speeds, and of both rates.
        each = per.select("seg_name_id", F.explode(F.array(*kinds)).alias("k")).select("seg_name_id", "k.*").where("v is not null")
        speeds = segment_speeds(pings, summary, max_fps).select("seg_name_id", F.lit("ff").alias("kind"), F.col("fps_next3").alias("v"))
        told = exact_quantiles(speeds.unionByName(each), ["seg_name_id", "kind"], "v", [FREE_FLOW])
        of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("quantiles")[0]))
        by_segment = told.groupBy("seg_name_id").agg(of("ff").alias("ff"), *(of(p).alias(f"_p_{p}") for p in moving))
        lost = F.lit(0.0)
        for p in moving:
            lost = lost + F.coalesce(F.abs(F.col("ff") / (2 * F.when(F.col(f"_p_{p}") != 0, F.col(f"_p_{p}")))), F.lit(0.0))
        out = per.join(by_segment, "seg_name_id", "left").withColumn("t_decacc", lost).na.fill(0.0, list(PHASES))
        return split_times(out.drop("_stopped", *(f"_p_{p}" for p in moving), *(f"_{x}_{p}" for p in moving for x in "abs")))
    speed = freeflow(pings, summary, max_fps)
    per = per.join(free_flow_speed(speed), "seg_name_id", "left")
    segment, lost = Window.partitionBy("seg_name_id"), F.lit(0.0)
    for p in moving:
        secs = F.col(f"_s_{p}")
        rate = F.when(F.col("_stopped"), F.abs((F.col(f"_b_{p}") - F.col(f"_a_{p}")) / F.when(secs != 0, secs)))
        per = per.withColumn(f"_p_{p}", F.percentile(rate, F.lit(0.95)).over(segment))
        lost = lost + F.coalesce(F.abs(F.col("ff") / (2 * F.when(F.col(f"_p_{p}") != 0, F.col(f"_p_{p}")))), F.lit(0.0))
    out = per.withColumn("t_decacc", lost).na.fill(0.0, list(PHASES)).drop("_stopped", *(f"_{x}_{p}" for p in moving for x in "absp"))
    return split_times(out)


def split_times(out: DataFrame) -> DataFrame:
    """Adds t_ff, t_stop2 and t_traffic."""
    out = out.withColumn("t_ff", F.col("odom_range") / F.when(F.col("ff") != 0, F.col("ff")))
    out = out.withColumn("t_stop2", F.when(F.col("flag_nostop"), 0.0).otherwise(F.col("t_decacc") + F.col("t_l_initial")))
    return out.withColumn("t_traffic", F.col("t_segment") - F.col("t_ff") - F.col("t_stop2") - F.col("t_stop1") - F.col("t_stop"))


# The acceleration/deceleration method.


def phase_delay(phases: DataFrame, phase: str, name: str) -> DataFrame:
    """A phase's least time at its segment's 95th percentile of mean speed, and what each run took on top."""
    per = phases.where(F.col("phase") == phase).groupBy(*SEG).agg(F.sum("secs_marg").alias("secs"), F.sum("odom_ft_marg").alias("feet"))
    per = per.withColumn("fps", F.col("feet") / F.when(F.col("secs") != 0, F.col("secs")))
    best = exact_quantiles(per, ["seg_name_id"], "fps", [0.95]).select("seg_name_id", F.col("quantiles")[0].alias("p95"))
    least = F.col("feet") / F.when(F.col("p95") != 0, F.col("p95"))
    return per.join(best, "seg_name_id").select(*SEG, "secs", least.alias(f"t_{name}_min"), (F.col("secs") - least).alias(f"t_{name}_delay"))


def outside_stop_area(pings: DataFrame, summary: DataFrame, phases: DataFrame) -> DataFrame:
    """Seconds of each run on a segment outside of its stop areas."""
    inside = drop_last(rolling_speeds(filter_to_segment(pings, summary), SEG), SEG)
    rest = inside.join(phases.select(*SEG, "index_loc"), [*SEG, "index_loc"], "left_anti")
    return rest.groupBy(*SEG).agg(F.sum("secs_marg").alias("t_nonstop"))


def accel_decel_decomposition(pings: DataFrame, summary: DataFrame, phases: DataFrame) -> DataFrame:
    """Seconds by phase and outside the stop area, their total, and the difference to the run's time on the segment."""
    sums = drop_last(phases, SEG).groupBy(*SEG).pivot("phase", list(PHASES)).agg(F.sum("secs_marg"))
    whole = filter_to_segment(pings, summary).groupBy(*SEG).agg(spread(F.col("sec_past_st")).alias("t_segment"))
    out = summary.select(*SEG).join(sums, list(SEG), "left")
    out = out.join(outside_stop_area(pings, summary, phases), list(SEG), "left").join(whole, list(SEG), "left")
    out = out.na.fill(0, [*PHASES, "t_nonstop"])
    total = F.col("t_nonstop")
    for p in PHASES:
        total = total + F.col(p)
    return out.withColumn("t_total", total).withColumn("t_diff", F.col("t_segment") - F.col("t_total"))


def compare_methods(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """Rows in both, their mean difference and the correlation of two measures, by segment."""
    joined = a.select(*SEG, F.col(x).alias("x")).join(b.select(*SEG, F.col(y).alias("y")), list(SEG))
    varied = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return joined.groupBy("seg_name_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("y")).alias("mean_difference"), F.when(varied, F.corr("x", "y")).alias("correlation"))


def approach_delay(phases: DataFrame, ff: DataFrame) -> DataFrame:
    """Time of the approach (slowing down, or passing) beyond free flow, by run on a segment."""
    own = phases.where(F.col("phase").isin("t_decel_phase", "t_nostopnopax"))
    per = own.groupBy(*SEG).agg(F.sum("secs_marg").alias("secs"), F.sum("odom_ft_marg").alias("feet"))
    return per.join(ff, "seg_name_id").withColumn("approach_delay", F.col("secs") - F.col("feet") / F.when(F.col("ff") != 0, F.col("ff")))


def short_segment_tstop2(pings: DataFrame, summary: DataFrame) -> DataFrame:
    """Actual time on a short segment against its distance at the speed of entry."""
    speeds = rolling_speeds(filter_to_segment(pings, summary), SEG)
    per = speeds.groupBy(*SEG).agg(first_of("fps_next").alias("start_fps"), spread(F.col("odom_ft")).alias("feet"), spread(F.col("sec_past_st")).alias("secs"))
    return per.withColumn("t_stop2_short", F.col("secs") - F.col("feet") / F.when(F.col("start_fps") > 0, F.col("start_fps")))
