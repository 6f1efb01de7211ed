"""More registered queries: whole chains, reports in one pass and small helpers, each with its SQL, a clause a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitlake.functions import geo
from transitlake.operators import decompose, fieldcheck, gtfs, legacy, quality, runs, segments, stops
from transitlake.plans import views as V
from transitlake.plans.catalog import CLEAN, DOWN, FAR, LEADS, LONG, MOST, RK, SEG_SUM, SEGK, SQL, UP, query, r6
from transitlake.plans.views import LINES, PINGS, SEGMENTS, SUPPLIERS


@query(f"""
with {LINES},
f as (
  select filename, line_num, cast(event_id * 7 % 400 as varchar) as heading, case when event_id % 5 = 0 then 'O' else 'C' end as door_state, '   ' as stop_window
  from ln
  where event_type in ('view', 'click'))
select filename, line_num,
  try_cast(trim(heading) as double) is not null as is_numeric_heading,
  try_cast(trim(door_state) as double) is not null as is_numeric_door_state,
  try_cast(trim(stop_window) as double) is not null as is_numeric_stop_window
from f""")
def numeric_fields(spark, sf_dir):
    """Which fields of ping lines are numbers."""
    part = F.split("line", ",")
    lines = legacy.line_kinds(V.log_lines(spark, sf_dir)).where("kind = 'reading'")
    own = lines.select("filename", "line_num", part[2].alias("heading"), part[3].alias("door_state"), part[8].alias("stop_window"))
    return runs.numeric_fields(own, ["heading", "door_state", "stop_window"]).drop("heading", "door_state", "stop_window")


@query(f"""
with {PINGS}, {SEGMENTS},
b as (select {SEGK}, min(odom_ft) as a, max(odom_ft) as z from pin group by all)
select {SEGK}, count(*) as n_inside
from p join b using ({RK})
where odom_ft >= a and odom_ft < z
group by all""")
def odometer_segments(spark, sf_dir):
    """Pings of a run on each segment, by half-open odometer bounds."""
    p = V.pings(spark, sf_dir)
    s = V.segment_rows(p)
    inside = p.join(s, ["filename", "index_run_start"]).where(F.col("index_loc").between(F.col("start_index_loc_segment"), F.col("end_index_loc_segment")))
    bounds = inside.groupBy(*segments.KEYS).agg(F.min("odom_ft").alias("a"), F.max("odom_ft").alias("z"))
    own = p.join(bounds, ["filename", "index_run_start"]).where(segments.in_segment(F.col("odom_ft"), F.col("a"), F.col("z")))
    return own.groupBy(*segments.KEYS).agg(F.count(F.lit(1)).alias("n_inside"))


@query(f"""
with {CLEAN}
select cl.filename, cl.index_run_start, cl.stop_id,
  round(p.long, 6) as from_lon, round(p.lat, 6) as from_lat, round(su.stop_lon, 6) as to_lon, round(su.stop_lat, 6) as to_lat
from cl
join p on p.filename = cl.filename and p.index_loc = cl.index_loc
join su on su.stop_id = cl.stop_id""")
def stop_links(spark, sf_dir):
    """The line from each stop's nearest ping to the stop."""
    index = stops.stop_index(V.pings(spark, sf_dir), V.suppliers(spark, sf_dir), MOST)
    end = lambda i, c, name: F.col("link")[i][c].alias(name)
    linked = stops.stop_links(index)
    return r6(linked.select("filename", "index_run_start", "stop_id", end(0, "lon", "from_lon"), end(0, "lat", "from_lat"), end(1, "lon", "to_lon"), end(1, "lat", "to_lat")))


@query(f"""
with {PINGS}, {SUPPLIERS},
s as (select 'sig' || pattern as signature, stop_id, route, stop_sort_order as stop_sequence, x, y from su),
j as (
  select {RK}, index_loc, signature, stop_id, stop_sequence, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) as d
  from p join s using (route))
select {RK}, signature, stop_id, stop_sequence, index_loc, round(d, 6) as dist_to_nearest_point
from j
where d <= 6000
qualify row_number() over (partition by {RK}, signature, stop_id, stop_sequence order by d, index_loc) = 1""")
def gtfs_signature_stops(spark, sf_dir):
    """The ping nearest to each stop of a route's trip signatures, within a radius."""
    s = V.suppliers(spark, sf_dir).select(F.concat(F.lit("sig"), F.col("pattern")).alias("signature"), "stop_id", "route", F.col("stop_sort_order").alias("stop_sequence"), "x", "y")
    near = gtfs.nearest_gtfs_stop(s, V.pings(spark, sf_dir), by_signature=True, within=6000.0, digits=6, single=True)
    return near.select("filename", "index_run_start", "signature", "stop_id", "stop_sequence", "index_loc", "dist_to_nearest_point")


@query("""
select distinct c_custkey % 5 as route
from customer
where c_custkey % 5 not in (select s_suppkey % 3 from supplier)""")
def missing_routes(spark, sf_dir):
    """Routes that are wanted but not scheduled."""
    wanted = V.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).cast("long").alias("route"))
    return stops.missing_routes(wanted, V.suppliers(spark, sf_dir))


@query(f"""
with {PINGS}, {LEADS.format(src="p", keys=RK)},
g as (
  select *, veh_state || '_' || door_state as state, lead(veh_state || '_' || door_state) over w as to_state,
    odom_ft - lag(odom_ft) over w as odom_step,
    sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) as gps_step,
    case when veh_state = 'S' then secs_marg end as stood
  from sf
  window w as (partition by {RK} order by index_loc)),
k as (select *, state as from_state, case when fps_next is null then 'undefined' when fps_next > 0 then 'moving' else 'stopped' end as speed_state from g)
select case
    when grouping(speed_state) = 0 then 'state_crosstab'
    when grouping(from_state) = 0 then 'state_changes'
    when grouping(route) = 0 then 'stopped_in_window_share'
    else 'completeness' end as report,
  speed_state, state, from_state, to_state, route, {RK},
  count(*) as n,
  count(to_state) as n_followed,
  cast(sum(stood) as bigint) as stopped_secs,
  cast(sum(case when stop_window is not null then stood when stood is not null then 0 end) as bigint) as inside_secs,
  count(*) filter (lat is null) as null_lat,
  count(*) filter (long is null) as null_long,
  count(*) filter (odom_ft is null) as null_odom_ft,
  count(*) filter (sec_past_st is null) as null_sec_past_st,
  count(*) filter (lat = 0 or long = 0) as zero_place,
  count(*) filter (odom_step > 10 and gps_step < 1) as only_odometer,
  count(*) filter (odom_step < 1 and gps_step > 10) as only_gps
from k
group by grouping sets ((speed_state, state), (from_state, to_state), (route), ({RK}))""")
def quality_rows(spark, sf_dir):
    """All tables of the quality report from one scan."""
    return quality.report_rows(V.pings(spark, sf_dir))


@query(f"""
with {PINGS}
select unnest(['00_all', '01_open', '02_window', '03_late']) as stage,
  unnest([
    count(distinct ({RK})),
    count(distinct ({RK})) filter (kind <> 'view'),
    count(distinct ({RK})) filter (kind <> 'view' and stop_window is not null),
    count(distinct ({RK})) filter (kind <> 'view' and stop_window is not null and index_loc % 50 > 40)]) as n_runs
from p""")
def condition_funnel(spark, sf_dir):
    """Runs left after each condition, from one scan."""
    late = F.col("index_loc") % 50 > 40
    return fieldcheck.funnel(V.pings(spark, sf_dir), {"all": F.lit(True), "open": F.col("kind") != "view", "window": F.col("stop_window").isNotNull(), "late": late})


@query(f"""
with {LINES}
select filename, line_num, strftime(ts, '%H:%M:%S') as message_time, 'Buswares navigation reported end of route' as message
from ln
where event_type = 'error'""")
def legacy_messages(spark, sf_dir):
    """Messages of log lines."""
    return legacy.legacy_readings(V.log_lines(spark, sf_dir))[3].select("filename", "line_num", "message_time", "message")


@query(f"""
with {LINES}
select filename, line_num, 55 as x1, 14 as x2, 1 as x3, 21 as x4, 0 as x5, 0 as x6
from ln
where event_type = 'purchase'""")
def legacy_apc(spark, sf_dir):
    """Passenger counts of log lines."""
    return r6(legacy.legacy_readings(V.log_lines(spark, sf_dir))[2].select("filename", "line_num", *(f"x{i}" for i in range(1, 7))))


@query("""
with f as (
  select event_id as obs_id, date_trunc('day', ts) as d,
    strftime(ts, '%H:%M:%S') as front,
    strftime(ts - to_seconds(event_id % 60), '%H:%M:%S') as rear,
    strftime(ts + to_seconds(event_id % 100 - 50), '%H:%M:%S') as gone,
    event_id % 3 as m, event_id % 60 as s
  from events),
t as (
  select obs_id, m * 60 + s as dwell,
    strptime(strftime(d, '%Y-%m-%d') || ' ' || gone, '%Y-%m-%d %H:%M:%S') as gone,
    strptime(strftime(d, '%Y-%m-%d') || ' ' || least(front, rear), '%Y-%m-%d %H:%M:%S') as closed
  from f)
select obs_id, cast(dwell as double) as dwell_secs, case when gone >= closed then cast(epoch(gone) - epoch(closed) as bigint) end as signal_delay, 'North ' || (obs_id % 2) as place
from t""")
def field_types(spark, sf_dir):
    """Observation sheets with times and seconds."""
    e, k = V.table(spark, sf_dir, "events"), F.col("event_id")
    clock = lambda seconds: F.date_format(F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) + seconds), "HH:mm:ss")
    sheet = e.select(
        k.alias("obs_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_obs_field"),
        clock(F.lit(0)).alias("front_door_close_field"),
        clock(-(k % 60)).alias("rear_door_close_field"),
        clock(k % 100 - 50).alias("time_left_stop_zone_field"),
        F.concat((k % 3).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0")).alias("dwell_time_field"),
        F.concat(F.lit("n"), (k % 2).cast("string")).alias("field_qjump_loc"),
    )
    out = fieldcheck.correct_types(sheet, {"n0": "North 0", "n1": "North 1"})
    return out.select("obs_id", "dwell_secs", "signal_delay", F.col("field_qjump_loc").alias("place"))


@query(f"""
with {CLEAN.replace(f"d < {MOST}", "d < 100.0")},
listed as (select distinct {RK}, route, pattern from p where user_id % 3 <> 0),
b as (select {RK}, min(index_loc) as lo, max(index_loc) as hi, count(*) as n from cl group by all),
s as (select route, pattern, count(*) as n from su group by all),
t as (select {RK}, max(odom_ft) - min(odom_ft) as trip_dist_ft, count(*) as n_pings from p join b using ({RK}) where index_loc between lo and hi group by all)
select {RK}, trip_dist_ft, b.n as n_found, s.n as n_scheduled, s.n - b.n as n_missing
from listed
join t using ({RK})
join b using ({RK})
join s using (route, pattern)""")
def merge_stops(spark, sf_dir):
    """Listed runs with their stops: summaries and what is missing."""
    p = V.pings(spark, sf_dir)
    listed = p.where("user_id % 3 <> 0").select("filename", "index_run_start", "route", "pattern").distinct()
    summary, _ = stops.merge_stops(p, listed, V.suppliers(spark, sf_dir))
    return summary.select("filename", "index_run_start", "trip_dist_ft", "n_found", "n_scheduled", "n_missing")


@query(
    SEG_SUM.replace(f"d > {FAR}", "d > 50.0").replace(f"> {LONG}", "> 150.0")
    + f"""
select {SEGK}, s1 - s0 as trip_dur_sec_segment, flag_too_far_any, flag_wrong_order_any, flag_too_long_odom, cast(substr(filename, 4) as bigint) as bus
from sx
where cast(substr(filename, 4) as bigint) % 2 = 0"""
)
def merge_segments(spark, sf_dir):
    """Listed runs on their segments, with the runs' own columns."""
    lines = V.lines_of_suppliers(spark, sf_dir)
    k = F.substring("seg_name_id", 5, 20).cast("long")
    patterns = lines.select((k % 3).alias("route"), (k % 2).alias("pattern"), "seg_name_id")
    x, y = geo.lcc_feet(F.col("long"), F.col("lat"))
    p = V.pings(spark, sf_dir).withColumns({"x": x, "y": y})
    listed = p.where("user_id % 2 = 0").select("filename", "index_run_start", F.col("user_id").cast("long").alias("bus")).distinct()
    _, summary = segments.merge_segments(p, listed, lines, patterns, single=True)
    return summary.select(*segments.KEYS, "trip_dur_sec_segment", "flag_too_far_any", "flag_wrong_order_any", "flag_too_long_odom", "bus")


@query(f"""
with {PINGS},
fo as (select event_id as obs_id, route, user_id as bus_id, sec_past_st + event_id % 900 - 450 as obs_secs from p where kind = 'error'),
pa as (select {RK}, route, user_id as bus_id, min(sec_past_st) as pass_secs from p where kind = 'error' group by all),
de as (select {RK}, count(*) filter (door_state = 'O')::double as t_stop1, (max(sec_past_st) - min(sec_past_st))::double as t_traffic from p where user_id % 2 = 0 group by all),
m as (select obs_id, {RK}, pass_secs - obs_secs as delta from fo join pa using (route, bus_id) where abs(pass_secs - obs_secs) <= 1000),
j as (select m.*, t_stop1, t_traffic from m left join de using ({RK}))
select fo.obs_id, {RK}, delta, t_stop1, t_traffic,
  cast(fo.obs_id in (select obs_id from m) as bigint) as has_run,
  cast(fo.obs_id in (select obs_id from j where t_stop1 is not null) as bigint) as has_decomposition
from fo left join j using (obs_id)""")
def compare_field(spark, sf_dir):
    """Observations against runs and their decomposition."""
    p = V.pings(spark, sf_dir)
    errors = p.where("kind = 'error'")
    field = errors.select(F.col("event_id").alias("obs_id"), "route", F.col("user_id").alias("bus_id"), (F.col("sec_past_st") + F.col("event_id") % 900 - 450).alias("obs_secs"))
    passes = errors.groupBy("filename", "index_run_start", "route", F.col("user_id").alias("bus_id")).agg(F.min("sec_past_st").alias("pass_secs"))
    times = p.where("user_id % 2 = 0").groupBy("filename", "index_run_start")
    times = times.agg(F.count_if(F.col("door_state") == "O").cast("double").alias("t_stop1"), (F.max("sec_past_st") - F.min("sec_past_st")).cast("double").alias("t_traffic"))
    out = fieldcheck.compare_field(field, passes, times)
    return out.select("obs_id", "filename", "index_run_start", "delta", "t_stop1", "t_traffic", "has_run", "has_decomposition")


@query(SQL["freeflow_percentiles"])
def freeflow_bounded(spark, sf_dir):
    """Free-flow percentiles by selection: no task holds a segment."""
    p = V.pings(spark, sf_dir)
    return r6(decompose.freeflow(p, V.segment_rows(p), bounded=True))


@query(SQL["travel_time_decomposition"])
def travel_time_bounded(spark, sf_dir):
    """The decomposition with all percentiles of a segment by selection."""
    p = V.pings(spark, sf_dir)
    out = decompose.travel_times(p, V.segment_rows(p), V.segment_stops(p), UP, DOWN, bounded=True)
    return r6(out.select("filename", "index_run_start", "seg_name_id", "t_segment", "flag_nostop", "t_ff", "t_stop", "t_stop1", "t_stop2", "t_traffic"))
