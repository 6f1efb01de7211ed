"""The registered queries over the driver's tables, and their SQL.

Doubles are rounded to six places on both sides, as engines add and interpolate in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.functions import geo, values
from transitlake.operators import decompose, dwell, fieldcheck, gtfs, legacy, nearest, quality, runs, segments, stops, windows
from transitlake.plans import views as V
from transitlake.plans.views import LINES, PINGS, SEGMENTS, STOPS, SUPPLIERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UP = DOWN = 600.0
RK = "filename, index_run_start"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded, integers as long."""
    kinds = {"double": lambda c: F.round(c, 6), "float": lambda c: F.round(c.cast("double"), 6), "int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long")}
    return df.select(*(kinds[k](F.col(c)).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes))


# Speeds

LEADS = """
sp as (select *, lead(odom_ft) over w - odom_ft as odom_ft_marg, lead(sec_past_st) over w - sec_past_st as secs_marg,
  lead(odom_ft, 3) over w - odom_ft as d3, lead(sec_past_st, 3) over w - sec_past_st as t3 from {src} window w as (partition by {keys} order by index_loc)),
sf as (select *, case when secs_marg <> 0 then odom_ft_marg / secs_marg::double when odom_ft_marg > 0 then 'inf'::double when odom_ft_marg < 0 then '-inf'::double end as fps_next,
  case when t3 <> 0 then d3 / t3::double when d3 > 0 then 'inf'::double when d3 < 0 then '-inf'::double end as fps_next3 from sp)
"""
SEGK = "filename, index_run_start, seg_name_id"
IN_SEG = f"with {PINGS}, {SEGMENTS}, " + LEADS.format(src="pin", keys=SEGK)
FF = "ff as (select seg_name_id, quantile_cont(fps_next3, 0.95) as ff from sf where fps_next3 < 73.3 group by all)"


@query(IN_SEG + f""", pc as (select unnest([{', '.join(map(str, decompose.PERCENTILES))}]) as percentile),
q as (select seg_name_id, quantile_cont(fps_next3, [{', '.join(map(str, decompose.PERCENTILES))}]) as v from sf where fps_next3 < 73.3 group by all),
u as (select seg_name_id, unnest([{', '.join(map(str, decompose.PERCENTILES))}]) as percentile, unnest(v) as fps from q)
select seg_name_id, round(percentile::double, 6) as percentile, round(fps, 6) as fps, round(fps / 1.467, 6) as mph from u""")
def freeflow_percentiles(spark, sf_dir):
    """Percentiles of free-flow speed on each segment."""
    p = V.pings(spark, sf_dir)
    return r6(decompose.freeflow(p, V.segment_rows(p)))


@query(f"with {PINGS}, " + LEADS.format(src="p", keys=RK) + """
select filename, index_loc, odom_ft_marg, secs_marg, round(case when isinf(fps_next) then -1 else fps_next end, 6) as fps_next, round(case when isinf(fps_next3) then -1 else fps_next3 end, 6) as fps_next3
  from sf""")
def rolling_speeds(spark, sf_dir):
    """Speeds over the next one and three rows (infinite ones as -1)."""
    out = windows.rolling_speeds(V.pings(spark, sf_dir))
    finite = lambda c: F.when(F.abs(c) == float("inf"), -1.0).otherwise(F.col(c)).alias(c)
    return r6(out.select("filename", "index_loc", "odom_ft_marg", "secs_marg", finite("fps_next"), finite("fps_next3")))


def _speed_sql(n: int) -> str:
    t, d = f"(sec_past_st - lag(sec_past_st, {n}) over w)", f"(odom_ft - lag(odom_ft, {n}) over w)"
    return f"round(coalesce(case when {t} > 0 then {d} / {t}::double * 3600 / 5280.0::double else 0 end, 0), 2) as speed{n}"


@query(f"""with {PINGS} select filename, index_loc, lag(odom_ft) over w as prev_odo_feet, odom_ft - lag(odom_ft) over w as distance_elapsed,
odom_ft - min(odom_ft) over (partition by {RK}) as trip_distance_elapsed, sec_past_st - lag(sec_past_st) over w as time_elapsed, {_speed_sql(1)}, {_speed_sql(2)}, {_speed_sql(3)}
from p window w as (partition by {RK} order by index_loc)""")
def lag_speeds_view(spark, sf_dir):
    """The loader's combined view."""
    out = legacy.combined_view(V.pings(spark, sf_dir))
    return r6(out.select("filename", "index_loc", "prev_odo_feet", "distance_elapsed", "trip_distance_elapsed", "time_elapsed", "speed1", "speed2", "speed3"))


@query(f"""with {PINGS}, d as (select *, lead(odom_ft) over w as nf, lead(sec_past_st) over w as ns, last_value(stop_window ignore nulls) over (w rows unbounded preceding) as sw
from p window w as (partition by {RK} order by sec_past_st, index_loc)),
m as (select *, (nf - odom_ft) / (ns - sec_past_st)::double * 0.681818::double as mph
  from d where sec_past_st <> ns)
select filename, index_loc, round(mph, 6) as mph, cast(round(mph / 5) * 5 as bigint) as mph_bin, round((ns - sec_past_st) / 60.0::double, 6) as mins_elapsed, sw as stop_window_so_far, cast(case when sw[1] = 'E' then 1 else 0 end as bigint) as in_stop_window
  from m""")
def next_speed_bins_view(spark, sf_dir):
    """The loader's data view."""
    out = legacy.data_view(V.pings(spark, sf_dir))
    return r6(out.select("filename", "index_loc", "mph", "mph_bin", "mins_elapsed", "stop_window_so_far", "in_stop_window"))


@query(f"""with {PINGS}, a as (select {RK}, max(odom_ft) as af, max(sec_past_st) as asec from p where stop_window = 'E01' group by all)
select filename, index_loc, odom_ft - af as odom_ft, sec_past_st - asec as sec_past_st from p join a using ({RK}) where sec_past_st - asec >= 0""")
def adjusted_readings_view(spark, sf_dir):
    """Readings counted from the first stop's window."""
    return legacy.gps_reading_view(V.pings(spark, sf_dir)).select("filename", "index_loc", "odom_ft", "sec_past_st")


@query(f"with {PINGS} select {RK}, max(odom_ft) as adj_feet, max(sec_past_st) as adj_secs from p where stop_window = 'E01' group by all")
def trip_adjustments(spark, sf_dir):
    """Offsets of the first stop's window."""
    return legacy.trip_adj_view(V.pings(spark, sf_dir))


@query(f"""with {PINGS} select filename, index_loc, last_value(stop_window ignore nulls) over (partition by {RK}
  order by index_loc rows unbounded preceding) as stop_window, cast(regexp_extract(stop_window, 'E([0-9]*)', 1) as varchar) as token
  from p""")
def stop_window_fill(spark, sf_dir):
    """Last stop window so far, and the number of the row's own."""
    p = V.pings(spark, sf_dir)
    return p.select("filename", "index_loc", windows.last_known(F.col("stop_window")).alias("stop_window"), F.regexp_extract("stop_window", r"E(\d*)", 1).alias("token"))


# State runs

@query(f"""with {PINGS}, c as (select *, case when lag(door_state) over w is null or door_state <> lag(door_state) over w then 1 else 0 end as ch
  from p window w as (partition by {RK} order by index_loc))
select filename, index_loc, cast(sum(ch) over (partition by {RK} order by index_loc rows unbounded preceding) as bigint) as door_id from c""")
def door_run_ids(spark, sf_dir):
    """Numbers of the spells of one door state."""
    return V.pings(spark, sf_dir).select("filename", "index_loc", windows.change_id(F.col("door_state")).alias("door_id"))


MOVE = f"""with {PINGS}, """ + LEADS.format(src="p", keys=RK) + f""", mv as (select *, coalesce(fps_next > 0, false) as moving, fps_next is not null as known from sf),
ml as (select *, last_value(case when known then moving end ignore nulls) over (partition by {RK}
  order by index_loc rows between unbounded preceding and 1 preceding) as before
  from mv),
mi as (select *, case when known then cast(sum(case when known and (before is null or moving <> before) then 1 else 0 end) over (partition by {RK}
  order by index_loc rows unbounded preceding) as bigint) end as vid
  from ml)
"""


@query(MOVE + f"""select filename, index_loc, vid as veh_id, coalesce(last_value(vid ignore nulls) over (partition by {RK}
  order by index_loc rows unbounded preceding),
first_value(vid ignore nulls) over (partition by {RK} order by index_loc rows between current row and unbounded following)) as veh_id_filled from mi""")
def vehicle_run_ids(spark, sf_dir):
    """Numbers of the spells of movement, over rows with a speed, then filled."""
    p = windows.rolling_speeds(V.pings(spark, sf_dir))
    p = p.withColumn("veh_id", windows.change_id_where(F.coalesce(F.col("fps_next") > 0, F.lit(False)), F.col("fps_next").isNotNull()))
    return p.select("filename", "index_loc", "veh_id", windows.fill(F.col("veh_id")).alias("veh_id_filled"))


# Stop areas and travel time

AREA = "filename, index_run_start, seg_name_id, stop_id"
PHASED = f"with {PINGS}, {SEGMENTS}, {STOPS}, pst as (select pin.*, stop_id, odom_ft_stop from pin join st using ({SEGK})), " + LEADS.format(src="pst", keys=AREA) + f""",
ar as (select * from sf where odom_ft >= odom_ft_stop - {UP} and odom_ft <= odom_ft_stop + {DOWN}
  qualify row_number() over (partition by {SEGK}, index_loc order by odom_ft_stop desc, stop_id desc) = 1),
a1 as (select *, door_state = 'C' as closed, coalesce(fps_next > 0, false) as moving, fps_next is not null as known from ar),
a2 as (select *, case when lag(closed) over w is null or closed <> lag(closed) over w then 1 else 0 end as dch,
  last_value(case when known then moving end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as before from a1 window w as (partition by {AREA} order by index_loc)),
a3 as (select *, cast(sum(dch) over w as bigint) as door_id, case when known then cast(sum(case when known and (before is null or moving <> before) then 1 else 0 end) over w as bigint) end as vid
  from a2 window w as (partition by {AREA} order by index_loc rows unbounded preceding)),
a4 as (select *, coalesce(last_value(vid ignore nulls) over (partition by {AREA}
  order by index_loc rows unbounded preceding), first_value(vid ignore nulls) over (partition by {AREA}
  order by index_loc rows between current row and unbounded following)) as veh_id
  from a3),
a5 as (select *, min(case when not closed then door_id end) over g as door_min, max(case when not closed then door_id end) over g as door_max,
  min(case when known and not moving then veh_id end) over g as stop_min, max(case when known and not moving then veh_id end) over g as stop_max,
  bool_or(not closed) over g as any_open, bool_or(known and not moving) over g or bool_or(not closed) over g as any_stopped from a4 window g as (partition by {AREA})),
a6 as (select *, case when door_id < door_min then 't_decel_phase' when not closed and door_id = door_min then 't_stop1' when door_id > door_min then 't_accel_phase' when door_min is null then 't_nopax' else 'doh' end as bd,
  case when veh_id < stop_min then 't_decel_phase' when veh_id = stop_min then 't_stop' when veh_id > stop_min and veh_id <= stop_max then 't_l_addl' when veh_id > stop_max then 't_accel_phase' when stop_min is null then 't_nostopnopax' else 'not relevant' end as bv from a5),
a7 as (select *, case when stop_min is null and bd <> 't_stop1' then false else bool_or(bd = 't_stop1') over (partition by {AREA}, veh_id) end as at_stop
  from a6),
a8 as (select *, case when at_stop and odom_ft_marg = 0 and bd = 't_decel_phase' then 't_l_initial' when at_stop and odom_ft_marg = 0 and bd = 't_accel_phase' then 't_l_addl' else bd end as b2
  from a7),
ph as (select *, case when not any_stopped then 't_nostopnopax' when not any_open then bv when b2 = 't_accel_phase' and door_id <= door_max then 't_l_addl' else b2 end as phase
  from a8)
"""


def phased(spark, sf_dir):
    p = V.pings(spark, sf_dir)
    s = V.segment_rows(p)
    return p, s, decompose.stop_area_phases(p, s, V.segment_stops(p), UP, DOWN)


@query(PHASED + "select filename, index_loc, seg_name_id, stop_id, door_id, veh_id, at_stop, phase, secs_marg from ph")
def stop_area_phases(spark, sf_dir):
    """Movement phases of the pings around each stop."""
    return phased(spark, sf_dir)[2].select("filename", "index_loc", "seg_name_id", "stop_id", "door_id", "veh_id", "at_stop", "phase", "secs_marg")


TOTALS = f"""tt as (select {SEGK}, phase, cast(sum(secs_marg) as bigint) as secs, min(sec_past_st) as s0, max(sec_past_st) as s1, min(odom_ft) as o0, max(odom_ft) as o1, arg_min(fps_next3, index_loc) as f0, arg_max(fps_next3, index_loc) as f1 from ph group by all)"""
# The free flow of PHASED's speeds lacks pings outside of stops' segments, so it is taken from all pings of segments.
FF_ALL = f"""l3 as (select seg_name_id, lead(odom_ft, 3) over w - odom_ft as d, lead(sec_past_st, 3) over w - sec_past_st as t
  from pin window w as (partition by {SEGK} order by index_loc)),
ff as (select seg_name_id, quantile_cont(case when t <> 0 then d / t::double when d > 0 then 'inf'::double end, 0.95) filter (case when t <> 0 then d / t::double < 73.3 else false end) as ff
  from l3 group by all)"""


@query(PHASED + ", " + TOTALS + " select filename, index_run_start, seg_name_id, phase, secs, s0 as sec_min, s1 as sec_max, o0 as odom_min, o1 as odom_max from tt")
def phase_totals(spark, sf_dir):
    """Seconds and extremes of each phase."""
    out = decompose.phase_totals(phased(spark, sf_dir)[2])
    return out.select("filename", "index_run_start", "seg_name_id", "phase", F.col("secs").cast("long"), "sec_min", "sec_max", "odom_min", "odom_max")


_P = decompose.PHASES
TRAVEL = PHASED + ", " + TOTALS + ", " + FF_ALL + f""",
stopped as (select distinct {SEGK} from tt where phase in ('t_stop', 't_stop1')),
rt as (select seg_name_id, phase, quantile_cont(abs((f1 - f0) / (s1 - s0)::double), 0.95) as p95
  from tt semi join stopped using ({SEGK}) where phase in ('t_accel_phase', 't_decel_phase') and s1 <> s0 and f1 is not null and f0 is not null
  group by all),
da as (select seg_name_id, sum(case when p95 <> 0 then abs(ff / (2 * p95)) end) as t_decacc from rt join ff using (seg_name_id) group by all),
pv as (select {SEGK}, {', '.join(f"avg(secs) filter (phase = '{x}') as {x}" for x in _P)} from tt group by all),
wh as (select {SEGK}, max(odom_ft) - min(odom_ft) as odom_range, max(sec_past_st) - min(sec_past_st) as t_segment from pin group by all),
tr as (select w.*, ff, coalesce(t_decacc, 0) as t_decacc, t_stop1 is null and t_stop is null as flag_nostop, {', '.join(f"coalesce({x}, 0) as {x}" for x in _P)}
  from wh w left join pv using ({SEGK}) left join ff using (seg_name_id)
  left join da using (seg_name_id)),
tv as (select *, odom_range / (case when ff <> 0 then ff end) as t_ff, case when flag_nostop then 0 else t_decacc + t_l_initial end as t_stop2
  from tr),
tx as (select *, t_segment - t_ff - t_stop2 - t_stop1 - t_stop as t_traffic from tv)
"""


def travel(spark, sf_dir):
    p = V.pings(spark, sf_dir)
    return decompose.travel_times(p, V.segment_rows(p), V.segment_stops(p), UP, DOWN)


@query(TRAVEL + """select filename, index_run_start, seg_name_id, t_segment, flag_nostop, round(t_ff, 6) as t_ff, round(t_stop, 6) as t_stop, round(t_stop1, 6) as t_stop1, round(t_stop2, 6) as t_stop2, round(t_traffic, 6) as t_traffic
  from tx""")
def travel_time_decomposition(spark, sf_dir):
    """Each run's time on each segment, split."""
    return r6(travel(spark, sf_dir).select("filename", "index_run_start", "seg_name_id", "t_segment", "flag_nostop", "t_ff", "t_stop", "t_stop1", "t_stop2", "t_traffic"))


@query(PHASED + f""", n1 as (select * from ph qualify row_number() over (partition by {SEGK} order by index_loc desc) > 1),
pv as (select {SEGK}, {', '.join(f"cast(sum(secs_marg) filter (phase = '{x}') as bigint) as {x}" for x in _P)} from n1 group by all),
pl as (select *, lead(sec_past_st) over (partition by {SEGK}
  order by index_loc) - sec_past_st as sm from pin qualify row_number() over (partition by {SEGK}
  order by index_loc desc) > 1),
ns as (select {SEGK}, cast(sum(sm) as bigint) as t_nonstop from pl anti join ph using ({SEGK}, index_loc) group by all),
wh as (select {SEGK}, max(sec_past_st) - min(sec_past_st) as t_segment from pin group by all),
al as (select {SEGK}, t_segment, coalesce(t_nonstop, 0) as t_nonstop, {', '.join(f"coalesce({x}, 0) as {x}" for x in _P)}
  from wh left join pv using ({SEGK}) left join ns using ({SEGK}))
select {SEGK}, t_nonstop, t_stop1, t_accel_phase, t_nonstop + {' + '.join(_P)} as t_total, t_segment - (t_nonstop + {' + '.join(_P)}) as t_diff
  from al""")
def accel_decel_decomposition(spark, sf_dir):
    """Seconds by phase, outside of the stop area, and their total."""
    out = decompose.accel_decel_decomposition(*phased(spark, sf_dir))
    return out.select("filename", "index_run_start", "seg_name_id", "t_nonstop", "t_stop1", "t_accel_phase", "t_total", "t_diff")


@query(PHASED + f""", pr as (select {SEGK}, sum(secs_marg) as secs, sum(odom_ft_marg) as feet from ph where phase = 't_accel_phase' group by all),
bs as (select seg_name_id, quantile_cont(case when secs <> 0 then feet / secs::double end, 0.95) as p95 from pr group by all)
select {SEGK}, cast(secs as bigint) as secs, round(feet / (case when p95 <> 0 then p95 end), 6) as t_accel_min, round(secs - feet / (case when p95 <> 0 then p95 end), 6) as t_accel_delay
  from pr join bs using (seg_name_id)""")
def phase_delay(spark, sf_dir):
    """What each run's acceleration took beyond its least time."""
    return r6(decompose.phase_delay(phased(spark, sf_dir)[2], "t_accel_phase", "accel"))


@query(PHASED + ", " + TOTALS + """, r as (select seg_name_id, phase, abs((f1 - f0) / (s1 - s0)::double) as rate
  from tt where s1 <> s0 and f1 is not null and f0 is not null)
select seg_name_id, phase, round(avg(rate), 6) as mean, round(quantile_cont(rate, 0.5), 6) as median, round(quantile_cont(rate, 0.9), 6) as p90, round(quantile_cont(rate, 0.95), 6) as p95
  from r group by all""")
def phase_rates(spark, sf_dir):
    """Rates of change of speed by phase."""
    return r6(decompose.rate_summary(decompose.phase_totals(phased(spark, sf_dir)[2])))


@query(TRAVEL + f""", s2 as (select {SEGK}, sum(secs_marg) as y from ph group by all)
select seg_name_id, count(*) as n, round(avg(t_segment - y), 6) as mean_difference, round(case when stddev_pop(t_segment) > 0 and stddev_pop(y) > 0 then corr(t_segment, y) end, 6) as correlation
  from tx join s2 using ({SEGK}) group by all""")
def method_comparison(spark, sf_dir):
    """Two measures of time on a segment against each other."""
    _, _, ph = phased(spark, sf_dir)
    b = ph.groupBy(*decompose.SEG).agg(F.sum("secs_marg").alias("y"))
    return r6(decompose.compare_methods(travel(spark, sf_dir), b, "t_segment", "y"))


@query(PHASED + ", " + FF_ALL + f""", o as (select {SEGK}, sum(secs_marg) as secs, sum(odom_ft_marg) as feet
  from ph where phase in ('t_decel_phase', 't_nostopnopax') group by all)
select {SEGK}, cast(secs as bigint) as secs, round(secs - feet / (case when ff <> 0 then ff end), 6) as approach_delay
  from o join ff using (seg_name_id)""")
def approach_delay(spark, sf_dir):
    """Time of the approach beyond free flow."""
    p, s, ph = phased(spark, sf_dir)
    out = decompose.approach_delay(ph, decompose.free_flow_speed(decompose.freeflow(p, s)))
    return r6(out.select(*decompose.SEG, F.col("secs").cast("long").alias("secs"), "approach_delay"))


@query(IN_SEG + f""", m as (select {SEGK}, arg_min(fps_next, index_loc) filter (fps_next is not null) as f0, max(odom_ft) - min(odom_ft) as feet, max(sec_past_st) - min(sec_past_st) as secs
  from sf group by all)
select {SEGK}, feet, secs, round(secs - feet / (case when f0 > 0 then f0 end), 6) as t_stop2_short from m""")
def short_segment_tstop2(spark, sf_dir):
    """Time on a segment against its distance at the speed of entry."""
    p = V.pings(spark, sf_dir)
    return r6(decompose.short_segment_tstop2(p, V.segment_rows(p)).select(*decompose.SEG, "feet", "secs", "t_stop2_short"))


# Dwell

@query(f"""with {PINGS}, {SEGMENTS}, n as (select *, lead(sec_past_st) over (partition by {SEGK} order by index_loc) as nx from pin)
select {SEGK}, arg_min(struct_pack(a := sec_past_st, b := nx), index_loc).b - min(sec_past_st) as dwell_secs
  from n where door_state = 'O' group by all""")
def dwell_first_open(spark, sf_dir):
    """Dwell of the first opening on each segment."""
    p = V.pings(spark, sf_dir)
    return dwell.dwell_first_open(decompose.filter_to_segment(p, V.segment_rows(p)))


@query(f"""with {PINGS}, {SEGMENTS}, c as (select *, case when lag(door_state) over w is null or door_state <> lag(door_state) over w then 1 else 0 end as ch, lead(sec_past_st) over w as nx
  from pin window w as (partition by {SEGK} order by index_loc)),
d as (select *, sum(ch) over (partition by {SEGK} order by index_loc rows unbounded preceding) as door_id from c),
s as (select {SEGK}, door_id, min(sec_past_st) as a, max(coalesce(nx, sec_past_st)) as b, max(odom_ft) - min(odom_ft) as moved
  from d where door_state = 'O' group by all)
select {SEGK}, cast(sum(b - a) as bigint) as dwell_secs, count(*) as n_spells from s where moved < 30 group by all""")
def dwell_first_to_last(spark, sf_dir):
    """Dwell of all openings at one place."""
    p = V.pings(spark, sf_dir)
    return dwell.dwell_first_to_last(decompose.filter_to_segment(p, V.segment_rows(p)))


@query(f"""with {PINGS}, t as (select *, lead(sec_past_st) over (partition by {RK} order by index_loc) - sec_past_st as s from p),
g as (select {RK}, stop_window, door_state, cast(sum(s) as bigint) as secs, max(s) as most
  from t where stop_window is not null and stop_window not in ('E00')
  group by all)
select * from g where secs <= (select ceil(quantile_cont(secs, 0.95)) from g)""")
def stop_window_dwell(spark, sf_dir):
    """Seconds in stop windows, the longest left out."""
    return dwell.stop_window_dwell(V.pings(spark, sf_dir), ("E00",)).select("filename", "index_run_start", "stop_window", "door_state", F.col("secs").cast("long").alias("secs"), "most")


DOORS = f"""dc as (select *, case when lag(door_state) over w is null or door_state <> lag(door_state) over w then 1 else 0 end as ch
  from {{src}} window w as (partition by {{keys}} order by index_loc)),
dn as (select {{keys}}, cast(sum(ch) as bigint) as most from dc group by all)"""


@query(f"with {PINGS}, " + DOORS.format(src="p", keys=RK) + f" select {RK}, most, round((most - 1) / 2.0::double, 6) as openings from dn")
def door_openings(spark, sf_dir):
    """Openings of each run."""
    return r6(dwell.door_openings(V.pings(spark, sf_dir)))


@query(f"with {PINGS}, {SEGMENTS}, " + DOORS.format(src="pin", keys=SEGK) + " select seg_name_id, count(*) as n, round(count(*) filter (most = 1) / count(*)::double, 6) as share from dn group by all")
def no_opening_share(spark, sf_dir):
    """Share of runs on each segment without a change of the door's state."""
    p = V.pings(spark, sf_dir)
    return r6(dwell.no_opening_share(decompose.filter_to_segment(p, V.segment_rows(p))))


@query(PHASED + f", s as (select {SEGK}, phase, sum(secs_marg) as secs from ph where any_open group by all) select seg_name_id, phase, round(avg(secs), 6) as mean_secs, count(*) as n from s group by all")
def mean_phase_seconds(spark, sf_dir):
    """Mean seconds of each phase over served runs."""
    return r6(dwell.mean_phase_seconds(phased(spark, sf_dir)[2]))


# Log lines

@query(f"""with {LINES}, f as (select distinct filename, user_id from ln)
select f.filename, f.user_id as file_busid, line_num, lead(line_num) over (partition by f.filename
  order by line_num) as line_num_next, route, pattern, tag_busid, tag_time, cast(hour(ts) as bigint) as tag_starthour, dayname(ts) as wday
from f left join tg using (filename)""")
def tag_inventory(spark, sf_dir):
    """Tags of log files, parsed."""
    out = runs.tag_inventory(V.log_lines(spark, sf_dir))
    return r6(out.select("filename", "file_busid", "line_num", "line_num_next", "route", "pattern", "tag_busid", "tag_time", "tag_starthour", "wday"))


@query(f"with {LINES} select filename, index_run_start, index_run_end, run_end_time from bd")
def run_bounds(spark, sf_dir):
    """Where each run begins and ends."""
    lines = V.log_lines(spark, sf_dir)
    return runs.run_bounds(lines)


RUN_SUM = f"""with {LINES}, rs as (select b.*, (select min(index_loc) from pg
  where pg.filename = b.filename and pg.index_loc >= b.index_run_start) as s, (select max(index_loc)
  from pg where pg.filename = b.filename and pg.index_loc <= b.index_run_end) as e
  from bd b),
rk as (select * from rs qualify row_number() over (partition by filename, s order by index_run_start desc) = 1),
rr as (select r.filename, r.index_run_start as index_run_start_original, r.s as index_run_start, r.e as index_run_end, a.odom_ft as o0, b.odom_ft as o1, a.sec_past_st as s0, b.sec_past_st as s1, a.lat as lat0, a.long as long0, b.lat as lat1, b.long as long1,
  epoch(try_strptime(strftime(r.ts, '%m/%d/%y') || ' ' || run_end_time, '%m/%d/%y %H:%M:%S')) - epoch(date_trunc('second', r.ts)) as tagdur
  from rk r left join pg a on a.filename = r.filename and a.index_loc = r.s left join pg b on b.filename = r.filename and b.index_loc = r.e)
"""


@query(RUN_SUM + f"""select filename, index_run_start_original, index_run_start, index_run_end, s1 - s0 as run_duration_from_sec, cast(tagdur as bigint) as run_duration_from_tags, round((o1 - o0) / 5280.0::double, 6) as dist_odom_mi,
round(case when s1 - s0 <> 0 then (o1 - o0) / 5280.0::double * 3600 / (s1 - s0) end, 6) as mph_odom,
round({V.sql_distance(V.sql_albers('long0', 'lat0'), V.sql_albers('long1', 'lat1'))} * 0.000621371, 6) as dist_crow_fly_mi from rr""")
def run_summary(spark, sf_dir):
    """Summary of each run parsed from log lines."""
    lines = V.log_lines(spark, sf_dir)
    out = runs.clean_pings(lines)[1]
    finite = F.when(F.abs("mph_odom") < float("inf"), F.col("mph_odom")).alias("mph_odom")
    return r6(out.select("filename", "index_run_start_original", "index_run_start", "index_run_end", "run_duration_from_sec", "run_duration_from_tags", "dist_odom_mi", finite, "dist_crow_fly_mi"))


@query(RUN_SUM + """, rv as (select * from rr where index_run_start <= index_run_end)
select pg.filename, pg.index_loc, pg.odom_ft, max(case when pg.index_loc between rv.index_run_start and rv.index_run_end then rv.index_run_start end) as index_run_start
  from pg left join rv on rv.filename = pg.filename and pg.index_loc between rv.index_run_start and rv.index_run_end
  group by all""")
def run_dividers(spark, sf_dir):
    """Pings with the run they lie in."""
    lines = V.log_lines(spark, sf_dir)
    return runs.clean_pings(lines)[0].select("filename", "index_loc", "odom_ft", "index_run_start")


@query(f"with {LINES} select filename, index_loc, odom_ft, sec_past_st, round(lat, 6) as lat, round(long, 6) as long from pg")
def valid_pings(spark, sf_dir):
    """Pings that pass the checks of their fields."""
    lines = V.log_lines(spark, sf_dir)
    return r6(runs.ping_lines(lines).select("filename", "index_loc", "odom_ft", "sec_past_st", "lat", "long"))


@query(f"""with {LINES}, k as (select filename, index_loc, line_num, case when event_type = 'purchase' then 'apc' when event_type in ('view', 'click') and event_id * 7 % 400 <= 360 then 'ping' end as kind
  from lp where index_loc >= -1)
select filename, index_loc, coalesce(nx = 'apc', false) as row_before_apc
  from (select *, lead(kind) over (partition by filename order by line_num) as nx
  from k where kind is not null) where kind = 'ping'""")
def apc_flags(spark, sf_dir):
    """Pings before a passenger count."""
    lines = V.log_lines(spark, sf_dir)
    return runs.ping_lines(lines).select("filename", "index_loc", "row_before_apc")


@query(f"""with {LINES}, f as (select distinct filename, user_id from ln) select f.filename, count(line_num) as n_tags, count(line_num) = 0 as is_empty, coalesce(bool_or(f.user_id <> tag_busid), false) as is_mislabelled
  from f left join tg using (filename) group by all""")
def file_quality(spark, sf_dir):
    """Files without tags, or with tags of another bus."""
    return runs.file_quality(runs.tag_inventory(V.log_lines(spark, sf_dir)))


@query(f"""with {LINES} select kind, count(*) as n from (select case event_type when 'signup' then 'run' when 'error' then 'message' when 'purchase' then 'apc' else 'reading' end as kind
  from ln) group by all""")
def legacy_line_kinds(spark, sf_dir):
    """Kinds of log lines, counted."""
    return legacy.line_kinds(V.log_lines(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {LINES}, r as (select *, max(case when event_type = 'signup' then line_num end) over (partition by filename
  order by line_num) as run_line from ln),
g as (select filename, run_line, line_num, line_num * 10 as odom_ft from r where event_type in ('view', 'click') and run_line is not null)
select filename, run_line, count(*) as n_readings, arg_max(odom_ft, line_num) as last_odom_ft
  from g group by all having arg_max(odom_ft, line_num) <> 0""")
def legacy_finished_runs(spark, sf_dir):
    """Readings of the older loader by run."""
    readings = legacy.legacy_readings(V.log_lines(spark, sf_dir))[1]
    return legacy.finished_runs(readings, ("filename", "run_line")).select("filename", "run_line", "n_readings", "last_odom_ft")


@query(f"""with {LINES}, r as (select filename, line_num, user_id + case when event_id % 11 = 0 then 1 else 0 end as bus_id, 'A' || (user_id % 10) || '0' || (user_id % 2) as rp, cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as bigint) as t
  from ln where event_type = 'signup'),
b as (select *, case when lag(t) over w is null or t - lag(t) over w >= 86000 / 10 then 1 else 0 end as nw
  from r window w as (partition by bus_id, rp order by t, line_num))
select bus_id, rp as route_pattern, t as start_seconds, cast(sum(nw) over (partition by bus_id, rp
  order by t, line_num rows unbounded preceding) as bigint) as session
  from b""")
def legacy_run_merge(spark, sf_dir):
    """Repeated runs of a bus merged into sessions."""
    inventory = runs.tag_inventory(V.log_lines(spark, sf_dir)).where("line_num is not null")
    seconds = values.seconds_past_midnight(F.col("tag_datetime")).cast("long")
    rows = inventory.select(F.col("tag_busid").alias("bus_id"), F.trim("route_pattern").alias("route_pattern"), F.lit("all").alias("run_date"), seconds.alias("start_seconds"), F.col("line_num").alias("run_id"))
    return legacy.merge_repeated_runs(rows, 8600).select("bus_id", "route_pattern", "start_seconds", "session")


@query(f"""with {PINGS}, v as (select *, event_id * 37 % 500 as counter
  from p),
l as (select *, lag(counter) over (partition by {RK} order by index_loc) as b
  from v)
select filename, index_loc, cast(sum(case when counter < b then b else 0 end) over (partition by {RK}
  order by index_loc rows unbounded preceding) as bigint) as reset_offset
  from l""")
def reset_offsets(spark, sf_dir):
    """Offsets of a counter that falls back."""
    p = V.pings(spark, sf_dir).withColumn("counter", F.col("event_id") * 37 % 500)
    return p.select("filename", "index_loc", windows.reset_offset(F.col("counter")).alias("reset_offset"))


# Stops and segments

NEAR = f"""{PINGS}, {SUPPLIERS}, jn as (select {RK}, index_loc, odom_ft, sec_past_st, p.route, p.pattern, su.stop_id, su.stop_sort_order, sqrt((p.x - su.x) * (p.x - su.x) + (p.y - su.y) * (p.y - su.y)) as d
  from p join su on p.route = su.route and p.pattern = su.pattern),
nr as (select * from jn qualify row_number() over (partition by {RK}, stop_id order by d, index_loc) = 1)"""
MOST = 2500.0
CLEAN = f"""{NEAR}, cl as (select * from (select *, max(index_loc) over (partition by {RK} order by stop_sort_order, stop_id rows between unbounded preceding and 1 preceding) as m from nr where d < {MOST}) where m is null or index_loc >= m)"""


def _index(spark, sf_dir):
    p = V.pings(spark, sf_dir)
    s = V.suppliers(spark, sf_dir)
    return p, s, stops.stop_index(p, s, MOST)


@query(f"with {NEAR} select {RK}, stop_id, index_loc, round(d, 6) as dist_to_nearest_point from nr")
def nearest_stops(spark, sf_dir):
    """The ping nearest to each stop of a run's pattern."""
    near = nearest.nearest_ping(V.suppliers(spark, sf_dir), V.pings(spark, sf_dir), ["stop_id", "stop_sort_order"], digits=6, single=True)
    return near.select("filename", "index_run_start", "stop_id", "index_loc", "dist_to_nearest_point")


@query(f"with {CLEAN} select {RK}, stop_id, index_loc from cl")
def stop_order_cleanup(spark, sf_dir):
    """Stops near enough, in the order of the run."""
    return _index(spark, sf_dir)[2].select("filename", "index_run_start", "stop_id", "index_loc")


@query(f"""with {CLEAN}, b as (select {RK}, min(index_loc) as lo, max(index_loc) as hi from cl group by all)
select {RK}, min(odom_ft) as start_odom_ft, max(odom_ft) as end_odom_ft, max(odom_ft) - min(odom_ft) as trip_dist_ft, max(sec_past_st) - min(sec_past_st) as trip_dur_sec, round(arg_min(lat, index_loc), 6) as start_lat, round(arg_max(long, index_loc), 6) as end_long
from p join b using ({RK}) where index_loc between lo and hi group by all""")
def stop_summary(spark, sf_dir):
    """Runs between their first and last stop."""
    p, _, index = _index(spark, sf_dir)
    return r6(stops.stop_summary(p, index).select("filename", "index_run_start", "start_odom_ft", "end_odom_ft", "trip_dist_ft", "trip_dur_sec", "start_lat", "end_long"))


@query(f"""with {CLEAN}, f as (select {RK}, count(*) as n from cl group by all), s as (select route, pattern, count(*) as n from su group by all)
select {RK}, coalesce(f.n, 0) as n_found, s.n as n_scheduled, s.n - coalesce(f.n, 0) as n_missing
  from (select distinct {RK}, route, pattern from p) r join s using (route, pattern)
  left join f using ({RK})""")
def missing_stops(spark, sf_dir):
    """Stops found and scheduled."""
    p, s, index = _index(spark, sf_dir)
    out = stops.missing_stops(index, p.select("filename", "index_run_start", "route", "pattern").distinct(), s)
    return out.select("filename", "index_run_start", "n_found", "n_scheduled", "n_missing")


@query(f"""with {CLEAN}, w as (select *, min(index_loc) over (partition by {RK}) as lo, max(index_loc) over (partition by {RK}) as hi from cl)
select a.filename, a.index_run_start, a.index_loc as index_loc_first_stop, b.index_loc as index_loc_last_stop, round(a.d, 6) as first_stop_dist_nearest_point
  from (select * from w where index_loc = lo) a join (select *
  from w where index_loc = hi) b using ({RK})""")
def first_last_stops(spark, sf_dir):
    """First and last stops of each run, ties kept."""
    out = stops.first_last_stop(_index(spark, sf_dir)[2])
    return r6(out.select("filename", "index_run_start", "index_loc_first_stop", "index_loc_last_stop", "first_stop_dist_nearest_point"))


@query(f"""with {NEAR} select {RK}, stop_id, index_loc, b as index_loc_before
  from (select *, lag(index_loc) over (partition by {RK} order by stop_sort_order, stop_id) as b
  from nr where d < {MOST}) where index_loc < b""")
def order_violations(spark, sf_dir):
    """Stops that fall behind the one before."""
    return stops.nearest_violations(V.pings(spark, sf_dir), V.suppliers(spark, sf_dir), MOST).select("filename", "index_run_start", "stop_id", "index_loc", "index_loc_before")


_XY, _PXY = V.sql_lcc("stop_lon", "stop_lat"), V.sql_lcc("long", "lat")
FAR, LONG = 5000.0, 100_000.0
ENDS = f"""{PINGS}, {SUPPLIERS},
pf as (select p.* exclude (x, y), {_PXY[0]} as x, {_PXY[1]} as y from p),
sv as (select stop_id, stop_id // {V.LINE_POINTS} as line, {_XY[0]} as x, {_XY[1]} as y from su),
ed as (select line, x - lag(x) over w as dx, y - lag(y) over w as dy from sv window w as (partition by line order by stop_id)),
le as (select 'line' || line as seg_name_id, coalesce(sum(sqrt(dx * dx + dy * dy)), 0) as length_ft from ed group by line),
en as (select 'line' || line as seg_name_id, line % 3 as route, line % 2 as pattern, location, x, y from
  (select line, 'first' as location, arg_min(x, stop_id) as x, arg_min(y, stop_id) as y from sv group by line union all
   select line, 'last', arg_max(x, stop_id), arg_max(y, stop_id) from sv group by line)),
sj as (select {RK}, index_loc, seg_name_id, location, sqrt((pf.x - en.x) * (pf.x - en.x) + (pf.y - en.y) * (pf.y - en.y)) as d
  from pf join en using (route, pattern)),
sn as (select * from sj qualify row_number() over (partition by {RK}, seg_name_id, location order by d, index_loc) = 1),
si as (select *, d > {FAR} as flag_too_far, coalesce(index_loc - lag(index_loc) over (partition by {SEGK}
  order by location), 0) < 0 as flag_wrong_order from sn)"""


def _lines(spark, sf_dir):
    """Lines of suppliers as segments, pings with their places projected to feet, and the lines' patterns."""
    lines = V.lines_of_suppliers(spark, sf_dir)
    k = F.substring("seg_name_id", 5, 20).cast("long")
    patterns = lines.select((k % 3).alias("route"), (k % 2).alias("pattern"), "seg_name_id")
    x, y = geo.lcc_feet(F.col("long"), F.col("lat"))
    return lines, V.pings(spark, sf_dir).withColumns({"x": x, "y": y}), patterns


@query(f"with {ENDS} select {SEGK}, location, index_loc, round(d, 6) as dist_to_nearest_point, flag_too_far, flag_wrong_order from si")
def segment_index(spark, sf_dir):
    """The ping nearest to each segment end, with flags."""
    lines, p, patterns = _lines(spark, sf_dir)
    index = segments.segment_index(p, segments.segment_ends(lines), patterns, FAR, digits=6, single=True)
    return index.select(*segments.KEYS, "location", "index_loc", "dist_to_nearest_point", "flag_too_far", "flag_wrong_order")


SEG_SUM = f"""with {ENDS}, sb as (select {SEGK}, min(index_loc) as lo, max(index_loc) as hi, arg_min(d, row(index_loc, d)) as d0
  from si group by all),
fl as (select {RK}, bool_or(flag_too_far) as flag_too_far_any, bool_or(flag_wrong_order) as flag_wrong_order_any from si group by all),
sp as (select {SEGK}, d0, pf.* exclude ({RK}), lead(odom_ft) over w < odom_ft or lead(sec_past_st) over w < sec_past_st as fell
  from pf join sb using ({RK}) where index_loc between lo and hi window w as (partition by {SEGK} order by index_loc)),
ss as (select {SEGK}, d0, min(odom_ft) as o0, max(odom_ft) as o1, min(sec_past_st) as s0, max(sec_past_st) as s1, min(index_loc) as i0, max(index_loc) as i1,
  arg_min(lat, index_loc) as la0, arg_max(lat, index_loc) as la1, arg_min(long, index_loc) as lo0, arg_max(long, index_loc) as lo1, coalesce(bool_or(fell), false) as fell from sp group by all),
sx as (select ss.*, fl.flag_too_far_any, fl.flag_wrong_order_any, abs(length_ft - (o1 - o0)) > {LONG} as flag_too_long_odom
  from ss left join fl using ({RK}) left join le using (seg_name_id))
"""
#: Columns of the summary and their SQL.
_SUM = {
    "start_odom_ft_segment": "o0", "end_odom_ft_segment": "o1", "start_sec_segment": "s0", "end_sec_segment": "s1", "trip_dur_sec_segment": "s1 - s0",
    "start_index_loc_segment": "i0", "end_index_loc_segment": "i1", "start_lat_segment": "la0::double", "end_lat_segment": "la1::double",
    "start_long_segment": "lo0::double", "end_long_segment": "lo1::double", "dist_first_stop_segment": "round_even(d0, 2)",
    "trip_dist_mi_odom_and_segment": "round_even((o1 - o0) / 5280.0::double, 2)",
    "trip_speed_mph_segment": "round_even(case when s1 <> s0 then (o1 - o0) / 5280.0::double * 3600 / (s1 - s0) end, 2)",
    "flag_too_far_any": "flag_too_far_any", "flag_wrong_order_any": "flag_wrong_order_any", "flag_too_long_odom": "flag_too_long_odom",
    "flag_secs_total_mismatch": "false", "flag_odom_total_mismatch": "false", "flag_counter_reset": "fell",
}


def _seg_summary(spark, sf_dir, kept=None):
    lines, p, patterns = _lines(spark, sf_dir)
    return segments.run_segments(p, segments.segment_ends(lines), patterns, segments.segment_lengths(lines), FAR, LONG, kept=kept)


@query(SEG_SUM + f"select {SEGK}, {', '.join(f'{v} as {k}' for k, v in _SUM.items())} from sx")
def segment_summary(spark, sf_dir):
    """Runs on segments between nearest pings, with flags."""
    return _seg_summary(spark, sf_dir).select(*segments.KEYS, *_SUM)


@query(SEG_SUM + f"select {SEGK} from sx where not (coalesce(flag_too_far_any, false) or coalesce(flag_wrong_order_any, false) or coalesce(flag_too_long_odom, false))")
def segment_quality(spark, sf_dir):
    """Runs on segments without any flag."""
    return _seg_summary(spark, sf_dir, segments.quality()).select(*segments.KEYS)


@query(f"""with {ENDS}, pl as (select line, list(x order by stop_id) as xs, list(y
  order by stop_id) as ys, any_value(line % 3) as route, any_value(line % 2) as pattern
  from sv group by line),
eg as (select line, route, pattern, unnest(range(1, len(xs))) as i, xs, ys
  from pl),
e as (select line, route, pattern, xs[i] as ax, ys[i] as ay, xs[i + 1] - xs[i] as dx, ys[i + 1] - ys[i] as dy
  from eg),
pr as (select filename, index_loc, line, pf.x, pf.y, ax, ay, dx, dy, greatest(0, least(1, case when dx * dx + dy * dy > 0 then ((pf.x - ax) * dx + (pf.y - ay) * dy) / (dx * dx + dy * dy) else 0 end)) as t
  from pf join e using (route, pattern))
select filename, index_loc, 'line' || line as seg_name_id from pr
  group by all having min(sqrt((x - ax - dx * t) * (x - ax - dx * t) + (y - ay - dy * t) * (y - ay - dy * t))) <= 500""")
def corridor_pings(spark, sf_dir):
    """Pings in the corridor of a segment of their pattern, 500 feet to each side."""
    lines, p, _ = _lines(spark, sf_dir)
    k = F.substring("seg_name_id", 5, 20).cast("long")
    own = lines.select("seg_name_id", geo.project_line(F.col("coords")).alias("points"), (k % 3).alias("route"), (k % 2).alias("pattern"))
    return nearest.within_corridor(p, own, ["seg_name_id"], 500.0, on=["route", "pattern"]).select("filename", "index_loc", "seg_name_id")


@query(f"""with {PINGS} select {RK}, count(*) as n_points, round(sum(sqrt(dx * dx + dy * dy)), 3) as length_ft
  from (select {RK}, {_PXY[0]} - lag({_PXY[0]}) over w as dx, {_PXY[1]} - lag({_PXY[1]}) over w as dy
  from p window w as (partition by {RK} order by index_loc))
  group by all having count(*) > 1""")
def run_traces(spark, sf_dir):
    """Each run's pings as a line, and its length."""
    lines = geo.polylines(V.pings(spark, sf_dir), ["filename", "index_run_start"], "index_loc", "long", "lat").where(F.size("coords") > 1)
    length = F.round(geo.line_length(geo.project_line(F.col("coords"))), 3)
    return lines.select("filename", "index_run_start", F.size("coords").cast("long").alias("n_points"), length.alias("length_ft"))


_BRG = "degrees(atan2(sin(radians({2} - {0})) * cos(radians({3})), cos(radians({1})) * sin(radians({3})) - sin(radians({1})) * cos(radians({3})) * cos(radians({2} - {0}))))"
_HAV = "(2 * 20898071.0::double * asin(sqrt(least(1.0::double, pow(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2)))))"


@query(f"""with {PINGS}, {SEGMENTS}, tb as (select *, {_BRG.format('-77.00003', '38.95004', '-76.98', '38.96')} as towards, {_BRG.format('-77.00003', '38.95004', 'long', 'lat')} as b, {_HAV.format('-77.00003', '38.95004', 'long', 'lat')} as d
  from pin),
tf as (select *, case when least(abs(b - towards), 360 - abs(b - towards)) > 90 and d > 0 then -d else d end as feet from tb),
tc as (select *, min(row(abs(feet), index_loc, sec_past_st)) over (partition by {SEGK}) as c from tf)
select {SEGK}, index_loc, round(feet, 3) as feet_from_start, sec_past_st - c[3] as secs_from_start from tc where c[1] <= 4000""")
def signed_trajectories(spark, sf_dir):
    """Pings of segments by signed distance and time from one start."""
    p = V.pings(spark, sf_dir)
    s = V.segment_rows(p)
    starts = s.select("seg_name_id").distinct().withColumns({"start_lon": F.lit(-77.00003), "start_lat": F.lit(38.95004), "end_lon": F.lit(-76.98), "end_lat": F.lit(38.96)})
    out = quality.trajectories(decompose.filter_to_segment(p, s), starts, 4000.0)
    return out.select(*segments.KEYS, "index_loc", F.round("feet_from_start", 3).alias("feet_from_start"), "secs_from_start")


X1, Y1 = V.sql_lcc("stop_lon", "stop_lat")


@query(f"""with {SUPPLIERS} select stop_id, round({X1}, 4) as x_ft, round({Y1}, 4) as y_ft, round({V.sql_albers('stop_lon', 'stop_lat')[0]}, 4) as x_m, round({V.sql_albers('stop_lon', 'stop_lat')[1]}, 4) as y_m
  from su""")
def projected_coordinates(spark, sf_dir):
    """Stops in both projections."""
    s = V.suppliers(spark, sf_dir)
    (x, y), (u, v) = geo.lcc_feet(F.col("stop_lon"), F.col("stop_lat")), geo.albers_metres(F.col("stop_lon"), F.col("stop_lat"))
    return s.select("stop_id", *(F.round(c, 4).alias(n) for c, n in ((x, "x_ft"), (y, "y_ft"), (u, "x_m"), (v, "y_m"))))


@query(f"""with {PINGS}, l as (select *, lag(long) over w as lo, lag(lat) over w as la
  from p window w as (partition by {RK} order by index_loc)) select filename, index_loc, round({V.sql_distance(V.sql_albers('lo', 'la'), V.sql_albers('long', 'lat'))} * 0.000621371, 6) as crow_fly_mi
  from l where lo is not null""")
def crow_fly_miles(spark, sf_dir):
    """Straight distance to the ping before."""
    w = windows.over()
    p = V.pings(spark, sf_dir).withColumns({"lo": F.lag("long").over(w), "la": F.lag("lat").over(w)}).where("lo is not null")
    return r6(p.select("filename", "index_loc", (geo.planar_metres(F.col("lo"), F.col("la"), F.col("long"), F.col("lat")) * values.MILES_A_METRE).alias("crow_fly_mi")))


@query(f"""with {PINGS}, l as (select *, lag(long) over w as lo, lag(lat) over w as la
  from p window w as (partition by {RK} order by index_loc)) select filename, index_loc,
round(2 * 20898071.0::double * asin(sqrt(least(1.0::double, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(long - lo) / 2), 2)))), 3) as feet from l where lo is not null""")
def haversine_feet(spark, sf_dir):
    """Great-circle distance to the ping before."""
    w = windows.over()
    p = V.pings(spark, sf_dir).withColumns({"lo": F.lag("long").over(w), "la": F.lag("lat").over(w)}).where("lo is not null")
    return p.select("filename", "index_loc", F.round(geo.haversine_feet(F.col("lo"), F.col("la"), F.col("long"), F.col("lat")), 3).alias("feet"))


@query(f"""with {SUPPLIERS}, q as (select 'line' || (stop_id // {V.LINE_POINTS}) as seg_name_id, stop_id, {X1} as px, {Y1} as py from su),
l as (select *, lag(px) over w as lx, lag(py) over w as ly from q
  window w as (partition by seg_name_id order by stop_id)) select seg_name_id, round(coalesce(sum(sqrt((px - lx) * (px - lx) + (py - ly) * (py - ly))), 0), 3) as length_ft
  from l group by all""")
def segment_lengths(spark, sf_dir):
    """Lengths of lines."""
    return segments.segment_lengths(V.lines_of_suppliers(spark, sf_dir)).select("seg_name_id", F.round("length_ft", 3).alias("length_ft"))


@query(f"""with {SUPPLIERS}, q as (select 'line' || (stop_id // {V.LINE_POINTS}) as seg_name_id, stop_id, {X1} as px, {Y1} as py from su)
select seg_name_id, 'first' as location, round(arg_min(px, stop_id), 3) as x, round(arg_min(py, stop_id), 3) as y
  from q group by all union all select seg_name_id, 'last', round(arg_max(px, stop_id), 3), round(arg_max(py, stop_id), 3)
  from q group by all""")
def segment_ends(spark, sf_dir):
    """First and last vertices of lines."""
    return segments.segment_ends(V.lines_of_suppliers(spark, sf_dir)).select("seg_name_id", "location", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"""with {PINGS}, {SUPPLIERS} select filename, index_loc, stop_id, round(sqrt((p.x - su.x) * (p.x - su.x) + (p.y - su.y) * (p.y - su.y)), 6) as dist
  from p, su where sqrt((p.x - su.x) * (p.x - su.x) + (p.y - su.y) * (p.y - su.y)) <= 400""")
def intersections_within_distance(spark, sf_dir):
    """Pings near a place, by grid cells."""
    targets = V.suppliers(spark, sf_dir).select("stop_id", "x", "y")
    near = r6(nearest.place_cells(V.pings(spark, sf_dir), targets, 400.0).select("filename", "index_loc", F.struct("_x", "_y").alias("_p"), "dist"))
    return nearest.at_places(near.select("filename", "index_loc", "_p.*", "dist"), targets).select("filename", "index_loc", "stop_id", "dist")


@query(f"""with {PINGS}, {SUPPLIERS}, j as (select {RK}, index_loc, stop_id, sqrt((p.x - su.x) * (p.x - su.x) + (p.y - su.y) * (p.y - su.y)) as d
  from p, su where sqrt((p.x - su.x) * (p.x - su.x) + (p.y - su.y) * (p.y - su.y)) <= 800) select {RK}, stop_id, index_loc, round(d, 6) as dist
  from j qualify row_number() over (partition by {RK}, stop_id
  order by d, index_loc) = 1""")
def nearest_intersection_pings(spark, sf_dir):
    """The closest ping of a run to each place within a radius."""
    targets = V.suppliers(spark, sf_dir).select("stop_id", "x", "y")
    return nearest.nearest_within(V.pings(spark, sf_dir), targets, ["stop_id"], 800.0, digits=6).select("filename", "index_run_start", "stop_id", "index_loc", "dist")


# Keys, sets, samples

@query("""select l_orderkey, l_linenumber, l_partkey, round(l_quantity, 6) as l_quantity
  from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber
  order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) = 1""")
def keep_last_runs(spark, sf_dir):
    """The last row of each key."""
    out = windows.keep_last(V.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return r6(out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity"))


@query("""select l_orderkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber
  from lineitem qualify row_number() over (partition by l_orderkey
  order by l_linenumber, l_suppkey, l_partkey) = 1""")
def keep_first_messages(spark, sf_dir):
    """The first row of each key."""
    out = windows.keep_one(V.table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_partkey"])
    return out.select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query(f"""with {PINGS}, a as (select filename, index_loc, index_loc as at
  from p where kind = 'signup'),
e as (select filename, index_loc from p where kind = 'error') select e.filename, e.index_loc, a.at as tag_index
  from e asof left join a on e.filename = a.filename and e.index_loc >= a.index_loc""")
def asof_backward(spark, sf_dir):
    """The latest tag at or before each end message."""
    p = V.pings(spark, sf_dir)
    left, right = p.where("kind = 'error'").select("filename", "index_loc"), p.where("kind = 'signup'").select("filename", "index_loc")
    return windows.asof(left, right, "index_loc", ["filename"]).select("filename", "index_loc", F.col("index_loc_asof").alias("tag_index"))


@query(f"""with {PINGS}, a as (select filename, index_loc, index_loc as at
  from p where kind = 'view'),
e as (select filename, index_loc from p where kind = 'signup') select e.filename, e.index_loc, a.at as ping_index
  from e asof left join a on e.filename = a.filename and e.index_loc <= a.index_loc""")
def asof_forward(spark, sf_dir):
    """The first ping at or after each tag."""
    p = V.pings(spark, sf_dir)
    left, right = p.where("kind = 'signup'").select("filename", "index_loc"), p.where("kind = 'view'").select("filename", "index_loc")
    return windows.asof(left, right, "index_loc", ["filename"], forward=True).select("filename", "index_loc", F.col("index_loc_asof").alias("ping_index"))


@query(f"with {PINGS}, {SEGMENTS} select filename, index_run_start, seg_name_id, index_loc from pin")
def filter_to_segment(spark, sf_dir):
    """Pings on segments."""
    p = V.pings(spark, sf_dir)
    return decompose.filter_to_segment(p, V.segment_rows(p)).select("filename", "index_run_start", "seg_name_id", "index_loc")


RUNS = f"""rn as (select {RK}, route, pattern, max(sec_past_st) - min(sec_past_st) as secs, max(odom_ft) - min(odom_ft) as feet, count(*) as n, min(sec_past_st) as start_secs, min(hour) as hour, min(wday) as wday
  from p group by {RK}, route, pattern)"""


def run_rows(p: DataFrame) -> DataFrame:
    return p.groupBy("filename", "index_run_start", "route", "pattern").agg(
        values.spread(F.col("sec_past_st")).alias("secs"), values.spread(F.col("odom_ft")).alias("feet"), F.count(F.lit(1)).alias("n"), F.min("sec_past_st").alias("start_secs"), F.min("hour").alias("hour"), F.min("wday").alias("wday")
    )


@query(f"""with {PINGS}, {RUNS} select {RK}, secs, feet from rn where not (coalesce(secs < 900000, false) or coalesce(feet / 5280.0::double < 0.1, false))""")
def long_enough_runs(spark, sf_dir):
    """Runs not known to be short."""
    r = run_rows(V.pings(spark, sf_dir)).withColumns({"run_duration_from_sec": F.col("secs"), "dist_odom_mi": F.col("feet") / 5280.0})
    return runs.long_enough(r, 900_000, 0.1).select("filename", "index_run_start", "secs", "feet")


@query(f"with {PINGS} select filename, index_loc from p qualify bool_or(coalesce(stop_window = 'E05', false)) over (partition by {RK})")
def groups_with_window(spark, sf_dir):
    """All pings of runs that pass a stop window."""
    return windows.groups_where(V.pings(spark, sf_dir), F.col("stop_window") == "E05", ["filename", "index_run_start"]).select("filename", "index_loc")


@query(f"with {PINGS} select filename, index_loc from p where filename in (select filename from p where route = 1)")
def route_file_filter(spark, sf_dir):
    """All rows of files that serve a route."""
    return runs.analysis_files(V.pings(spark, sf_dir), [1]).select("filename", "index_loc")


@query(f"""with {PINGS}, {SUPPLIERS} select distinct route, pattern from p
  where not exists (select 1 from su where su.route = p.route and su.pattern = p.pattern and su.stop_id < 4)""")
def missing_patterns(spark, sf_dir):
    """Patterns without scheduled stops."""
    s = V.suppliers(spark, sf_dir).where("stop_id < 4")
    return fieldcheck.exclude(V.pings(spark, sf_dir).select("route", "pattern").distinct(), s, ["route", "pattern"])


@query(f"""with {PINGS}, a as (select distinct {RK} from p where kind = 'view'),
b as (select distinct {RK} from p where kind = 'error') select *, 'left' as only_in
  from (select * from a except select * from b) union all select *, 'right'
  from (select * from b except select * from a)""")
def run_set_differences(spark, sf_dir):
    """Runs that only one of two tables has."""
    p = V.pings(spark, sf_dir)
    return fieldcheck.same_keys(p.where("kind = 'view'"), p.where("kind = 'error'"))


@query(f"""with {PINGS}, r as (select distinct {RK} from p),
k as (select {RK} from r order by md5(filename || '|' || index_run_start || '|0'), {RK} limit 10)
select {RK}, index_loc from p semi join k using ({RK})""")
def hash_sample_runs(spark, sf_dir):
    """A repeatable sample of ten runs."""
    return windows.hash_sample(V.pings(spark, sf_dir), ["filename", "index_run_start"], 10).select("filename", "index_run_start", "index_loc")


@query(f"with {PINGS}, {RUNS} select {RK}, secs from rn order by secs desc, filename, index_run_start limit 10")
def longest_runs(spark, sf_dir):
    """The ten longest runs."""
    return quality.top_rows(run_rows(V.pings(spark, sf_dir)), "secs", 10, "filename", "index_run_start").select("filename", "index_run_start", "secs")


# Schedule and GTFS

@query("""select o_orderkey as pattern_id, o_custkey as route, l_linenumber::bigint as stop_order, l_suppkey as geo_id, s_name as geo_description
  from orders left join lineitem on l_orderkey = o_orderkey left
  join supplier on s_suppkey = l_suppkey""")
def schedule_star(spark, sf_dir):
    """Patterns with their stops and places."""
    pattern = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Pattern_ID"), F.col("o_custkey").cast("string").alias("Route"), F.lit(1).alias("Pattern"))
    detail = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("Pattern_ID"), F.col("l_linenumber").cast("long").alias("Stop Order"), F.col("l_suppkey").alias("Geo_ID"))
    stop = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("Geo_ID"), F.col("s_name").alias("Geo_Description"))
    out = stops.schedule_star(pattern, detail, stop)
    return out.select("pattern_id", F.col("route").cast("long").alias("route"), "stop_order", "geo_id", "geo_description")


@query("select count(*) filter (s_name is null and l_linenumber <> 1) as n, 'null_place' as \"check\" from lineitem left join supplier on s_suppkey = l_suppkey and s_suppkey % 3 <> 0 union all select count(*) filter (l_returnflag <> 'N'), 'direction' from lineitem union all select count(*) filter (l_linestatus <> 'O'), 'route' from lineitem")
def schedule_violations(spark, sf_dir):
    """Rows of a schedule that fail its checks."""
    s = V.table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select("s_suppkey", F.lit(1.0).alias("stop_lat"), F.lit(1.0).alias("stop_lon"))
    rows = V.table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    rows = rows.select("stop_lat", "stop_lon", (F.col("l_linenumber") - 1).alias("stop_sort_order"), F.col("l_returnflag").alias("direction"), F.lit("N").alias("pub_direction"), F.col("l_linestatus").alias("route"), F.lit("O").alias("ta_route"))
    return stops.schedule_violations(rows)


@query("""select distinct o_orderpriority as route, o_custkey % 7 as pattern, 's' || n_nationkey as seg_name_id
  from orders join nation on n_nationkey % 5 = length(o_orderpriority) % 5 and n_name <> '' and o_orderstatus = case when n_nationkey % 2 = 0 then 'O' else 'F' end""")
def crosswalk_patterns(spark, sf_dir):
    """Patterns of segments, from routes and directions."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("route"), F.col("o_orderstatus").alias("direction"), (F.col("o_custkey") % 7).alias("pattern"))
    n = V.table(spark, sf_dir, "nation").select("n_nationkey")
    names = o.select("route").distinct()
    cross = n.join(names, F.col("n_nationkey") % 5 == F.length("route") % 5).select("route", F.when(F.col("n_nationkey") % 2 == 0, "O").otherwise("F").alias("direction"), F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("seg_name_id"))
    return segments.crosswalk_patterns(cross, o)


def _gtfs(spark, sf_dir):
    trips = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 3).alias("route_id"), (F.col("o_orderkey") % 2).alias("direction_id"), F.col("o_orderpriority").alias("trip_headsign"))
    times = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").cast("long").alias("stop_sequence")).agg(F.min("l_suppkey").alias("stop_id"))
    return trips, times, V.suppliers(spark, sf_dir).select("stop_id", "x", "y")


GT = f"""{SUPPLIERS}, tp as (select o_orderkey as trip_id, o_custkey % 3 as route_id, o_orderkey % 2 as direction_id, o_orderpriority as trip_headsign
  from orders),
tm as (select l_orderkey as trip_id, l_linenumber::bigint as stop_sequence, min(l_suppkey) as stop_id from lineitem group by all),
ts as (select * from tp join tm using (trip_id) join su using (stop_id))"""


@query(f"""with {GT}, e as (select * from ts qualify row_number() over (partition by trip_id
  order by stop_sequence) = 1) select route_id, direction_id, stop_id, count(distinct trip_id) as n_trips, array_to_string(list_sort(list(distinct trip_headsign)), '|') as headsigns
  from e group by all""")
def gtfs_terminals(spark, sf_dir):
    """First stops of each route and direction."""
    first, _ = gtfs.terminals(gtfs.trip_stops(*_gtfs(spark, sf_dir)))
    return first.select("route_id", "direction_id", "stop_id", "n_trips", F.array_join("headsigns", "|").alias("headsigns"))


@query(f"""with {GT}, s as (select trip_id, string_agg(cast(stop_id as varchar), '_'
  order by stop_sequence, stop_id) as signature from tm group by all) select signature, min(trip_id) as trip_id, count(*) as n_trips
  from s group by all""")
def gtfs_trip_signature(spark, sf_dir):
    """Distinct orders of stops of trips."""
    return gtfs.unique_signatures(gtfs.trip_signatures(_gtfs(spark, sf_dir)[1]))


GN = f"""{PINGS}, {SUPPLIERS}, gs as (select stop_id, route, stop_sort_order as stop_sequence, x, y from su where pattern = 0),
gj as (select {RK}, index_loc, stop_id, stop_sequence, sqrt((p.x - gs.x) * (p.x - gs.x) + (p.y - gs.y) * (p.y - gs.y)) as d
  from p join gs using (route)),
gn as (select * from gj qualify row_number() over (partition by {RK}, stop_id, stop_sequence order by d, index_loc) = 1)"""


def _gtfs_stops(spark, sf_dir):
    return V.suppliers(spark, sf_dir).where("pattern = 0").select("stop_id", "route", F.col("stop_sort_order").alias("stop_sequence"), "x", "y")


@query(f"with {GN} select {RK}, stop_id, stop_sequence, index_loc, round(d, 6) as dist_to_nearest_point from gn")
def gtfs_nearest_stops(spark, sf_dir):
    """The ping nearest to each stop of a run's route."""
    near = gtfs.nearest_gtfs_stop(_gtfs_stops(spark, sf_dir), V.pings(spark, sf_dir), digits=6, single=True)
    return near.select("filename", "index_run_start", "stop_id", "stop_sequence", "index_loc", "dist_to_nearest_point")


@query(f"""with {GN}, a as (select * from gn where d < 3000 qualify index_loc = min(index_loc) over (partition by {RK}, stop_sequence)),
b as (select * from a qualify d = min(d) over (partition by {RK}, stop_sequence)),
c as (select *, coalesce(lag(index_loc) over (partition by {RK} order by stop_sequence, stop_id) >= index_loc, false) as bad from b)
select {RK}, stop_id, stop_sequence, index_loc from c qualify not bool_or(bad) over (partition by {RK})""")
def gtfs_stops_on_route(spark, sf_dir):
    """Stops near enough, of runs in order."""
    return gtfs.route_stops(_gtfs_stops(spark, sf_dir), V.pings(spark, sf_dir), 3000.0).select("filename", "index_run_start", "stop_id", "stop_sequence", "index_loc")


def _terminals(spark, sf_dir, last: bool):
    """The first (or last) stop of each route and direction."""
    s = V.suppliers(spark, sf_dir)
    own = (windows.keep_last if last else windows.keep_one)(s, ["route", "pattern"], ["stop_id"])
    return own.select("route", F.col("pattern").alias("direction_id"), "stop_id", "x", "y")


def _terminal_sql(order: str, name: str) -> str:
    return f"""{name} as (select route, pattern as direction_id, stop_id, x, y
  from su qualify row_number() over (partition by route, pattern
  order by stop_id {order}) = 1),
{name}j as (select {RK}, index_loc, direction_id, {name}.stop_id, sqrt((p.x - {name}.x) * (p.x - {name}.x) + (p.y - {name}.y) * (p.y - {name}.y)) as d
  from p join {name} using (route)),
{name}n as (select * from {name}j qualify row_number() over (partition by {RK}, direction_id order by d, index_loc) = 1)"""


@query(f"""with {PINGS}, {SUPPLIERS}, {_terminal_sql('asc', 'ft')}, {_terminal_sql('desc', 'lt')}, a as (select *
  from ftn where d <= 5280 qualify index_loc = min(index_loc) over (partition by {RK})),
a2 as (select *, (select count(distinct direction_id) from a b where b.filename = a.filename and b.index_run_start = a.index_run_start) as nd from a),
l2 as (select {RK}, direction_id, max(index_loc) as last_index from ltn where d <= 5280 group by all)
select {RK}, direction_id from a2 left join l2 using ({RK}, direction_id)
  where nd = 1 or last_index is not null qualify row_number() over (partition by {RK}
  order by last_index desc nulls last, d, direction_id) = 1""")
def gtfs_direction(spark, sf_dir):
    """Each run's direction, from its terminals."""
    p = V.pings(spark, sf_dir)
    near = lambda last: nearest.nearest_ping(_terminals(spark, sf_dir, last), p, ["direction_id", "stop_id"], on=["route"])
    return gtfs.direction(near(False), near(True))


@query(f"""with {PINGS}, {SUPPLIERS}, ft as (select route, x, y from su
  where pattern = 0 qualify row_number() over (partition by route
  order by stop_id) = 1),
lt as (select route, x, y from su where pattern = 0 qualify row_number() over (partition by route
  order by stop_id desc) = 1),
b as (select {RK}, arg_min(index_loc, row(sqrt((p.x - ft.x) * (p.x - ft.x) + (p.y - ft.y) * (p.y - ft.y)), index_loc)) as lo, arg_min(index_loc, row(sqrt((p.x - lt.x) * (p.x - lt.x) + (p.y - lt.y) * (p.y - lt.y)), index_loc)) as hi
  from p join ft using (route) join lt using (route) group by all)
select {RK}, max(odom_ft) - min(odom_ft) as feet, max(sec_past_st) - min(sec_past_st) as secs, count(*) as n_pings
  from p join b using ({RK}) where index_loc between lo and hi
  group by all""")
def terminal_trim(spark, sf_dir):
    """Runs trimmed to their terminals, summed up."""
    s = V.suppliers(spark, sf_dir).where("pattern = 0")
    first, last = windows.keep_one(s, ["route"], ["stop_id"]), windows.keep_last(s, ["route"], ["stop_id"])
    return gtfs.gtfs_summary(gtfs.trim_to_terminals(V.pings(spark, sf_dir), first, last))


@query(f"""with {PINGS}, {SUPPLIERS}, f as (select * from p qualify row_number() over (partition by {RK} order by index_loc) = 1),
j as (select {RK}, su.stop_id, sqrt((f.x - su.x) * (f.x - su.x) + (f.y - su.y) * (f.y - su.y)) as d
  from f join su using (route)) select {RK}, stop_id, round(d, 6) as dist
  from j qualify row_number() over (partition by {RK} order by d, stop_id) = 1""")
def terminal_match(spark, sf_dir):
    """The stop closest to each run's first ping."""
    first = windows.keep_one(V.pings(spark, sf_dir), ["filename", "index_run_start"], ["index_loc"])
    return r6(nearest.terminal_match(first, V.suppliers(spark, sf_dir).select("route", "stop_id", "x", "y")).select("filename", "index_run_start", "stop_id", "dist"))


# Field observations

FIELD = f"""fo as (select event_id as obs_id, route, user_id as bus_id, sec_past_st + event_id % 3000 - 1500 as obs_secs
  from p where kind = 'error'),
pa as (select filename, index_run_start, route, user_id as bus_id, index_loc, sec_past_st as pass_secs
  from p where kind = 'purchase')"""


def _field(spark, sf_dir):
    p = V.pings(spark, sf_dir)
    field = p.where("kind = 'error'").select(F.col("event_id").alias("obs_id"), "route", F.col("user_id").alias("bus_id"), (F.col("sec_past_st") + F.col("event_id") % 3000 - 1500).alias("obs_secs"))
    passes = p.where("kind = 'purchase'").select("filename", "index_run_start", "route", F.col("user_id").alias("bus_id"), "index_loc", F.col("sec_past_st").alias("pass_secs"))
    return field, passes


@query(f"""with {PINGS}, {FIELD} select obs_id, index_loc, pass_secs - obs_secs as delta
  from fo join pa using (route, bus_id) where abs(pass_secs - obs_secs) <= 40000""")
def field_match(spark, sf_dir):
    """Observations and passes close in time."""
    return fieldcheck.match_by_time(*_field(spark, sf_dir), "obs_secs", "pass_secs", 40_000).select("obs_id", "index_loc", "delta")


@query(f"""with {PINGS}, {FIELD} select obs_id, index_loc, pass_secs + 300 - obs_secs as delta
  from fo join pa using (route, bus_id) where pass_secs < obs_secs and abs(pass_secs + 300 - obs_secs) < 40000""")
def field_match_by_start(spark, sf_dir):
    """Observations and passes that began before, with an estimated time near."""
    field, passes = _field(spark, sf_dir)
    passes = passes.withColumn("approx", F.col("pass_secs") + 300)
    return fieldcheck.match_by_start(field, passes, "obs_secs", "pass_secs", "approx", 40_000).select("obs_id", "index_loc", "delta")


@query(f"""with {PINGS}, {FIELD}, m as (select distinct obs_id from fo join pa using (route, bus_id)
  where abs(pass_secs - obs_secs) <= 40000) select obs_id, (m.obs_id is not null)::bigint as has_run, (obs_id % 2 = 0)::bigint as has_even
  from fo left join m using (obs_id)""")
def field_coverage(spark, sf_dir):
    """All observations, with what was found for them."""
    field, passes = _field(spark, sf_dir)
    matched = fieldcheck.match_by_time(field, passes, "obs_secs", "pass_secs", 40_000)
    return fieldcheck.coverage(field, ["obs_id"], run=matched, even=field.where("obs_id % 2 = 0")).select("obs_id", "has_run", "has_even")


@query(f"""with {PINGS}, {FIELD} select route, round(regr_slope(pass_secs, obs_secs), 6) as slope, round(regr_intercept(pass_secs, obs_secs), 3) as intercept, round(regr_r2(pass_secs, obs_secs), 6) as r2, regr_count(pass_secs, obs_secs) as n
  from fo join pa using (route, bus_id) where abs(pass_secs - obs_secs) <= 40000
  group by all""")
def field_trend(spark, sf_dir):
    """Computed over observed times, a line for each route."""
    pairs = fieldcheck.match_by_time(*_field(spark, sf_dir), "obs_secs", "pass_secs", 40_000)
    out = fieldcheck.trend(pairs, "pass_secs", "obs_secs", ["route"])
    return out.select("route", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), F.col("n").cast("long").alias("n"))


@query(f"""with {PINGS}, r as (select distinct {RK} from p),
v as (select distinct {RK} from p where kind = 'view'),
e as (select distinct {RK} from p where kind = 'error'),
w as (select distinct {RK} from p where stop_window = 'E05') select r.*, case when v.filename is null then 'view' when e.filename is null then 'error' when w.filename is null then 'window' end as lost_at
  from r left join v using ({RK}) left join e using ({RK}) left
  join w using ({RK})""")
def attrition_audit(spark, sf_dir):
    """The first step that loses each run."""
    p = V.pings(spark, sf_dir)
    return fieldcheck.attrition_audit(p, {"view": p.where("kind = 'view'"), "error": p.where("kind = 'error'"), "window": p.where("stop_window = 'E05'")})


@query(f"""with {PINGS}, {RUNS} select '00_all' as stage, count(*) as n_runs
  from rn union all select '01_long', count(*) from rn where secs >= 900000
  union all select '02_far', count(*) from rn where secs >= 900000 and feet >= 3000""")
def filter_funnel(spark, sf_dir):
    """Runs left after each filter."""
    r = run_rows(V.pings(spark, sf_dir))
    long = r.where("secs >= 900000")
    return fieldcheck.filter_funnel({"all": r, "long": long, "far": long.where("feet >= 3000")})


# Quality tables

@query(f"""with {PINGS} select hour, wday, count(*) filter (stop_window is not null) as n_kept, count(*) as n_all, round(count(*) filter (stop_window is not null) * 100.0::double / count(*), 6) as percent
  from p group by all""")
def hour_weekday_coverage(spark, sf_dir):
    """Shares of pings in stop windows by hour and weekday."""
    return r6(quality.hour_weekday_coverage(V.pings(spark, sf_dir), F.col("stop_window").isNotNull()))


PERIOD = "case when hour >= 23 then 'late night' when hour >= 19 then 'evening' when hour >= 15 then 'pm peak' when hour >= 9 then 'midday' when hour >= 6 then 'am peak' when hour >= 4 then 'early am' else 'late night' end"


@query(f"""with {PINGS}, {RUNS}, q as (select *, {PERIOD} as period from rn) select route, pattern, round(avg(secs) filter (period = 'late night'), 6) as late_night, round(avg(secs) filter (period = 'am peak'), 6) as am_peak, round(avg(secs) filter (period = 'midday'), 6) as midday
  from q group by all""")
def runtime_by_period(spark, sf_dir):
    """Mean run time by period of the day."""
    r = run_rows(V.pings(spark, sf_dir)).withColumn("period", values.period(F.col("hour")))
    out = quality.runtime_by_period(r, ["late night", "am peak", "midday"])
    return r6(out.withColumnsRenamed({"late night": "late_night", "am peak": "am_peak"}))


STATE = LEADS.format(src="p", keys=RK)


@query(f"""with {PINGS}, {STATE}, q as (select *, case when fps_next is null then 'undefined' when fps_next > 0 then 'moving' else 'stopped' end as speed_state
  from sf) select speed_state, count(*) filter (veh_state = 'M' and door_state = 'C') as m_c, count(*) filter (veh_state = 'M' and door_state = 'O') as m_o, count(*) filter (veh_state = 'S' and door_state = 'C') as s_c, count(*) filter (veh_state = 'S' and door_state = 'O') as s_o
  from q group by all""")
def state_speed_crosstab(spark, sf_dir):
    """Speed state by vehicle and door state."""
    return quality.state_crosstab(V.pings(spark, sf_dir))


@query(f"""with {PINGS}, q as (select veh_state || '_' || door_state as from_state, lead(veh_state || '_' || door_state) over (partition by {RK}
  order by index_loc) as to_state from p) select from_state, to_state, count(*) as n
  from q where to_state is not null group by all""")
def state_changes(spark, sf_dir):
    """Which state follows which."""
    return quality.state_changes(V.pings(spark, sf_dir))


@query(f"""with {PINGS}, {STATE}, q as (select * from sf where veh_state = 'S' and secs_marg is not null) select route, cast(sum(secs_marg) as bigint) as stopped_secs, cast(sum(case when stop_window is not null then secs_marg else 0 end) as bigint) as inside_secs, round(sum(case when stop_window is not null then secs_marg else 0 end) / (case when sum(secs_marg) <> 0 then sum(secs_marg) end)::double, 6) as share
  from q group by all""")
def stopped_in_window_share(spark, sf_dir):
    """Share of stopped time inside stop windows."""
    return r6(quality.stopped_in_window_share(V.pings(spark, sf_dir)))


@query(f"with {PINGS}, {RUNS} select route, pattern, count(*) as n_runs from rn where secs >= 900000 group by all")
def usable_runs(spark, sf_dir):
    """Usable runs by pattern."""
    return quality.usable_runs(run_rows(V.pings(spark, sf_dir)).where("secs >= 900000"))


@query(f"""with {PINGS} select {RK}, count(*) as n, count(*) filter (stop_window is null) as null_stop_window, count(*) filter (lat is null) as null_lat, count(*) filter (lat = 0 or long = 0) as zero_place
  from p group by all""")
def completeness(spark, sf_dir):
    """Nulls and zero places of each run."""
    return quality.completeness(V.pings(spark, sf_dir), ["stop_window", "lat"], windows.RUN)


GPS = f"""g1 as (select *, sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) as gps_step, odom_ft - lag(odom_ft) over w as odom_step
  from p window w as (partition by {RK} order by index_loc))"""


@query(f"""with {PINGS}, {GPS} select {RK}, count(*) filter (odom_step > 10 and gps_step < 1) as only_odometer, count(*) filter (odom_step < 1 and gps_step > 10) as only_gps
  from g1 group by all""")
def gps_odo_gap(spark, sf_dir):
    """Steps that only one of odometer and GPS has."""
    return quality.gps_odo_gap(V.pings(spark, sf_dir))


@query(f"""with {PINGS}, {GPS}, g2 as (select *, sum(gps_step) over (partition by {RK}
  order by index_loc rows unbounded preceding) as gps_total from g1) select filename, index_loc, round(gps_total, 4) as gps_total, round(odom_step - gps_step, 4) as step_difference, round(odom_ft - min(odom_ft) over (partition by {RK}) - gps_total, 4) as total_difference
  from g2""")
def cumulative_gps_distance(spark, sf_dir):
    """GPS distance so far against the odometer."""
    out = quality.gps_distance(V.pings(spark, sf_dir))
    return out.select("filename", "index_loc", *(F.round(c, 4).alias(c) for c in ("gps_total", "step_difference", "total_difference")))


@query(f"""with {PINGS}, s as (select *, sec_past_st - lag(sec_past_st) over w as t, odom_ft - lag(odom_ft) over w as d
  from p window w as (partition by {RK} order by index_loc)),
f as (select *, case when t <> 0 then d / t::double end as fps
  from s),
a as (select *, fps - lag(fps) over (partition by {RK} order by index_loc) as df
  from f) select filename, index_loc, round(fps, 6) as fps, round(case when t <> 0 then df / t end, 6) as accel
  from a""")
def speeds_and_accelerations(spark, sf_dir):
    """Speed and acceleration from the row before."""
    out = quality.speeds_and_accelerations(V.pings(spark, sf_dir))
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c)).alias(c)
    return r6(out.select("filename", "index_loc", finite("fps"), finite("accel")))


@query(f"""with {PINGS}, {STATE}, n as (select *, fps_next is null as u
  from sf) select filename, index_loc, u and (coalesce(lag(u) over w, false) or coalesce(lead(u) over w, false)) as undefined_pair
  from n window w as (partition by {RK} order by index_loc)""")
def undefined_speed_pairs(spark, sf_dir):
    """Rows without a speed next to others."""
    return quality.undefined_speed_pairs(V.pings(spark, sf_dir)).select("filename", "index_loc", "undefined_pair")


@query(f"""with {PINGS}, {STATE}, q as (select *, case when isinf(fps_next) then null else fps_next end as v, row_number() over (partition by {RK}
  order by index_loc) as rn from sf) select filename, index_loc, round(case when rn >= 3 then avg(v) over (partition by {RK}
  order by index_loc rows between 2 preceding and current row) end, 6) as mean_fps
  from q""")
def rolling_mean_speed(spark, sf_dir):
    """Mean of the last three speeds."""
    p = windows.rolling_speeds(V.pings(spark, sf_dir)).withColumn("v", F.when(F.abs("fps_next") < float("inf"), F.col("fps_next")))
    return r6(p.select("filename", "index_loc", windows.rolling_mean(F.col("v"), 3).alias("mean_fps")))


BAND = "case when hour >= 19 then 'other' when hour >= 15 then 'pm' when hour >= 10 then 'midday' when hour >= 6 then 'am' else 'other' end"


@query(f"""with {PINGS}, {RUNS}, q as (select *, {BAND} as band from rn) select {RK}, wday, band
  from q qualify row_number() over (partition by wday, band order by start_secs, filename, index_run_start) <= 5""")
def first_n_trips(spark, sf_dir):
    """The first five runs of each weekday and band."""
    r = run_rows(V.pings(spark, sf_dir)).withColumn("band", values.period(F.col("hour"), values.BANDS))
    return windows.first_rows(r, 5, ["wday", "band"], ["start_secs", "filename", "index_run_start"]).select("filename", "index_run_start", "wday", "band")


@query(f"""with {PINGS}, {RUNS}, q as (select *, {BAND} as band from rn),
k as (select {RK} from q qualify row_number() over (partition by wday, band
  order by start_secs, filename, index_run_start) <= 2) select filename, index_loc, odom_ft - min(odom_ft) over (partition by {RK}) as feet, sec_past_st - min(sec_past_st) over (partition by {RK}) as secs
  from p semi join k using ({RK})""")
def timespace(spark, sf_dir):
    """Zero-based trajectories of the first runs."""
    p = V.pings(spark, sf_dir)
    r = run_rows(p).withColumn("band", values.period(F.col("hour"), values.BANDS)).select("filename", "index_run_start", "start_secs", "band", F.col("wday").alias("run_wday"))
    out = quality.timespace(p.join(r, ["filename", "index_run_start"]), 2, by=("run_wday", "band"))
    return out.select("filename", "index_loc", "feet", "secs")


@query(IN_SEG + f", g as (select {SEGK}, (max(odom_ft) - min(odom_ft)) / (case when max(sec_past_st) <> min(sec_past_st) then max(sec_past_st) - min(sec_past_st) end)::double as v from pin group by all) select seg_name_id, round(quantile_cont(v, 0.02), 6) as p02, round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.75), 6) as p75, round(quantile_cont(v, 0.98), 6) as p98 from g group by all")
def segment_mean_speeds(spark, sf_dir):
    """Percentiles of mean speeds on segments."""
    p = V.pings(spark, sf_dir)
    return r6(quality.segment_mean_speeds(decompose.filter_to_segment(p, V.segment_rows(p)), decompose.SEG))


@query(IN_SEG + " select seg_name_id, round(quantile_cont(fps_next, 0.05), 6) as p05, round(quantile_cont(fps_next, 0.5), 6) as p50, round(quantile_cont(fps_next, 0.95), 6) as p95 from sf where fps_next is not null and not isinf(fps_next) group by all")
def ping_speed_percentiles(spark, sf_dir):
    """Percentiles of ping-to-ping speeds."""
    p = V.pings(spark, sf_dir)
    return r6(quality.ping_speed_percentiles(decompose.filter_to_segment(p, V.segment_rows(p)), decompose.SEG))


@query("""select l_returnflag, l_linestatus, count(l_quantity) as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as std, min(l_quantity) as min, quantile_cont(l_quantity, 0.25) as p25, quantile_cont(l_quantity, 0.5) as p50, quantile_cont(l_quantity, 0.75) as p75, max(l_quantity) as max
  from lineitem group by all""")
def describe_by(spark, sf_dir):
    """Distribution of a measure by group."""
    return r6(quality.describe_by(V.table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]))


@query("""select event_id, cast(strftime(ts, '%H')::int * 3600 + strftime(ts, '%M')::int * 60 + strftime(ts, '%S')::int as double) as hms, cast(strftime(ts, '%M')::int * 60 + strftime(ts, '%S')::int as double) as ms, cast(strftime(ts, '%S')::int as double) as s, cast(null as double) as bad, strftime(ts - interval 1 day, '%Y-%m-%d') as service_date, case event_type when 'view' then 'V' when 'click' then 'C' else event_type end as code
  from events""")
def time_parsing(spark, sf_dir):
    """Seconds of times of day in several forms, service dates and labels."""
    e = V.table(spark, sf_dir, "events")
    at = lambda fmt: values.seconds_of(F.date_format("ts", fmt))
    return e.select("event_id", at("HH:mm:ss").alias("hms"), at("mm:ss").alias("ms"), at(":ss").alias("s"), values.seconds_of(F.lit("n/a")).alias("bad"), F.date_format(values.service_date(F.date_format("ts", "yyMMdd")), "yyyy-MM-dd").alias("service_date"), values.label(F.col("event_type"), {"view": "V", "click": "C"}).alias("code"))


@query(f"""with {PINGS} select filename, index_loc, cast((sec_past_st + 3600) % 86400 as bigint) as secs_past_midnight
  from p where (sec_past_st + 3600) % 86400 between 21600 and 64800""")
def reading_times(spark, sf_dir):
    """Readings of the day's hours, by their seconds past midnight."""
    p = V.pings(spark, sf_dir).withColumn("start_date_time", F.timestamp_seconds(F.lit(3600)))
    out = fieldcheck.between_times(legacy.reading_times(p), "gps_reading_dtm", "06:00:00", "18:00:00")
    return out.select("filename", "index_loc", F.col("secs_past_midnight").cast("long").alias("secs_past_midnight"))


from transitlake.plans import chains  # noqa: E402, F401  registers its queries
