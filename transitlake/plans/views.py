"""Bus-log-shaped views over the driver's tables, as DataFrames and as DuckDB SQL.

A run is 50 events of a user in order of time, a segment 25 of them, a stop the 13th ping of a segment. Suppliers are
stops; a supplier's key decides its place, route and pattern. Log lines are written from events and parsed back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitlake.functions.geo import albers_constants, lcc_constants
from transitlake.functions import geo
from transitlake.operators.windows import over, so_far

RUN_ROWS, SEGMENT_ROWS, STOP_ROW = 50, 25, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    by, order = ["user_id"], ["ts", "event_id"]
    i = F.row_number().over(over(by, order)).cast("long")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    step = F.when(F.col("event_type").isin("view", "click"), F.floor(F.coalesce("value", F.lit(0.0)))).otherwise(F.lit(0)).cast("long")
    e = e.withColumns({"index_loc": i, "_us": micros, "_step": step})
    e = e.withColumns({"sec_past_st": F.expr("(_us - min(_us) over (partition by user_id)) div 1000000").cast("long"), "odom_ft": F.sum("_step").over(so_far(by, order))})
    kind, key = F.col("event_type"), F.col("event_id")
    a, b = key * 104729 % 1000, key * 7919 % 1000
    return e.select(
        "user_id",
        F.concat(F.lit("bus"), F.col("user_id").cast("string")).alias("filename"),
        F.expr(f"(index_loc - 1) div {RUN_ROWS} * {RUN_ROWS} + 1").cast("long").alias("index_run_start"),
        "index_loc",
        "sec_past_st",
        "odom_ft",
        F.when(kind == "purchase", "O").otherwise("C").alias("door_state"),
        F.when(kind.isin("purchase", "error"), "S").otherwise("M").alias("veh_state"),
        F.when(kind == "click", F.concat(F.lit("E"), F.lpad((key % 12).cast("string"), 2, "0"))).alias("stop_window"),
        (a / 10000.0 - 77.05).alias("long"),
        (b / 10000.0 + 38.90).alias("lat"),
        (a * 28.8).cast("double").alias("x"),
        (b * 36.4).cast("double").alias("y"),
        (F.col("user_id") % 3).alias("route"),
        (F.col("user_id") % 2).alias("pattern"),
        kind.alias("kind"),
        "event_id",
        F.date_format("ts", "EEEE").alias("wday"),
        F.hour("ts").cast("long").alias("hour"),
    )


PINGS = f"""
ev as (select *, row_number() over (partition by user_id order by ts, event_id) as index_loc from events),
p as (select user_id, 'bus' || user_id as filename, (index_loc - 1) // {RUN_ROWS} * {RUN_ROWS} + 1 as index_run_start, index_loc,
  (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) // 1000000 as sec_past_st,
  cast(sum(case when event_type in ('view','click') then cast(floor(coalesce(value, 0)) as bigint) else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as odom_ft,
  case when event_type = 'purchase' then 'O' else 'C' end as door_state,
  case when event_type in ('purchase','error') then 'S' else 'M' end as veh_state,
  case when event_type = 'click' then 'E' || lpad(cast(event_id % 12 as varchar), 2, '0') end as stop_window,
  (event_id * 104729 % 1000) / 10000.0 - 77.05 as long, (event_id * 7919 % 1000) / 10000.0 + 38.90 as lat,
  cast((event_id * 104729 % 1000) as double) * cast(28.8 as double) as x, cast((event_id * 7919 % 1000) as double) * cast(36.4 as double) as y,
  user_id % 3 as route, user_id % 2 as pattern, event_type as kind, event_id, dayname(ts) as wday, hour(ts) as hour from ev)
"""


def segment_rows(p: DataFrame) -> DataFrame:
    """The summary of each run's segments."""
    half = F.expr(f"(index_loc - 1) % {RUN_ROWS} div {SEGMENT_ROWS}")
    own = p.withColumn("half", half).withColumn("seg_name_id", F.concat(F.lit("seg"), ((F.col("user_id") + F.col("half")) % 4).cast("string")))
    return own.groupBy("filename", "index_run_start", "seg_name_id").agg(F.min("index_loc").alias("start_index_loc_segment"), F.max("index_loc").alias("end_index_loc_segment"))


SEGMENTS = f"""
sg as (select filename, index_run_start, 'seg' || ((user_id + (index_loc - 1) % {RUN_ROWS} // {SEGMENT_ROWS}) % 4) as seg_name_id,
  min(index_loc) as lo, max(index_loc) as hi from p group by all),
pin as (select p.*, sg.seg_name_id, sg.lo, sg.hi from p join sg on p.filename = sg.filename and p.index_run_start = sg.index_run_start and p.index_loc between sg.lo and sg.hi)
"""


def segment_stops(p: DataFrame) -> DataFrame:
    """Each segment's stop, at one of its pings."""
    s = segment_rows(p)
    at = p.join(s, ["filename", "index_run_start"]).where(F.col("index_loc") == F.col("start_index_loc_segment") + STOP_ROW).where(F.col("index_loc") <= F.col("end_index_loc_segment"))
    return at.select("filename", "index_run_start", "seg_name_id", F.substring("seg_name_id", 4, 1).cast("long").alias("stop_id"), F.col("odom_ft").alias("odom_ft_stop"))


STOPS = f"""
st as (select filename, index_run_start, seg_name_id, cast(substr(seg_name_id, 4, 1) as bigint) as stop_id, odom_ft as odom_ft_stop from pin where index_loc = lo + {STOP_ROW})
"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stops of routes."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        k.cast("long").alias("stop_id"),
        (k % 3).cast("long").alias("route"),
        (k % 2).cast("long").alias("pattern"),
        (k.cast("long") * 104729 % 1000 * 28.8).cast("double").alias("x"),
        (k.cast("long") * 7919 % 1000 * 36.4).cast("double").alias("y"),
        (k.cast("long") * 104729 % 1000 / 10000.0 - 77.05).alias("stop_lon"),
        (k.cast("long") * 7919 % 1000 / 10000.0 + 38.90).alias("stop_lat"),
    )
    return s.withColumn("stop_sort_order", F.row_number().over(Window.partitionBy("route", "pattern").orderBy("stop_id")).cast("long"))


SUPPLIERS = """
su as (select cast(s_suppkey as bigint) as stop_id, cast(s_suppkey % 3 as bigint) as route, cast(s_suppkey % 2 as bigint) as pattern,
  cast(cast(s_suppkey as bigint) * 104729 % 1000 as double) * cast(28.8 as double) as x, cast(cast(s_suppkey as bigint) * 7919 % 1000 as double) * cast(36.4 as double) as y,
  (cast(s_suppkey as bigint) * 104729 % 1000) / 10000.0 - 77.05 as stop_lon, (cast(s_suppkey as bigint) * 7919 % 1000) / 10000.0 + 38.90 as stop_lat,
  row_number() over (partition by s_suppkey % 3, s_suppkey % 2 order by s_suppkey) as stop_sort_order from supplier)
"""

LINE_POINTS = 8


def lines_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of eight suppliers each, in order of key."""
    s = suppliers(spark, sf_dir).withColumn("seg_name_id", F.concat(F.lit("line"), F.expr(f"stop_id div {LINE_POINTS}").cast("string")))
    points = F.array_sort(F.collect_list(F.struct("stop_id", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"))))
    return s.groupBy("seg_name_id").agg(points.alias("p")).select("seg_name_id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("coords"))


LOG_FILE = "240101.txt"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines: sign-ups are tags, errors end messages, purchases APC rows, the rest pings (some invalid)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    n = F.row_number().over(over(["user_id"], ["ts", "event_id"])).cast("long")
    e = e.withColumn("line_num", n)
    k, user = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    clock = F.date_format("ts", "HH:mm:ss")
    route, bus = F.concat(F.lit("   A"), text(user % 10), F.lit("0"), text(user % 2)), text(user + F.when(k % 11 == 0, 1).otherwise(0))
    tag = F.concat_ws(",", route, bus, F.date_format("ts", "MM/dd/yy"), clock, text(k), F.lit("05280"))
    end = F.concat(F.lit("/ "), clock, F.lit(" Buswares navigation reported end of route"))
    lat = F.concat(F.lit("38."), F.lpad(text(k * 7919 % 1000000), 6, "0"))
    lon = F.concat(F.lit("-77."), F.lpad(text(k * 104729 % 1000000), 6, "0"))
    states = [F.when(k % 5 == 0, "O").otherwise("C"), F.when(k % 7 == 0, "S").otherwise("M")]
    ping = F.concat_ws(",", lat, lon, text(k * 7 % 400), *states, text(n * 10), text(n * 3), F.lit("08"), F.lit("   "), F.lit("9"), lat, lon)
    kind = F.col("event_type")
    line = F.when(kind == "signup", tag).when(kind == "error", end).when(kind == "purchase", F.lit("apc,55,14,1,21,0,0")).otherwise(ping)
    return e.select(F.concat(F.lit("rawnav"), F.lpad(text(user), 5, "0"), F.lit(LOG_FILE)).alias("filename"), "line_num", line.alias("line"))


LINES = f"""
ln as (select event_id, ts, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as line_num, 'rawnav' || lpad(cast(user_id as varchar), 5, '0') || '{LOG_FILE}' as filename from events),
lp as (select *, line_num - min(case when event_type = 'signup' then line_num end) over (partition by user_id) - 1 as index_loc from ln),
tg as (
  select filename, line_num, index_loc, user_id, event_id, ts, 'A' || (user_id % 10) as route, '0' || (user_id % 2) as pattern,
    user_id + case when event_id % 11 = 0 then 1 else 0 end as tag_busid, strftime(ts, '%H:%M:%S') as tag_time
  from lp where event_type = 'signup'),
pg as (
  select filename, index_loc, line_num, event_id, line_num * 10 as odom_ft, line_num * 3 as sec_past_st,
    cast('38.' || lpad(cast(event_id * 7919 % 1000000 as varchar), 6, '0') as double) as lat,
    cast('-77.' || lpad(cast(event_id * 104729 % 1000000 as varchar), 6, '0') as double) as long
  from lp where event_type in ('view', 'click') and event_id * 7 % 400 <= 360 and index_loc >= -1),
ot as (
  select *, max(case when event_type = 'signup' then index_loc end) over (partition by filename order by line_num) as tag
  from lp where index_loc >= -1),
ow as (
  select filename, tag, min(index_loc) as e, arg_min(ts, index_loc) as e_ts
  from ot where event_type = 'error' and tag is not null group by all),
bd as (
  select t.filename, t.index_loc as index_run_start, coalesce(o.e, lead(t.index_loc) over w, m.last) as index_run_end,
    case when o.e is not null then strftime(o.e_ts, '%H:%M:%S') else lead(t.tag_time) over w end as run_end_time, t.ts, t.tag_time
  from tg t left join ow o on o.filename = t.filename and o.tag = t.index_loc
    join (select filename, max(index_loc) as last from lp group by all) m on m.filename = t.filename
  window w as (partition by t.filename order by t.index_loc))
"""


def sql_lcc(lon: str, lat: str) -> tuple[str, str]:
    """geo.lcc_feet as SQL."""
    n, factor, origin = lcc_constants()
    s = f"(sin(radians({lat})) * {geo._E!r})"
    t = f"(tan({geo.math.pi / 4!r} - radians({lat}) / 2) / pow((1 - {s}) / (1 + {s}), {geo._E / 2!r}))"
    r, theta = f"(pow({t}, {n!r}) * {factor!r})", f"(radians({lon} - ({geo._LCC['lon0']!r})) * {n!r})"
    return f"({r} * sin({theta}) + {geo._LCC['x0'] * geo.SURVEY_FEET_A_METRE!r})", f"({origin!r} - {r} * cos({theta}))"


def sql_albers(lon: str, lat: str) -> tuple[str, str]:
    """geo.albers_metres as SQL."""
    n, c, origin = albers_constants()
    s = f"sin(radians({lat}))"
    q = f"(({s} / (1 - {s} * {s} * {geo._E2!r}) - ln((1 - {s} * {geo._E!r}) / (1 + {s} * {geo._E!r})) / (2 * {geo._E!r})) * (1 - {geo._E2!r}))"
    r, theta = f"(sqrt({c!r} - {q} * {n!r}) * ({geo._A!r} / {n!r}))", f"(radians({lon} - ({geo._ALBERS['lon0']!r})) * {n!r})"
    return f"({r} * sin({theta}))", f"({origin!r} - {r} * cos({theta}) + ({geo._ALBERS['y0']!r}))"


def sql_distance(a: tuple[str, str], b: tuple[str, str]) -> str:
    dx, dy = f"({a[0]} - {b[0]})", f"({a[1]} - {b[1]})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"
