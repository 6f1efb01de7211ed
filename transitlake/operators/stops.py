"""Scheduled stops on runs: schedule tables, nearest pings, order clean-up, summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions.geo import link_line
from transitlake.functions.values import FEET_A_MILE, first_of, half_even, last_of, safe_div, spread
from transitlake.operators.nearest import Search
from transitlake.operators.windows import RUN, nondecreasing

MOST_FEET = 100.0


def schedule_star(pattern: DataFrame, detail: DataFrame, stop: DataFrame) -> DataFrame:
    """Patterns with their stops and the stops' places, by route, pattern and order; unmatched rows stay."""
    names = lambda df: df.withColumnsRenamed({c: c.strip().lower().replace(" ", "_") for c in df.columns})
    joined = names(pattern).join(names(detail), "pattern_id", "left").join(names(stop), "geo_id", "left")
    return joined.withColumns({"route": F.trim("route"), "pattern": F.col("pattern").cast("int")})


def schedule_violations(schedule: DataFrame) -> DataFrame:
    """check, n: null places after the first stop; directions or routes that disagree."""
    checks = {
        "null_place": (F.col("stop_lat").isNull() | F.col("stop_lon").isNull()) & (F.col("stop_sort_order") != 0),
        "direction": F.col("direction") != F.col("pub_direction"),
        "route": F.col("route") != F.col("ta_route"),
    }
    counted = schedule.agg(*(F.count_if(c).alias(k) for k, c in checks.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in checks))).alias("p")
    return counted.select(pairs).select("p.*")


def require_clean(violations: DataFrame) -> None:
    bad = violations.where("n > 0").collect()  # a row for each check
    if bad:
        raise ValueError("schedule: " + ", ".join(f"{r['check']}: {r['n']} rows" for r in bad))


def missing_routes(wanted: DataFrame, schedule: DataFrame) -> DataFrame:
    return wanted.select("route").distinct().join(schedule.select("route"), "route", "left_anti")


def stop_index(pings: DataFrame, stops: DataFrame, most_feet: float = MOST_FEET, strict: bool = False) -> DataFrame:
    """The ping nearest to each stop of a run's pattern: closer than most_feet, in stop order along the run.

    A stop falls if one before it has a later ping. So of the stops of one place those fall that come after the first
    stop of any place with a later ping, and get no row; the clean-up itself has few rows to put in order.
    """
    order = ["stop_sort_order", "stop_id"]
    s = Search(stops, pings, order[::-1], ("route", "pattern"), RUN, most_feet, order)
    later = Window.partitionBy(*RUN).orderBy(F.desc("index_loc")).rangeBetween(Window.unboundedPreceding, -1)
    near = s.found.where(F.col("dist_to_nearest_point") < most_feet).withColumn("_cut", F.when(~F.col("_again"), F.min("_first").over(later)))
    rows = s.expand(near).where(F.col("_cut").isNull() | (F.struct(*order) < F.col("_cut"))).drop("_cut")
    return nondecreasing(rows, "index_loc", RUN, order, strict)


def first_last_stop(index: DataFrame, keys=RUN) -> DataFrame:
    """Rows at the least and greatest index_loc of each run, joined: ties stay, as rows of their own."""
    w = Window.partitionBy(*keys)
    marked = index.withColumns({"_lo": F.min("index_loc").over(w), "_hi": F.max("index_loc").over(w)})
    side = lambda at, name: marked.where(F.col("index_loc") == F.col(at)).select(*keys, F.col("index_loc").alias(f"index_loc_{name}_stop"), F.col("odom_ft").alias(f"odom_ft_{name}_stop"), F.col("sec_past_st").alias(f"sec_{name}_stop"), F.col("dist_to_nearest_point").alias(f"{name}_stop_dist_nearest_point"))
    return side("_lo", "first").join(side("_hi", "last"), list(keys))


def stop_summary(pings: DataFrame, index: DataFrame) -> DataFrame:
    """Each run between its first and last stop."""
    bounds = index.groupBy(*RUN).agg(F.min("index_loc").alias("_lo"), F.max("index_loc").alias("_hi"), F.min_by("dist_to_nearest_point", F.struct("index_loc", "stop_sort_order")).alias("dist_first_stop"))
    inside = pings.join(bounds, list(RUN)).where(F.col("index_loc").between(F.col("_lo"), F.col("_hi")))
    out = inside.groupBy(*RUN).agg(
        F.min("odom_ft").alias("start_odom_ft"),
        F.max("odom_ft").alias("end_odom_ft"),
        spread(F.col("odom_ft")).alias("trip_dist_ft"),
        F.min("sec_past_st").alias("start_sec"),
        F.max("sec_past_st").alias("end_sec"),
        spread(F.col("sec_past_st")).alias("trip_dur_sec"),
        first_of("lat").alias("start_lat"),
        last_of("lat").alias("end_lat"),
        first_of("long").alias("start_long"),
        last_of("long").alias("end_long"),
        F.first("dist_first_stop").alias("dist_first_stop"),
    )
    miles = F.col("trip_dist_ft") / FEET_A_MILE
    return out.withColumns({"trip_dist_mi": half_even(miles, 2), "trip_mph": half_even(safe_div(miles * 3600, F.col("trip_dur_sec")), 2), "dist_first_stop": half_even(F.col("dist_first_stop"), 2)})


def missing_stops(index: DataFrame, runs: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops found and scheduled for each run, and their difference."""
    found = index.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_found"))
    planned = stops.groupBy("route", "pattern").agg(F.count(F.lit(1)).alias("n_scheduled"))
    out = runs.select(*RUN, "route", "pattern").join(planned, ["route", "pattern"]).join(found, list(RUN), "left")
    return out.withColumn("n_found", F.coalesce("n_found", F.lit(0))).withColumn("n_missing", F.col("n_scheduled") - F.col("n_found"))


def merge_stops(pings: DataFrame, runs: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, index): stops snapped to pings of the listed runs; both are empty without runs."""
    listed = pings.join(runs.select(*RUN), list(RUN), "left_semi")
    index = stop_index(listed, stops)
    summary = runs.join(stop_summary(listed, index), list(RUN)).join(missing_stops(index, runs, stops).drop("route", "pattern"), list(RUN), "left")
    return summary, index


def stop_links(index: DataFrame) -> DataFrame:
    """Adds the line from each ping to its stop."""
    return index.withColumn("link", link_line(F.col("long"), F.col("lat"), F.col("stop_lon"), F.col("stop_lat")))


def order_violations(index: DataFrame) -> DataFrame:
    """Rows at which index_loc falls along the stop order, of runs that have such rows."""
    before = F.lag("index_loc").over(Window.partitionBy(*RUN).orderBy("stop_sort_order", "stop_id"))
    return index.withColumn("index_loc_before", before).where("index_loc < index_loc_before")


def _falls():
    """Column function over arrays of a run (numbers of its places, their pings) and its pattern (places of stops in order)."""

    @F.arrow_udf("array<struct<stop:int,index_loc:long,index_loc_before:long>>")
    def find(place: pa.Array, index: pa.Array, order: pa.Array) -> pa.Array:
        flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
        bounds = lambda a: a.offsets.to_numpy() - a.offsets[0].as_py()
        places, pings, stops, met, all_stops = flat(place), flat(index), flat(order), bounds(place), bounds(order)
        found = []
        for i in range(len(place)):
            own, line = slice(met[i], met[i + 1]), stops[all_stops[i] : all_stops[i + 1]]
            at, near = np.zeros(line.max() + 1, np.int64), np.zeros(line.max() + 1, bool)
            at[places[own]], near[places[own]] = pings[own], True
            stop = np.flatnonzero(near[line])
            v = at[line[stop]]
            fall = np.flatnonzero(v[1:] < v[:-1]) + 1
            found.append((stop[fall].astype(np.int32), v[fall], v[fall - 1]))
        columns = [np.concatenate([f[c] for f in found]) if found else np.array([], kind) for c, kind in enumerate((np.int32, np.int64, np.int64))]
        rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["stop", "index_loc", "index_loc_before"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)), rows)

    return find


def nearest_violations(pings: DataFrame, stops: DataFrame, most_feet: float = MOST_FEET) -> DataFrame:
    """order_violations of the pings nearest to each stop of a run's pattern, of those closer than most_feet.

    Run keys, stop_id, stop_sort_order, index_loc and index_loc_before. Stops of one place have one ping, so a run is one
    row of its places' pings, which is read in the order of its pattern's stops: only rows that fall are made, and rows
    by run and stop are not sorted.
    """
    order, on = ["stop_sort_order", "stop_id"], ["route", "pattern"]
    s = Search(stops, pings, order[::-1], on, RUN, most_feet)
    near = s.found.where(F.col("dist_to_nearest_point") < most_feet)
    pattern = Window.partitionBy(*on)
    own = s.targets.withColumns({"_place": F.dense_rank().over(pattern.orderBy("_x", "_y")) - 1, "_rank": F.row_number().over(pattern.orderBy(*order))})
    lines = own.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("_rank", "_place", *order))).alias("_line"))
    lines = lines.select(*on, *(F.col(f"_line.{c}").alias(f"_l_{c}") for c in ("_place", *order)))
    met = near.where("not _again").join(F.broadcast(own.select(*on, "_x", "_y", "_place").distinct()), [*on, "_x", "_y"])
    runs = met.groupBy(*RUN, *on).agg(F.collect_list(F.struct("_place", "index_loc")).alias("_met")).join(F.broadcast(lines), on)
    fallen = runs.withColumn("_f", _falls()(F.col("_met._place"), F.col("_met.index_loc"), F.col("_l__place")))
    # Outer, as in Search.
    rows = fallen.select(*RUN, *(f"_l_{c}" for c in order), F.explode_outer("_f").alias("_e")).where("_e is not null")
    rows = rows.select(*RUN, *(F.col(f"_l_{c}")[F.col("_e.stop")].alias(c) for c in order[::-1]), "_e.index_loc", "_e.index_loc_before")
    return rows.unionByName(order_violations(s.expand(near.where("_again"))).select(*rows.columns))
