"""The chains that users run, end to end: logs to pings and runs, to stops and segments, to travel time."""

import zipfile

import pytest
from pyspark.sql import functions as F

from transitlake.functions.geo import lcc_feet
from transitlake.operators import decompose, fieldcheck, runs, segments, stops
from transitlake.operators.windows import RUN
from transitlake.sources import logs, tables

LON, LAT0, STEP = -77.02, 38.9200, 0.0001  # a step of latitude is about 36 feet
STOPS = (5, 40, 75)


def trip(tag_time, halts, seconds=1):
    """Log lines of a bus that drives 80 steps north; at each halt (step -> pings) it stands with open doors."""
    lines, sec, odom = [f"  S2801,4,10/07/19,{tag_time},36476,05280"], 0, 0
    for step in range(81):
        where = f"{LAT0 + step * STEP:.6f},{LON:.6f}"
        for i in range(halts.get(step, 0) + 1):
            door, moving = ("O", "S") if 0 < i < halts.get(step, 0) else ("C", "M" if i == 0 else "S")
            window = f"E{STOPS.index(step):02d}" if step in STOPS else "   "
            lines.append(f"{where},0,{door},{moving},{odom:06d},{sec:04d},08,{window},9,{where}")
            sec += seconds if i == 0 else 5
        odom += 36
    return [*lines, f"/ {tag_time[:3]}59:00 Buswares navigation reported end of route"]


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("chain")
    trips = [trip("06:00:00", {40: 4}), trip("07:00:00", {}), trip("08:00:00", {40: 8, 75: 2}, 2), trip("09:00:00", {20: 3})]
    for bus, own in ((4, trips[:2]), (5, trips[2:])):
        name = f"rawnav{bus:05d}191008.txt"
        with zipfile.ZipFile(top / f"{name}.zip", "w") as z:
            z.writestr(name, "\r\n".join(["", "cal,1,1", *(x for t in own for x in t)]) + "\r\n")
    files = logs.log_files(spark, str(top))
    lines = logs.log_lines(files).drop("path")
    pings, found = runs.clean_pings(lines, runs.tag_inventory(lines, files))
    kept = runs.long_enough(found, 60, 0.1)
    x, y = lcc_feet(F.col("long"), F.col("lat"))
    pings = pings.join(kept.select(*RUN, "route", "pattern"), list(RUN)).withColumns({"x": x, "y": y})
    x, y = lcc_feet(F.col("stop_lon"), F.col("stop_lat"))
    rows = [("S28", "01", i + 1, 100 + i, LON, LAT0 + s * STEP) for i, s in enumerate(STOPS)] + [("S28", "01", 4, 104, LON, LAT0 + 0.05)]
    schedule = spark.createDataFrame(rows, "route string, pattern string, stop_sort_order int, stop_id int, stop_lon double, stop_lat double").withColumns({"x": x, "y": y})
    shape = spark.createDataFrame([("mid", [(LON, LAT0 + 25 * STEP), (LON, LAT0 + 40 * STEP), (LON, LAT0 + 60 * STEP)])], "seg_name_id string, coords array<struct<lon:double,lat:double>>")
    patterns = spark.createDataFrame([("S28", "01", "mid")], "route string, pattern string, seg_name_id string")
    stop_summary, stop_index = stops.merge_stops(pings, kept, schedule)
    index, summary = segments.merge_segments(pings, kept, shape, patterns)
    good = summary.where(segments.quality())
    at = stop_index.where("stop_id = 101").select(*RUN, F.lit("mid").alias("seg_name_id"), "stop_id", F.col("odom_ft").alias("odom_ft_stop"))
    phases = decompose.stop_area_phases(pings, good, at)
    ff = decompose.free_flow_speed(decompose.freeflow(pings, good))
    times = decompose.travel_time(pings, good, phases, ff)
    return {k: v.cache() for k, v in {"runs": kept, "stop_index": stop_index, "stop_summary": stop_summary, "index": index, "summary": summary, "phases": phases, "times": times}.items()}


def keys(df, *more):
    return {tuple(r) for r in df.select(*RUN, *more).collect()}


def test_runs_of_the_logs(chain):
    rows = chain["runs"].orderBy("filename", "index_run_start").collect()
    assert [(r["filename"], r["route"], r["pattern"], r["wday"]) for r in rows] == [(f"rawnav{b:05d}191008.txt", "S28", "01", "Monday") for b in (4, 4, 5, 5)]
    assert all(r["odom_ft_end"] == 80 * 36 for r in rows)
    assert rows[0]["run_duration_from_sec"] == 80 + 4 * 5 and rows[0]["run_duration_from_tags"] == 59 * 60


def test_stops_rise_along_each_run_and_lie_near(chain):
    by = {}
    for r in chain["stop_index"].orderBy("stop_sort_order").collect():
        by.setdefault((r["filename"], r["index_run_start"]), []).append(r)
    assert len(by) == 4
    for rows in by.values():
        at = [r["index_loc"] for r in rows]
        assert at == sorted(set(at)) and all(r["dist_to_nearest_point"] < 100 for r in rows) and [r["stop_id"] for r in rows] == [100, 101, 102]
    summary = chain["stop_summary"].collect()
    assert all((r["n_found"], r["n_scheduled"], r["n_missing"], r["trip_dist_ft"]) == (3, 4, 1, 70 * 36) for r in summary)


def test_index_and_summary_hold_the_same_runs(chain):
    assert keys(chain["index"]) == keys(chain["summary"]) == keys(chain["runs"])
    assert keys(chain["stop_index"]) == keys(chain["stop_summary"])
    for r in chain["summary"].collect():
        assert (r["start_odom_ft_segment"], r["end_odom_ft_segment"]) == (25 * 36, 60 * 36)
        assert not any(r[f] for f in ("flag_too_far_any", "flag_wrong_order_any", "flag_too_long_odom", "flag_counter_reset"))
        assert r["trip_dist_mi_odom_and_segment"] == pytest.approx(35 * 36 / 5280, abs=0.005) and r["route"] == "S28"


def test_no_run_both_stops_and_passes(chain):
    by = {}
    for r in chain["phases"].select(*RUN, "phase").distinct().collect():
        by.setdefault((r["filename"], r["index_run_start"]), set()).add(r["phase"])
    assert len(by) == 4 and all(not (x & {"t_stop1", "t_stop"}) for x in by.values() if "t_nostopnopax" in x)
    assert sum("t_stop1" in x for x in by.values()) == 2


def test_times_add_up_and_agree_with_the_flag(chain):
    rows = chain["times"].collect()
    assert len(rows) == 4 and sum(r["flag_nostop"] for r in rows) == 2
    for r in rows:
        assert (r["t_stop2"] == 0) == r["flag_nostop"] or r["t_decacc"] == 0
        assert r["t_ff"] + r["t_stop2"] + r["t_stop1"] + r["t_stop"] + r["t_traffic"] == pytest.approx(r["t_segment"], abs=0.5)


def test_runs_without_a_match_give_empty_results(chain, spark):
    none = chain["runs"].limit(0)
    schedule = spark.createDataFrame([], "route string, pattern string, stop_sort_order int, stop_id int, x double, y double")
    pings = spark.createDataFrame([], "filename string, index_run_start long, index_loc long, route string, pattern string, odom_ft long, sec_past_st long, lat double, long double, x double, y double")
    summary, index = stops.merge_stops(pings, none, schedule)
    assert summary.count() == index.count() == 0


def test_service_day(spark):
    lines = spark.createDataFrame([("rawnav00004191008.txt", 1, "  S2801,4,10/07/19,01:30:00,1,05280"), ("rawnav00004191008.txt", 2, "38.92,-77.02,0,C,M,0,0,8,,9,38.92,-77.02")], "filename string, line_num long, line string")
    assert runs.clean_pings(lines)[1].first()["wday"] == "Monday"
    assert runs.clean_pings(lines, service_day_cutoff_hour=3)[1].first()["wday"] == "Sunday"


def test_field_comparison(spark):
    field = spark.createDataFrame([(1, "79", 4, 1000), (2, "79", 4, 9000), (3, "70", 4, 1000)], "obs_id long, route string, bus_id long, obs_secs long")
    found = spark.createDataFrame([("f", 0, "79", 4, 1500), ("f", 9, "79", 4, 10_001)], "filename string, index_run_start long, route string, bus_id long, pass_secs long")
    times = spark.createDataFrame([("f", 0, 12.0, 3.0)], "filename string, index_run_start long, t_stop1 double, t_traffic double")
    rows = {r["obs_id"]: r for r in fieldcheck.compare_field(field, found, times).collect()}
    assert [(rows[i]["delta"], rows[i]["t_stop1"], rows[i]["has_run"], rows[i]["has_decomposition"]) for i in (1, 2, 3)] == [(500, 12.0, 1, 1), (None, None, 0, 0), (None, None, 0, 0)]


def test_tables_over_jdbc(spark):
    url, props = "jdbc:derby:memory:transit;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([("f", 1, i, float(i)) for i in range(50)], "filename string, index_run_start int, index_loc int, lat double")
    tables.write_jdbc(rows, url, "readings", props, ["filename", "index_run_start", "index_loc"])
    back = tables.read_jdbc(spark, url, "readings", tables.PINGS, props, "INDEX_LOC", (0, 50), 4)
    assert back.columns == tables.PINGS.names and back.rdd.getNumPartitions() == 4
    assert sorted(r["index_loc"] for r in back.collect()) == list(range(50))
    assert set(tables.read_schedule_tables(spark, url, {"stop": "readings"}, props)) == {"stop"}


def test_other_sinks(spark, tmp_path):
    inventory = spark.createDataFrame([(f"f{i % 3}", i) for i in range(9)], "filename string, line_num long")
    tables.write_inventory(inventory, str(tmp_path / "inventory"))
    assert spark.read.parquet(str(tmp_path / "inventory")).count() == 9
    rows = spark.createDataFrame([("79", "Monday", "s", 1), ("79", "Monday", "t", 2)], "route string, wday string, seg_name_id string, v int")
    tables.write_segments(rows, str(tmp_path / "segments"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "segments/route=79/wday=Monday/seg_name_id=t")).collect()) == [2]
    (tmp_path / "a.csv").write_text(",".join(tables.FIELD_COLUMNS) + "\n" + ",".join(["79"] * len(tables.FIELD_COLUMNS)) + "\n")
    sheets = tables.read_field_sheets(spark, {"north": str(tmp_path / "a.csv"), "south": str(tmp_path / "a.csv")})
    assert sorted(r["field_qjump_loc"] for r in sheets.collect()) == ["north", "south"]


def test_odd_bytes_part_no_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "rawnav00004191008.txt.zip", "w") as z:
        z.writestr("rawnav00004191008.txt", b"a\x0bb\x1cc\x85d\r\n\r\ne\n")
    got = logs.log_lines(logs.log_files(spark, str(tmp_path))).orderBy("line_num").collect()
    assert [(r["line_num"], r["line"]) for r in got] == [(1, "a\x0bb\x1cc\x85d"), (2, ""), (3, "e")]
