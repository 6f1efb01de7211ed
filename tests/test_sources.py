import json
import zipfile

import pytest
from pyspark.sql import functions as F

from transitlake.operators import legacy, runs, segments
from transitlake.sources import logs, tables

LOG = """/ 14:53:30 BWRawNav Collection Module was STARTED
cal,15128,110
  S2801,4,10/06/19,05:36:41,36476,05280
38.921298,-76.969803,312,C,S,000000,0000,17,   ,9,38.921310,-76.969790
apc,55,14,1,21,0,0
38.921300,-76.969900,312,O,S,000010,0010,17,E01,9,38.921310,-76.969790
38.921300,-76.969900,512,O,S,000010,0010,17,E01,9,38.921310,-76.969790
38.922300,-76.979900,312,C,M,002010,0110,17,E02,9,38.921310,-76.969790
/ 05:40:41 Buswares navigation reported end of route
38.922300,-76.979900,312,C,M,002020,0120,17,   ,9,38.921310,-76.969790
  PO0016,4,10/06/19,06:00:00,36476,05280
  S2802,9,10/06/19,06:10:00,36476,05280
38.932300,-76.979900,10,C,M,000005,0003,17,   ,9,38.921310,-76.969790
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    with zipfile.ZipFile(top / "rawnav00004191007.txt.zip", "w") as z:
        z.writestr("rawnav00004191007.txt", LOG)
    with zipfile.ZipFile(top / "rawnav00005191007.txt.zip", "w") as z:
        z.writestr("other.txt", LOG)
    with zipfile.ZipFile(top / "rawnav00007191007.txt.zip", "w") as z:
        z.writestr("rawnav00007191007.txt", LOG.replace("17,   ,9", "17,,,,9"))
    (top / "rawnav00006191007.txt.zip").write_bytes(b"not a zip")
    return str(top)


@pytest.fixture(scope="module")
def parsed(spark, folder):
    files = logs.log_files(spark, [folder])
    lines = logs.log_lines(files).drop("path")
    return files, lines, runs.tag_inventory(lines, files)


def test_inventory(parsed):
    files, lines, inventory = parsed
    assert files.count() == 4
    own = inventory.where("filename = 'rawnav00004191007.txt'").orderBy("line_num").collect()
    assert [(r["line_num"], r["line_num_next"], r["route"], r["pattern"], r["wday"]) for r in own] == [(3, 11, "S28", "01", "Sunday"), (11, 12, None, None, "Sunday"), (12, None, "S28", "02", "Sunday")]
    empty = inventory.where("line_num is null").select("filename").collect()
    assert sorted(r[0] for r in empty) == ["rawnav00005191007.txt", "rawnav00006191007.txt"]
    assert runs.misplaced_tags(lines, inventory).count() == 0
    told = {r["filename"]: (r["is_empty"], r["is_mislabelled"]) for r in runs.file_quality(inventory).collect()}
    assert told["rawnav00006191007.txt"] == (True, False) and told["rawnav00004191007.txt"] == (False, True)


def test_pings_and_runs(parsed):
    _, lines, inventory = parsed
    pings, summary = runs.clean_pings(lines, inventory)
    assert {r[0] for r in pings.select("filename").distinct().collect()} == {"rawnav00004191007.txt"}  # a row with too many fields rejects its file
    own = pings.orderBy("index_loc").collect()
    assert [(r["index_loc"], r["row_before_apc"], r["index_run_start"]) for r in own] == [(0, True, 0), (2, False, 0), (4, False, 0), (6, False, None), (9, False, 9)]
    assert (own[0]["lat"], own[0]["long"], own[0]["heading"], own[0]["sat_cnt"], own[0]["stop_window"]) == (38.921298, -76.969803, 312.0, 17, "")
    first = summary.where("filename = 'rawnav00004191007.txt' and index_run_start = 0").first()
    assert (first["index_run_end"], first["odom_ft_end"], first["sec_end"], first["run_duration_from_sec"], first["run_duration_from_tags"]) == (4, 2010, 110, 110, 240)


def test_legacy_lines(parsed):
    _, lines, _ = parsed
    own = lines.where("filename = 'rawnav00004191007.txt'")
    found, readings, apc, messages = legacy.legacy_readings(own)
    assert sorted(str(r["run_date"]) for r in found.collect()) == ["2019-10-06", "2019-10-06"]
    assert readings.count() == 6 and apc.first()["x1"] == 55
    assert [r["message"] for r in messages.orderBy("line_num").collect()][1] == "Buswares navigation reported end of route"


def test_partitions_are_replaced_or_skipped(spark, tmp_path):
    path = str(tmp_path / "pings")
    row = lambda i, route: spark.createDataFrame([("f", 1, i, float(i), route, "Monday")], "filename string, index_run_start long, index_loc long, lat double, route string, wday string")
    tables.write_partitioned(tables.conform(row(1, "79").unionByName(row(1, "70")), tables.PINGS), path)
    tables.write_partitioned(tables.conform(row(2, "79"), tables.PINGS), path)
    tables.write_partitioned(tables.conform(row(3, "70"), tables.PINGS), path, run_existing=False)
    got = tables.read_cleaned(spark, path, ["70", "79"], "Monday").select("route", "index_loc").collect()
    assert sorted(map(tuple, got)) == [("70", 1), ("79", 2)]
    plan = tables.read_cleaned(spark, path, "79", "Monday")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(route" in plan


def test_readers(spark, tmp_path):
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"seg_name_id": "s"}, "geometry": {"type": "LineString", "coordinates": [[-77.02, 38.92], [-77.02, 38.921]]}}]}
    (tmp_path / "s.geojson").write_text(json.dumps(shape, indent=1))
    seg = tables.read_segments(spark, str(tmp_path / "s.geojson"))
    assert segments.segment_lengths(seg).first()["length_ft"] == pytest.approx(364.2, abs=1)
    (tmp_path / "stops.txt").write_text("stop_lat,stop_id,stop_name,stop_lon,extra\n38.9,1,A,-77,x\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id,stop_sequence\nt,1,1\n")
    (tmp_path / "trips.txt").write_text("trip_id,route_id\nt,r\n")
    g = tables.read_gtfs(spark, str(tmp_path))
    assert g["stops"].first()["stop_lat"] == 38.9 and g["trips"].first()["direction_id"] is None
    (tmp_path / "sched.csv").write_text("Route,Pattern,Stop Lat\n 79 ,1,38.9\n")
    assert tables.read_schedule(spark, str(tmp_path / "sched.csv")).first().asDict() == {"route": "79", "pattern": 1, "stop_lat": 38.9}
    assert tables.inline(spark, ["a", "b"], 1, "x", 2, "y").count() == 2
    tables.write_csv(g["stops"], str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["stop_id"] == "1"
    assert tables.first_columns(g["stops"], ["stop_lon"]).columns[0] == "stop_lon"
    assert F.col is not None
