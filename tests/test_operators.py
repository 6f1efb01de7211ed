import math
import random

import pytest
from pyspark.sql import functions as F

from transitlake.functions import geo, values
from transitlake.operators import decompose, fieldcheck, nearest, quality, stops, windows
from transitlake.operators.windows import RUN


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_safe_div(spark):
    div = lambda a, b: one(spark, values.safe_div(F.lit(a), F.lit(b)))
    assert div(6, 3) == 2 and div(1, 0) == math.inf and div(-1, 0) == -math.inf and div(0, 0) is None


@pytest.mark.parametrize(("text", "seconds"), [("1:02:03", 3723), ("2:03", 123), (":07", 7), ("45", 45), ("x", None), ("1:x", None), ("1:2:3:4", None), ("", None)])
def test_seconds_of(spark, text, seconds):
    assert one(spark, values.seconds_of(F.lit(text))) == seconds


def test_service_date_crosses_months(spark):
    assert str(one(spark, values.service_date(F.lit("200301")))) == "2020-02-29"


def test_lambert_matches_known_place(spark):
    # The origin of the zone lies at (400000 m, 0) in survey feet.
    x, y = geo.lcc_feet(F.lit(-77.0), F.lit(37 + 40 / 60))
    assert one(spark, x) == pytest.approx(400000 * 3937 / 1200, abs=1e-3) and one(spark, y) == pytest.approx(0, abs=1e-3)


def test_projected_distance_is_near_the_great_circle(spark):
    a = (F.lit(-77.03), F.lit(38.92), F.lit(-77.02), F.lit(38.93))
    flat, round_ = one(spark, geo.planar_feet(*a)), one(spark, geo.haversine_feet(*a))
    assert flat == pytest.approx(round_, rel=3e-3)
    assert one(spark, geo.planar_metres(*a)) * 3.28084 == pytest.approx(flat, rel=3e-3)


def test_point_to_line(spark):
    line = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0))))
    assert one(spark, geo.line_length(line)) == 20
    assert one(spark, geo.line_distance(F.lit(5.0), F.lit(3.0), line)) == 3
    assert one(spark, geo.line_distance(F.lit(13.0), F.lit(14.0), line)) == 5
    assert [r["location"] for r in one(spark, geo.line_ends(line))] == ["first", "last"]


def rows(spark, values_, columns="value"):
    return spark.createDataFrame([("f", 1, i, v) for i, v in enumerate(values_)], f"filename string, index_run_start long, index_loc long, {columns} long")


def test_change_ids_and_fill(spark):
    df = rows(spark, [1, 1, None, 2, 2, 1])
    out = df.select("index_loc", windows.change_id_where(F.col("value"), F.col("value").isNotNull()).alias("id"), windows.fill(F.col("value")).alias("f")).orderBy("index_loc").collect()
    assert [r["id"] for r in out] == [1, 1, None, 2, 2, 3]
    assert [r["f"] for r in out] == [1, 1, 1, 2, 2, 1]


def test_fill_stays_in_its_group(spark):
    df = spark.createDataFrame([("a", 1, 1, None), ("b", 1, 1, 5)], "filename string, index_run_start long, index_loc long, value long")
    assert df.select("filename", windows.fill(F.col("value")).alias("v")).orderBy("filename").collect()[0]["v"] is None


def repeated_deletion(values_):
    """Deletes rows that fall behind the one before until none does."""
    left = list(values_)
    while any(b < a for a, b in zip(left, left[1:], strict=False)):
        left = [v for i, v in enumerate(left) if i == 0 or v >= left[i - 1]]
    return left


def test_one_pass_clean_up_is_repeated_deletion(spark):
    rng = random.Random(3)
    cases = [[rng.randrange(9) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    df = spark.createDataFrame([(f"f{c}", 1, i, v) for c, case in enumerate(cases) for i, v in enumerate(case)], "filename string, index_run_start long, stop_sort_order long, index_loc long")
    kept = windows.nondecreasing(df, "index_loc", RUN, ["stop_sort_order"]).orderBy("filename", "stop_sort_order").collect()
    for c, case in enumerate(cases):
        assert [r["index_loc"] for r in kept if r["filename"] == f"f{c}"] == repeated_deletion(case)
    strict = windows.nondecreasing(df, "index_loc", RUN, ["stop_sort_order"], strict=True).orderBy("filename", "stop_sort_order").collect()
    assert all(a["index_loc"] < b["index_loc"] for a, b in zip(strict, strict[1:], strict=False) if a["filename"] == b["filename"])


def test_reset_offsets_add_up(spark):
    df = rows(spark, [10, 20, 5, 8, 2])
    assert [r[0] for r in df.select(windows.reset_offset(F.col("value")).alias("o"), "index_loc").orderBy("index_loc").collect()] == [0, 0, 20, 20, 28]


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, t long, v string")
    back = {(r["k"], r["t"]): r["v_asof"] for r in windows.asof(left, right, "t", ["k"]).collect()}
    assert back == {("a", 5): "y", ("a", 1): None, ("b", 3): None}
    ahead = {(r["k"], r["t"]): r["v_asof"] for r in windows.asof(left, right, "t", ["k"], forward=True).collect()}
    assert ahead == {("a", 5): "y", ("a", 1): "x", ("b", 3): None}


def test_nearest_takes_the_lowest_index_on_ties(spark):
    pings = spark.createDataFrame([("f", 1, i, 0, 0, 1.0 if i else 5.0, 0.0) for i in range(3)], "filename string, index_run_start long, index_loc long, route long, pattern long, x double, y double")
    targets = spark.createDataFrame([(9, 0, 0, 0.0, 0.0), (8, 1, 0, 0.0, 0.0)], "stop_id long, route long, pattern long, x double, y double")
    out = nearest.nearest_ping(targets, pings, ["stop_id"]).collect()
    assert [(r["stop_id"], r["index_loc"], r["dist_to_nearest_point"]) for r in out] == [(9, 1, 1.0)]


def test_cells_find_all_pairs_once(spark):
    rng = random.Random(5)
    p = [(i, rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)) for i in range(300)]
    t = [(i, rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)) for i in range(30)]
    points, targets = spark.createDataFrame(p, "i long, x double, y double"), spark.createDataFrame(t, "stop_id long, x double, y double")
    found = sorted((r["i"], r["stop_id"]) for r in nearest.within_cells(points, targets, 600.0).collect())
    assert found == sorted((a[0], b[0]) for a in p for b in t if math.hypot(a[1] - b[1], a[2] - b[2]) <= 600)


def phases_by_hand(doors, speeds):
    """Steps of the phase rules for one group, row by row: door states and speeds (None: missing)."""
    n = len(doors)
    moving, known = [s is not None and s > 0 for s in speeds], [s is not None for s in speeds]
    door_id, at = [], 0
    for i in range(n):
        at += i == 0 or doors[i] != doors[i - 1]
        door_id.append(at)
    veh, at, before = [None] * n, 0, None
    for i in range(n):
        if known[i]:
            at += before is None or moving[i] != before
            before, veh[i] = moving[i], at
    for i in range(1, n):
        veh[i] = veh[i - 1] if veh[i] is None else veh[i]
    for i in reversed(range(n - 1)):
        veh[i] = veh[i + 1] if veh[i] is None else veh[i]
    opens = [door_id[i] for i in range(n) if doors[i] == "O"]
    stills = [veh[i] for i in range(n) if known[i] and not moving[i]]
    return door_id, veh, opens, stills


def test_phases_follow_the_rules(spark):
    rng = random.Random(11)
    pings, cases = [], {}
    for c in range(40):
        n, odom, sec, states = rng.randrange(4, 14), 0, 0, []
        for i in range(n):
            door = rng.choice("OCCC")
            states.append(door)
            pings.append((f"f{c}", 1, i, odom, sec, door))
            step = rng.choice([0, 0, 5, 9])
            cases.setdefault(c, []).append([door, step, None])
            odom, sec = odom + step, sec + rng.choice([0, 1, 2])
    df = spark.createDataFrame(pings, "filename string, index_run_start long, index_loc long, odom_ft long, sec_past_st long, door_state string")
    summary = df.groupBy(*RUN).agg(F.lit("s").alias("seg_name_id"), F.min("index_loc").alias("start_index_loc_segment"), F.max("index_loc").alias("end_index_loc_segment"))
    stop = summary.select(*RUN, "seg_name_id", F.lit(7).cast("long").alias("stop_id"), F.lit(50).cast("long").alias("odom_ft_stop"))
    out = decompose.stop_area_phases(df, summary, stop, 1e9, 1e9).orderBy("filename", "index_loc").collect()
    assert len(out) == len(pings)
    for c in range(40):
        own = [r for r in out if r["filename"] == f"f{c}"]
        door_id, veh, opens, stills = phases_by_hand([r["door_state"] for r in own], [r["fps_next"] for r in own])
        assert [r["door_id"] for r in own] == door_id and [r["veh_id"] for r in own] == veh
        kinds = {r["phase"] for r in own}
        assert "t_nopax" not in kinds and "doh" not in kinds
        # No run has both the no-stop phase and a stop.
        assert not ("t_nostopnopax" in kinds and kinds & {"t_stop", "t_stop1"})
        if not opens and not stills:
            assert kinds == {"t_nostopnopax"}
        if opens:
            first = [r["phase"] for r in own if r["door_id"] == min(opens)]
            assert set(first) == {"t_stop1"}
        elif stills:
            assert [r["phase"] for r in own] == ["t_decel_phase" if v < min(stills) else "t_stop" if v == min(stills) else "t_l_addl" if v <= max(stills) else "t_accel_phase" for v in veh]


def test_components_add_up_to_the_segment(spark):
    from transitlake.plans import catalog

    out = catalog.travel(spark, "/root/testdata/sf0.001").collect()
    assert out
    for r in out:
        if r["t_ff"] is not None:
            assert r["t_ff"] + r["t_stop2"] + r["t_stop1"] + r["t_stop"] + r["t_traffic"] == pytest.approx(r["t_segment"], abs=0.5)
        assert not r["flag_nostop"] or r["t_stop2"] == 0


def test_missing_and_violations(spark):
    runs = spark.createDataFrame([("f", 1, 0, 0)], "filename string, index_run_start long, route long, pattern long")
    sched = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "stop_id long, route long, pattern long")
    index = spark.createDataFrame([("f", 1, 1)], "filename string, index_run_start long, stop_id long")
    assert stops.missing_stops(index, runs, sched).first()["n_missing"] == 1
    bad = spark.createDataFrame([("null_place", 0), ("route", 2)], "check string, n long")
    with pytest.raises(ValueError, match="route: 2"):
        stops.require_clean(bad)


def test_field_types(spark):
    row = ("2020-07-01", "08:00:00", "08:01:30", "08:00:10", "08:01:00", "08:01:10", "1:05", "a")
    names = "date_obs_field, time_entered_stop_zone_field, time_left_stop_zone_field, front_door_open_field, front_door_close_field, rear_door_close_field, dwell_time_field, field_qjump_loc".split(", ")
    out = fieldcheck.correct_types(spark.createDataFrame([row], names), {"a": "Eleventh"}).first()
    assert (out["dwell_secs"], out["signal_delay"], out["field_qjump_loc"]) == (65, 30, "Eleventh")


def test_quality_report_has_its_tables(spark):
    from transitlake.plans import catalog, views

    p = views.pings(spark, "/root/testdata/sf0.001")
    tables = quality.quality_report(p, catalog.run_rows(p))
    assert all(t.count() > 0 for t in tables.values())


def test_stops_of_one_place_are_put_in_order_before_they_get_rows(spark):
    """Many stops at few places, ties of order, a stop named twice, runs of several rows: what repeated deletion leaves."""
    rng = random.Random(5)
    places = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(9)]
    rows = [(f"f{r % 2}", r, i, "A", 0, *rng.choice(places)) for r in range(6) for i in range(r * 40, r * 40 + 12)]
    rows += [("long", 7, i, "B", 0, *rng.choice(places)) for i in range(0, 3000, 100)]
    stops_ = [(s, s // 2, route, 0, *rng.choice(places)) for route in "AB" for s in range(60)] + [(3, 1, "B", 0, *places[0])]
    p = spark.createDataFrame(rows, "filename string, index_run_start long, index_loc long, route string, pattern int, x double, y double")
    s = spark.createDataFrame(stops_, "stop_id long, stop_sort_order long, route string, pattern int, x double, y double")
    for strict in (False, True):
        want = []
        for f, r in {(q[0], q[1]) for q in rows}:
            own = [q for q in rows if (q[0], q[1]) == (f, r)]
            near = {}
            for stop, order, route, _, x, y in stops_:
                if route == own[0][3]:
                    d, i = min((math.hypot(q[5] - x, q[6] - y), q[2]) for q in own)
                    if d < 300.0:
                        near[order, stop] = min(near.get((order, stop), (d, i)), (d, i))
            most = None
            for (order, stop), (_, i) in sorted(near.items()):
                if most is None or (i > most if strict else i >= most):
                    want.append((f, r, stop, i))
                most = i if most is None else max(most, i)
        got = [(q["filename"], q["index_run_start"], q["stop_id"], q["index_loc"]) for q in stops.stop_index(p, s, 300.0, strict).collect()]
        assert sorted(got) == sorted(want)
    # Rows put in order: a few of each run, not one for each stop.
    index = stops.stop_index(p, s, 300.0)
    assert "_cut" in index._jdf.queryExecution().optimizedPlan().toString()


def test_segments_of_equal_bounds_are_summed_once(spark):
    """Forty segments between the same two pings: each has its row, the pings are read once; a fall beyond the end doesn't count."""
    from transitlake.operators import segments

    rows = [("f", 1, i, i * 10 if i < 6 else 0, i, 1.0 * i, 2.0 * i) for i in range(8)]
    p = spark.createDataFrame(rows, "filename string, index_run_start long, index_loc long, odom_ft long, sec_past_st long, lat double, long double")
    ends = [("f", 1, f"s{n}", at, i, 1.0 + n, False, False) for n in range(40) for at, i in (("first", 2), ("last", 5 + (n == 0)))]
    index = spark.createDataFrame(ends, "filename string, index_run_start long, seg_name_id string, location string, index_loc long, dist_to_nearest_point double, flag_too_far boolean, flag_wrong_order boolean")
    lengths = spark.createDataFrame([(f"s{n}", 30.0) for n in range(40)], "seg_name_id string, length_ft double")
    out = segments.segment_summary(p, index, lengths)
    got = {r["seg_name_id"]: r for r in out.collect()}
    assert len(got) == 40 and got["s0"]["flag_counter_reset"] and not got["s1"]["flag_counter_reset"]
    assert (got["s7"]["start_odom_ft_segment"], got["s7"]["end_odom_ft_segment"], got["s7"]["dist_first_stop_segment"]) == (20, 50, 8.0)
    groups = [g.split("]")[0] for g in out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[1:]]
    assert any("_lo" in g and "_hi" in g for g in groups)
