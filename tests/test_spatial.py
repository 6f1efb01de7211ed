"""Ring search, corridor index and time buckets against plain comparison of all pairs, and how many pairs they compare."""

import math
import random

import numpy as np
import pytest

from transitlake.functions import rings
from transitlake.operators import fieldcheck, nearest

PINGS = "filename string, index_run_start long, index_loc long, route string, pattern int, x double, y double, odom_ft long"


def walk(rng, n, scale=60.0):
    x = y = 0.0
    for i in range(n):
        x, y = x + rng.uniform(-scale / 4, scale), y + rng.uniform(-scale / 2, scale / 2)
        yield i, x, y


@pytest.mark.parametrize("kind", ["even", "line", "lattice", "one place", "skewed", "one point"])
@pytest.mark.parametrize("within", [None, 80.0])
def test_rings_find_what_all_pairs_find(kind, within):
    rng = np.random.default_rng(len(kind))
    for _ in range(25):
        sets, n, m = int(rng.integers(1, 5)), int(rng.integers(0, 300)), int(rng.integers(0, 50))
        x, y, tx, ty = rng.uniform(0, 900, n), rng.uniform(0, 300, n), rng.uniform(-600, 1500, m), rng.uniform(-300, 600, m)
        if kind == "line":
            y[:] = 5
        elif kind == "lattice":
            x, y, tx, ty = (np.floor(v / 50) * 50 for v in (x, y, tx, ty))
        elif kind == "one place":
            x[:], y[:] = 7, 7
        elif kind == "skewed":
            x = x**3
        elif kind == "one point":
            x, y = x[:1], y[:1]
        owner, to, rank = rng.integers(0, sets, len(x)), rng.integers(0, sets, m), rng.permutation(len(x))
        found, d, _ = rings.nearest(owner, rank, x, y, to, tx, ty, sets, within)
        for j in range(m):
            own = np.flatnonzero(owner == to[j])
            all_d = np.sqrt((x[own] - tx[j]) * (x[own] - tx[j]) + (y[own] - ty[j]) * (y[own] - ty[j]))
            best = own[np.lexsort((rank[own], all_d))[0]] if len(own) else -1
            if best >= 0 and within is not None and all_d.min() > within:
                best = -1
            assert found[j] == best
            assert best < 0 or d[j] == all_d.min()


def test_rings_compare_few_pairs():
    rng = np.random.default_rng(4)
    n, m = 20_000, 500
    x, y, tx, ty = *rng.uniform(0, 1e5, (2, n)), *rng.uniform(0, 1e5, (2, m))
    *_, compared = rings.nearest(np.zeros(n, int), np.arange(n), x, y, np.zeros(m, int), tx, ty, 1)
    assert m <= compared < 60 * m
    *_, far = rings.nearest(np.zeros(n, int), np.arange(n), x, y, np.zeros(1, int), np.array([9e9]), np.array([5e4]), 1)
    assert far < n / 2
    *_, none = rings.nearest(np.zeros(n, int), np.arange(n), x, y, np.zeros(1, int), np.array([9e9]), np.array([5e4]), 1, within=100.0)
    assert none < n / 2


def test_nearest_pings_of_runs_in_parts(spark, monkeypatch):
    """Runs longer than a part, patterns with more targets than a row holds, null places, ties."""
    monkeypatch.setattr(nearest, "RUN_PART", 16)
    monkeypatch.setattr(nearest, "TARGET_PART", 5)
    rng = random.Random(3)
    rows = [(f"f{r % 3}", r, i, "A" if r % 2 else "B", r % 2, None if i % 17 == 0 else x, y, i * 10) for r in range(6) for i, x, y in walk(rng, 90)]
    rows += [("f9", 1, i, "A", 1, 100.0, float(i % 2), i) for i in range(40)]  # many pings at two places
    targets = [(s, "A" if s % 3 else "B", 1 if s % 3 else 0, rng.uniform(0, 3000), rng.uniform(-300, 300)) for s in range(40)] + [(99, "A", 1, None, 5.0), (98, "C", 1, 5.0, 5.0)]
    p, t = spark.createDataFrame(rows, PINGS), spark.createDataFrame(targets, "stop_id long, route string, pattern int, x double, y double")
    for within in (None, 150.0):
        want = {}
        for f, r, i, route, pattern, x, y, odom in rows:
            for s, troute, tpattern, tx, ty in targets:
                if x is not None and tx is not None and (route, pattern) == (troute, tpattern):
                    d = math.sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))
                    if within is None or d <= within:
                        want[f, r, s] = min(want.get((f, r, s), (math.inf, 0, 0)), (d, i, odom))
        out = nearest.nearest_ping(t, p, ["stop_id"], within=within)
        got = {(q["filename"], q["index_run_start"], q["stop_id"]): (q["dist_to_nearest_point"], q["index_loc"], q["odom_ft"]) for q in out.collect()}
        assert got == want
    assert set(out.columns) == {"filename", "index_run_start", "stop_id", "route", "pattern", "index_loc", "x", "y", "odom_ft", "target_x", "target_y", "dist_to_nearest_point"}
    assert nearest.nearest_ping(t.limit(0), p, ["stop_id"]).count() == 0


def test_pings_are_shuffled_once_for_nearest_targets(spark):
    p, t = spark.createDataFrame([], PINGS), spark.createDataFrame([], "stop_id long, route string, pattern int, x double, y double")
    plan = nearest.nearest_ping(t, p, ["stop_id"])._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Of pings: parts, and what the parts found; of targets: one, or two with the join's.
    assert plan.count("Exchange hashpartitioning(filename") == 1 or plan.count("Exchange hashpartitioning") <= 5
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def distance_to_edge(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy > 0 else 0.0
    return math.hypot(x - ax - dx * t, y - ay - dy * t)


def test_corridor_equals_all_pairs(spark):
    """Edges far longer than a cell, vertical and level ones, edges without length, lines that cross themselves."""
    rng = random.Random(8)
    lines = {"long": [(-5000.0, -4000.0), (6000.0, 5200.0)], "up": [(100.0, -3000.0), (100.0, 3000.0)], "level": [(-2000.0, 250.0), (2000.0, 250.0)], "dot": [(7.0, 7.0), (7.0, 7.0)]}
    lines["knot"] = [(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(12)]
    lines["steep"] = [(0.0, -3000.0), (0.5, 3000.0)]
    points = [(i, "A" if i % 2 else "B", rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for i in range(1500)] + [(9001, "A", 500.0, 250.0 + 150.0), (9002, "A", None, 1.0)]
    l_rows = [(name, route, [{"x": x, "y": y} for x, y in p]) for name, p in lines.items() for route in ("A", "B")] + [("none", "A", []), ("single", "A", [{"x": 1.0, "y": 1.0}]), ("null", "A", None)]
    l_df = spark.createDataFrame(l_rows, "seg string, route string, points array<struct<x:double,y:double>>")
    p_df = spark.createDataFrame(points, "id long, route string, x double, y double")
    want = sorted((i, n) for i, _, x, y in points if x is not None for n, p in lines.items() if min(distance_to_edge(x, y, *a, *b) for a, b in zip(p, p[1:])) <= 150.0)
    out = nearest.within_corridor(p_df, l_df, ["seg"], 150.0, on=["route"], cell=200.0)
    assert sorted((r["id"], r["seg"]) for r in out.collect()) == want and len(want) > 200
    cells = nearest.edge_cells(l_df.where("seg = 'long' and route = 'A'"), ["seg"], 150.0, 200.0).count()
    assert cells < 400  # the box around that edge has 2,700


def test_corridor_joins_by_cell(spark):
    p = spark.createDataFrame([], "id long, x double, y double")
    lines = spark.createDataFrame([], "seg string, points array<struct<x:double,y:double>>")
    plan = nearest.within_corridor(p, lines, ["seg"], 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "_cx" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("tolerance", [0, 10, 7.5])
def test_time_buckets_equal_all_pairs(spark, tolerance):
    rng = random.Random(11)
    times = [-31, -30, -21, -20, -11, -10, -9, -1, 0, 1, 9, 10, 11, 19, 20, 21, 30, None]
    field = [(i, rng.choice("AB"), 1, t) for i, t in enumerate(times)]
    runs = [(100 + i, route, 1, t, None if t is None else t + 4) for i, (t, route) in enumerate((t, r) for t in times for r in "AB")]
    f, r = spark.createDataFrame(field, "obs long, route string, bus_id int, at long"), spark.createDataFrame(runs, "run long, route string, bus_id int, pass long, approx long")
    known = [(o, k, a, p, q) for o, x, _, a in field for k, y, _, p, q in runs if x == y and a is not None and p is not None]
    near = fieldcheck.match_by_time(f, r, "at", "pass", tolerance)
    assert sorted((q["obs"], q["run"], q["delta"]) for q in near.collect()) == sorted((o, k, p - a) for o, k, a, p, _ in known if abs(p - a) <= tolerance)
    start = fieldcheck.match_by_start(f, r, "at", "pass", "approx", tolerance)
    assert sorted((q["obs"], q["run"], q["delta"]) for q in start.collect()) == sorted((o, k, q - a) for o, k, a, p, q in known if p < a and abs(q - a) < tolerance)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan[plan.index("Join") :].split("\n")[0]


def test_runs_meet_places_instead_of_targets(spark):
    """A thousand stops at four places are four searches of a run; all get their rows, also where a stop has two places."""
    pings = [("f", 1, i, "A", 0, float(i), 0.0, i) for i in range(20)]
    targets = [(s, "A", 0, 5.0 * (s % 4), 1.0) for s in range(1000)]
    t = spark.createDataFrame(targets, "stop_id long, route string, pattern int, x double, y double")
    p = spark.createDataFrame(pings, PINGS)
    search = nearest.Search(t, p, ["stop_id"], ["route", "pattern"], ["filename", "index_run_start"], None)
    assert search.found.count() == 4
    assert sorted((r["stop_id"], r["index_loc"]) for r in search.expand(search.found).collect()) == [(s, 5 * (s % 4)) for s in range(1000)]
    twice = t.unionByName(t.limit(1).selectExpr("stop_id", "route", "pattern", "x + 2.25 as x", "0.0 as y"))
    got = {r["stop_id"]: (r["index_loc"], r["dist_to_nearest_point"]) for r in nearest.nearest_ping(twice, p, ["stop_id"]).collect()}
    assert len(got) == 1000 and nearest.nearest_ping(twice, p, ["stop_id"]).count() == 1000 and got[0] == (2, 0.25)


def test_sets_compared_whole_equal_rings(monkeypatch):
    rng = np.random.default_rng(6)
    for within in (None, 40.0):
        owner, to = np.sort(rng.integers(0, 6, 900)), np.sort(rng.integers(0, 6, 70))
        x, y, tx, ty = np.floor(rng.uniform(0, 300, 900) / 20) * 20, rng.uniform(0, 20, 900) // 5, rng.uniform(-99, 400, 70), rng.uniform(-20, 60, 70)
        rank = rng.permutation(900)
        want = rings.nearest(owner, rank, x, y, to, tx, ty, 6, within)
        for few in (0, 150, 1000):
            monkeypatch.setattr(rings, "FEW_POINTS", few)
            found, d = rings.closest(owner, rank, x, y, to, tx, ty, 6, within)
            assert (found == want[0]).all() and (d == want[1]).all()


def test_many_targets_at_few_places(spark):
    """Places, courses and terminals that many share: compared once, told for each; stops with two places, lines in parts."""
    rng = random.Random(12)
    at = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(7)]
    pings = [(f"f{i % 3}", 1, i, "AB"[i % 3 % 2], 0, rng.uniform(0, 900), rng.uniform(0, 900), i) for i in range(90)]
    targets = [(s, "AB"[s % 2], *at[s % 7]) for s in range(80)] + [(5, "B", *at[0]), (200, "A", None, 1.0)]
    p, t = spark.createDataFrame(pings, PINGS), spark.createDataFrame(targets, "stop_id long, route string, x double, y double")
    far = lambda q, s: math.sqrt((q[5] - s[2]) ** 2 + (q[6] - s[3]) ** 2)
    want, ends = {}, {}
    for q in pings:
        for s in targets:
            if s[2] is not None:
                if far(q, s) <= 250.0:
                    want[q[0], s[0]] = min(want.get((q[0], s[0]), (math.inf, 0)), (far(q, s), q[2]))
                if q[2] < 3 and q[3] == s[1]:
                    ends[q[0]] = min(ends.get(q[0], (math.inf, 0)), (far(q, s), s[0]))
    got = nearest.nearest_within(p.drop("route"), t, ["stop_id"], 250.0).collect()
    assert {(r["filename"], r["stop_id"]): r["index_loc"] for r in got} == {k: v[1] for k, v in want.items()} and len(got) == len(want)
    assert nearest.place_cells(p, t, 1e9, 1e9).count() == 7 * len(pings)
    match = nearest.terminal_match(p.where("index_loc < 3"), t)
    assert {r["filename"]: r["stop_id"] for r in match.collect()} == {k: v[1] for k, v in ends.items()} and "target_x" in match.columns
    courses = [[{"x": x, "y": y} for x, y in rng.sample(at, 3)] for _ in range(3)]
    lines = spark.createDataFrame([(n, "A", courses[n % 3]) for n in range(30)] + [(4, "A", courses[2])], "seg long, route string, points array<struct<x:double,y:double>>")
    near = [(r["index_loc"], r["seg"]) for r in nearest.within_corridor(p, lines, ["seg"], 60.0, on=["route"]).collect()]
    hit = lambda q, c: any(distance_to_edge(q[5], q[6], a["x"], a["y"], b["x"], b["y"]) <= 60.0 for a, b in zip(c, c[1:]))
    assert sorted(near) == sorted((q[2], n) for q in pings if q[3] == "A" for n in range(30) if hit(q, courses[n % 3]) or (n == 4 and hit(q, courses[2])))
