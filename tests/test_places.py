"""Clean-ups that are told by place, before stops get rows, against the same rules on rows by run and stop."""

import random

import pytest

from transitlake.operators import gtfs, nearest, stops
from transitlake.plans import catalog

SF = "/root/testdata/sf0.01"
PINGS = "filename string, index_run_start long, index_loc long, route long, pattern long, x double, y double"
STOPS = "stop_id long, stop_sort_order long, stop_sequence long, signature string, route long, pattern long, x double, y double"


def pings(spark, rng, two_routes=False):
    """Runs along a line, some of them backwards, some that turn."""
    rows = []
    for r in range(30):
        way = [1, -1, 0][r % 5 % 3]
        for i in range(40):
            at = i if way > 0 else 39 - i if way < 0 else min(i, 39 - i)
            rows.append((f"f{r % 4}", 1000 * r + 1, 1000 * r + 1 + i, int(two_routes and i > 20), r % 2, 25.0 * at + rng.uniform(-9, 9), rng.uniform(-40, 40)))
    return spark.createDataFrame(rows, PINGS)


def targets(spark, rng, kind):
    rows = []
    for pattern in (0, 1):
        for i in range(10):
            for copy in range(4 if kind == "one place" and i % 3 == 0 else 1):
                sequence = i // 2 if kind == "shared" else i * 10 + copy
                stop = i * 10 + copy if kind != "twins" else i // 2
                sort = i * 10 + copy if kind != "twins" else i // 2
                rows.append((stop, sort, sequence, f"s{i % 2}", pattern if kind == "two routes" else 0, pattern, 100.0 * i, 20.0 * rng.randint(-1, 1) if copy == 0 else rows[-1][-1]))
    return spark.createDataFrame(rows, STOPS)


def told(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


KINDS = ["plain", "one place", "shared", "twins", "two routes"]


@pytest.mark.parametrize("part", [16, 1024])
@pytest.mark.parametrize("kind", KINDS)
def test_stops_of_runs_in_order(spark, monkeypatch, kind, part):
    monkeypatch.setattr(nearest, "RUN_PART", part)
    rng = random.Random(KINDS.index(kind))
    p, t = pings(spark, rng, kind == "two routes"), targets(spark, rng, kind)
    t = t.drop("stop_sort_order", "pattern") if kind == "two routes" else t.where("pattern = 0").drop("stop_sort_order", "pattern")
    columns = ["filename", "index_run_start", "stop_id", "stop_sequence", "index_loc", "dist_to_nearest_point"]
    for by_signature in (False, True):
        whole = gtfs.stops_on_route(gtfs.nearest_gtfs_stop(t, p, by_signature), 60.0)
        expected = told(whole, columns)
        assert told(gtfs.route_stops(t, p, 60.0, by_signature), columns) == expected
        assert expected or kind != "plain"


@pytest.mark.parametrize("part", [16, 1024])
@pytest.mark.parametrize("kind", KINDS)
def test_falling_stops(spark, monkeypatch, kind, part):
    monkeypatch.setattr(nearest, "RUN_PART", part)
    rng = random.Random(KINDS.index(kind))
    p, t = pings(spark, rng, kind == "two routes"), targets(spark, rng, kind).drop("stop_sequence", "signature")
    near = nearest.nearest_ping(t, p, ["stop_id", "stop_sort_order"]).where("dist_to_nearest_point < 60")
    columns = ["filename", "index_run_start", "stop_id", "stop_sort_order", "index_loc", "index_loc_before"]
    expected = told(stops.order_violations(near), columns)
    assert expected and told(stops.nearest_violations(p, t, 60.0), columns) == expected


@pytest.mark.parametrize("name, module, step", [("gtfs_stops_on_route", gtfs, "stops_on_route"), ("order_violations", stops, "order_violations")])
def test_stops_of_one_place_are_not_sorted_by_run(spark, monkeypatch, name, module, step):
    """With twenty stops at each place, no more rows by run and stop are put in order than there are pings."""
    once, sorted_rows, original = catalog.V.suppliers, [], getattr(module, step)

    def many(spark, sf_dir):
        return once(spark, sf_dir).selectExpr("explode(sequence(0, 19)) as c", "*").selectExpr("stop_id + 6000 * c as stop_id", "route", "pattern", "x", "y", "stop_sort_order + 100 * c as stop_sort_order")

    def watched(index, *more):
        sorted_rows.append(index.count())
        return original(index, *more)

    monkeypatch.setattr(catalog.V, "suppliers", many)
    monkeypatch.setattr(module, step, watched)
    catalog.QUERIES[name](spark, SF).collect()
    assert sorted_rows and sorted_rows[0] <= catalog.V.pings(spark, SF).count()
