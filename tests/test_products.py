"""Queries whose results are products of two tables: rows by run and target are made last, neither moved nor sorted."""

import random

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from transitlake.operators import nearest
from transitlake.plans import catalog, chains, views  # noqa: F401

SF = "/root/testdata/sf0.001"
COPIES = 7


@pytest.fixture
def many(monkeypatch):
    """Suppliers seven times, with keys shifted by 3000: the same places and patterns."""
    once = views.table

    def table(spark, sf_dir, name):
        df = once(spark, sf_dir, name)
        return df if name != "supplier" else df.selectExpr(f"explode(sequence(0, {COPIES - 1})) as k", "*").selectExpr("s_suppkey + 3000 * k as s_suppkey", "s_name", "s_nationkey", "s_acctbal")

    monkeypatch.setattr(views, "table", table)


def sql_rows(name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{SF}/events.parquet'")
    c.execute(f"create view supplier as select * replace (s_suppkey + 3000 * k as s_suppkey) from '{SF}/supplier.parquet', range({COPIES}) r(k)")
    found = c.execute(catalog.SQL[name])
    return [d[0] for d in found.description], found.fetchall()


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def same_as_sql(df, name):
    names, rows = sql_rows(name)
    assert sorted(names) == sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str)
    assert rows and mine == sorted((tuple(map(plain, r)) for r in rows), key=str)


def joins(df, spark):
    """The plan, without broadcasts by size."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def unsized(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["nearest_stops", "gtfs_nearest_stops", "gtfs_signature_stops"])
def test_what_a_run_finds_is_not_moved(unsized, many, name):
    """However large the table of stops: places come to the runs, and a run's results leave the task last."""
    df = catalog.QUERIES[name](unsized, SF)
    plan = joins(df, unsized)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning(filename") == 1
    same_as_sql(df, name)


@pytest.mark.parametrize("name, moved", [("intersections_within_distance", 0), ("nearest_intersection_pings", 2)])
def test_pairs_of_pings_and_places_are_not_moved(unsized, many, name, moved):
    """Only pings are, by run where a run's closest is asked for; the second time is the same shuffle, for shared keys."""
    df = catalog.QUERIES[name](unsized, SF)
    plan = joins(df, unsized)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning(filename") == moved and "Exchange hashpartitioning(_cx" not in plan
    same_as_sql(df, name)


PINGS = "filename string, index_run_start long, index_loc long, route long, pattern long, x double, y double"


def test_runs_of_one_row(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"f{r % 3}", r, i, r % 2, r % 3, None if i % 13 == 0 else rng.uniform(0, 900), rng.uniform(0, 900)) for r in range(8) for i in range(300 if r == 4 else 30)]
    p = spark.createDataFrame([*rows, ("f9", 1, 1, None, 1, 1.0, 1.0)], PINGS)
    places = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(5)]
    t = spark.createDataFrame([(s, s % 2, s % 3, *places[s % 5]) for s in range(60)] + [(90, None, 1, 1.0, 1.0)], "stop_id long, route long, pattern long, x double, y double")
    told = lambda df: sorted(map(tuple, df.collect()))
    monkeypatch.setattr(nearest, "TARGET_PART", 3)
    for within in (None, 120.0):
        expected = told(nearest.nearest_ping(t, p, ["stop_id"], within=within))
        assert expected and told(nearest.nearest_ping(t, p, ["stop_id"], within=within, single=True)) == expected
    monkeypatch.setattr(nearest, "LONGEST", 100)
    twice = spark.createDataFrame([(1, 0, 0, 1.0, 1.0), (1, 0, 0, 2.0, 2.0)], t.schema)
    two = spark.createDataFrame([("f0", 0, 0, 0, 0, 1.0, 1.0), ("f0", 0, 1, 1, 1, 1.0, 1.0)], PINGS)
    for targets, pings in ((t, p), (twice, p.where("index_run_start = 0")), (t, two)):
        with pytest.raises(PySparkException, match="several"):
            nearest.nearest_ping(targets, pings, ["stop_id"], single=True).collect()


@pytest.mark.parametrize("name", ["segment_index", "segment_summary", "segment_quality", "merge_segments"])
def test_segments_of_a_run_are_found_in_its_row(unsized, many, name):
    df = catalog.QUERIES[name](unsized, SF)
    # Of runs: pings, and for merge_segments the list of runs, made unique and joined.
    assert "Sort [filename" not in joins(df, unsized) or name == "merge_segments"
    assert joins(df, unsized).count("Exchange hashpartitioning(filename") <= (4 if name == "merge_segments" else 1)
    same_as_sql(df, name)


def test_segments_of_odd_runs(spark):
    """What runs of one row give is what rows by run and segment give: nulls, falling counters, equal ends, one ping."""
    from transitlake.operators import segments

    rng = random.Random(8)
    some = lambda v: None if rng.random() < 0.2 else v
    rows = [(f"f{r % 3}", r, 7 * i, r % 2, r % 3 % 2, some(rng.uniform(0, 900)), rng.uniform(0, 900), some(rng.randint(0, 50)), some(i), some(rng.random()), some(rng.random())) for r in range(9) for i in rng.sample(range(40), 1 + 4 * r)]
    rows += [("f8", 1, i, 1, 1, None, 1.0, i, i, 1.0, 1.0) for i in range(3)]
    p = spark.createDataFrame(rows, "filename string, index_run_start long, index_loc long, route long, pattern long, x double, y double, odom_ft long, sec_past_st long, lat double, long double")
    places = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(4)]
    ends = spark.createDataFrame([(f"s{n}", at, *places[(n + j) % 4]) for n in range(24) for j, at in enumerate(("first", "last"))] + [("s30", "first", *places[0]), ("s31", "first", None, 1.0), ("s31", "last", *places[1])], "seg_name_id string, location string, x double, y double")
    patterns = spark.createDataFrame([(r, r % 2, f"s{n}") for n in [*range(24), 30, 31] for r in range(n % 3 + 1)], "route long, pattern long, seg_name_id string")
    lengths = spark.createDataFrame([(f"s{n}", 30.0 * (n % 5)) for n in range(20)], "seg_name_id string, length_ft double")
    index = segments.segment_index(p, ends, patterns, 300.0)
    told = lambda df, like: sorted((tuple(r) for r in df.select(*like.columns).collect()), key=str)
    own = segments.segment_index(p, ends, patterns, 300.0, single=True)
    assert sorted(own.columns) == sorted(index.columns) and told(own, index) == told(index, index)
    summary = segments.segment_summary(p, index, lengths, 20.0)
    mine = segments.run_segments(p, ends, patterns, lengths, 300.0, 20.0)
    assert dict(mine.dtypes) == dict(summary.dtypes) and summary.count() > 50
    assert told(mine, summary) == told(summary, summary)
    assert told(segments.run_segments(p, ends, patterns, lengths, 300.0, 20.0, kept=segments.quality()), summary) == told(summary.where(segments.quality()), summary)
    runs = p.select("filename", "index_run_start", "route").distinct().withColumn("bus", F.lit(5))
    both = [segments.run_segments(p, ends, patterns, lengths, 300.0, 20.0, runs=runs), summary.join(runs, ["filename", "index_run_start"], "left")]
    assert told(both[0], both[1]) == told(both[1], both[1])


def test_members_of_a_center_are_read_from_their_buffers():
    """op7's local join makes no Python object of a member: it takes less than making them alone."""
    import time

    import numpy as np
    import pyarrow as pa

    from transitlake.llm.neighbours import _local_join, _rows

    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((900, 16)).astype(np.float32)
    members = [[{"member": int(i), "new": not j, "packed": vectors[i].tobytes(), "floor": 0.0} for j, i in enumerate(draw.integers(0, 900, 90))] for _ in range(400)]
    kind = pa.list_(pa.struct([("member", pa.int64()), ("new", pa.bool_()), ("packed", pa.binary()), ("floor", pa.float64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([[], members[0][:1], *members], kind)], ["members"])
    found = {}
    for edges in _local_join([batch.slice(3)], 16, 500):
        for a, b, score in zip(*(c.to_pylist() for c in edges.columns), strict=True):
            found[a, b] = score
    expected = {}
    for center in members[1:]:
        new = {m["member"] for m in center if m["new"]}
        for a in {m["member"] for m in center}:
            for b in {m["member"] for m in center} - {a}:
                score = float(vectors[a].astype(float) @ vectors[b].astype(float))
                if (a in new or b in new) and score > 0:
                    expected[a, b] = score
    assert found.keys() == expected.keys() and all(abs(found[e] - expected[e]) < 1e-9 for e in found)
    assert (_rows(pa.array([v.tobytes() for v in vectors]).slice(5, 9), 16) == vectors[5:14]).all() and _rows(pa.array([], pa.binary()), 16).shape == (0, 16)

    def least(work):
        times = []
        for _ in range(3):
            at = time.perf_counter()
            work()
            times.append(time.perf_counter() - at)
        return min(times)

    assert least(lambda: list(_local_join([batch], 16, 10))) < least(lambda: batch.column("members").to_pylist())
