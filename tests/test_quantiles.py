"""Exact quantiles against Spark's percentile, and what their steps hold."""

import pytest
from pyspark.sql import functions as F

from transitlake.operators import decompose, quality, quantiles

AT = (0.0, 0.01, 0.05, 0.25, 0.5, 0.85, 0.95, 1.0)


def both(df, by, accuracy=quantiles.ACCURACY):
    own = {tuple(r[k] for k in by): (r["n"], r["quantiles"]) for r in quantiles.exact_quantiles(df, by, "v", AT, accuracy).collect()}
    told = df.groupBy(*by).agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, AT))).alias("q"))
    return own, {tuple(r[k] for k in by): (r["n"], r["q"]) for r in told.collect()}


@pytest.fixture(scope="module")
def rows(spark):
    n = spark.range(30_000).withColumn("r", F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0)
    hot = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string")))
    v = F.when(F.col("id") % 7 == 0, 5.0).when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 50 == 1, -F.col("r")).otherwise(F.col("r") * F.col("r"))
    v = F.when(F.col("id") == 9, F.lit(float("inf"))).when(F.col("id") == 12, F.lit(float("-inf"))).otherwise(v)
    df = n.select(hot.alias("g"), (F.col("id") % 2).alias("h"), v.alias("v"))
    odd = spark.createDataFrame([("none", 0, None), ("none", 0, None), ("one", 1, 4.0), ("same", 0, 2.0), ("same", 0, 2.0), ("two", 0, 1.0), ("two", 0, 2.0)], "g string, h long, v double")
    return df.unionByName(odd)


@pytest.mark.parametrize("accuracy", [10_000, 100, 20])
def test_equal_to_percentile(rows, accuracy):
    """Narrow and wide bounds; hot and null keys, ties, infinities, groups of nulls."""
    own, told = both(rows, ["g", "h"], accuracy)
    assert own == told and len(own) > 40


def test_one_group_with_all_rows(rows):
    own, told = both(rows.withColumn("g", F.lit("all")), ["g"], 1000)
    assert own == told


def test_little_is_put_in_order(spark, monkeypatch):
    """Of 200,000 distinct values of one group only those near the wanted ranks go through the window."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.exp(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e8).alias("v"))
    low, high = quantiles._bounds([0.5, 0.95], 1000)
    b = df.withColumnRenamed("v", "_v").agg(F.array(*low).alias("l"), F.array(*high).alias("h")).first()
    near = df.where(" or ".join(f"v between {x!r} and {y!r}" for x, y in zip(b["l"], b["h"]))).count()
    assert 0 < near < 200_000 * 2 * 4 * quantiles.MARGIN / 1000
    own, told = both(df, ["g"], 1000)
    assert own == told


def test_empty(spark, rows):
    assert quantiles.exact_quantiles(rows.limit(0), ["g"], "v", AT).count() == 0


def test_bounded_plans_hold_no_segment(spark):
    p = spark.createDataFrame([], "filename string, index_run_start long, index_loc long, odom_ft long, sec_past_st long, door_state string, veh_state string, stop_window string")
    summary = spark.createDataFrame([], "filename string, index_run_start long, seg_name_id string, start_index_loc_segment long, end_index_loc_segment long")
    stops = spark.createDataFrame([], "filename string, index_run_start long, seg_name_id string, stop_id long, odom_ft_stop long")
    for df in (decompose.freeflow(p, summary, bounded=True), decompose.travel_times(p, summary, stops, bounded=True)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        # Windows over a run, and the running sum of what was counted near the wanted ranks.
        assert windows and all("filename" in line or "sum(_n" in line for line in windows)
        assert " percentile(" not in plan


def test_report_in_one_scan(spark, tmp_path):
    """The same tables as those made one by one, from one reading of pings."""
    import random

    rng = random.Random(4)
    made = []
    for run in range(6):
        odom = sec = 0
        for i in range(50):
            odom, sec = odom + rng.choice([0, 0, 40, 90]), sec + rng.choice([0, 1, 5])
            place = (None, None) if rng.random() < 0.1 else (0.0, -77.0) if rng.random() < 0.1 else (38.9 + i / 1e4, -77.0)
            made.append((f"f{run % 2}", run, i, None if rng.random() < 0.05 else odom, sec, rng.choice("MS"), rng.choice("CO"), rng.choice([None, "E01"]), *place, float(i * 10), float(run), "A" if run % 2 else None))
    schema = "filename string, index_run_start long, index_loc long, odom_ft long, sec_past_st long, veh_state string, door_state string, stop_window string, lat double, long double, x double, y double, route string"
    path = str(tmp_path / "pings")
    spark.createDataFrame(made, schema).write.parquet(path)
    p = spark.read.parquet(path)
    runs = p.select("route", F.lit(1).alias("pattern")).distinct()
    tables = quality.quality_report(p, runs, str(tmp_path / "report"))
    single = {
        "state_crosstab": quality.state_crosstab(p),
        "state_changes": quality.state_changes(p),
        "stopped_in_window_share": quality.stopped_in_window_share(p),
        "completeness": quality.completeness(p, quality.COUNTED, quality.RUN),
        "gps_odo_gap": quality.gps_odo_gap(p),
        "usable_runs": quality.usable_runs(runs),
    }
    assert set(tables) == set(single)
    for name, df in single.items():
        columns = df.columns
        assert sorted(map(str, map(tuple, tables[name].select(*columns).collect()))) == sorted(map(str, map(tuple, df.collect()))), name
    plan = quality.report_rows(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 2


def test_observations_come_with_the_writing(spark, tmp_path):
    p = spark.createDataFrame([(1.0, 0.0, 1, None), (None, 2.0, None, 2)], "lat double, long double, odom_ft long, sec_past_st long")
    same, seen = quality.observed(p, "stage")
    same.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"n": 2, "null_lat": 1, "null_long": 0, "null_odom_ft": 1, "null_sec_past_st": 1, "zero_place": 1}


def test_funnel_in_one_scan(spark):
    from transitlake.operators import fieldcheck

    rows = spark.createDataFrame([("f", 1, 5), ("f", 1, 50), ("f", 2, 5), ("g", 1, 50), ("g", 3, None)], "filename string, index_run_start long, v long")
    conditions = {"all": F.lit(True), "known": F.col("v").isNotNull(), "large": F.col("v") > 10, "odd": F.col("index_run_start") % 2 == 1}
    own = fieldcheck.funnel(rows, conditions)
    stages, left = {}, rows
    for name, c in conditions.items():
        left = left.where(c)
        stages[name] = left
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, fieldcheck.filter_funnel(stages).collect())) == [("00_all", 4), ("01_known", 3), ("02_large", 2), ("03_odd", 2)]
    assert own._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") <= 2
