"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from transitlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    found = db.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


@needs_data
def test_all_others_run(spark):
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, SF).count() > 0


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["seg_name_id", "percentile", "fps", "mph"]


@needs_data
def test_one_exchange_for_the_windows_of_a_run(spark):
    from pyspark.sql import functions as F

    from transitlake.operators.windows import change_id, fill, rolling_speeds

    p = spark.createDataFrame([("a", 1, i, i, i, "O") for i in range(9)], "filename string, index_run_start long, index_loc long, odom_ft long, sec_past_st long, door_state string")
    df = rolling_speeds(p).withColumn("id", change_id(F.col("door_state"))).withColumn("f", fill(F.col("fps_next")))
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


@needs_data
@pytest.mark.parametrize("name, exchanges, scans", [("run_bounds", 2, 1), ("run_summary", 2, 1), ("travel_time_decomposition", 11, 6), ("nearest_stops", 4, 2)])
def test_plans_stay_small(spark, name, exchanges, scans):
    """What runs: the view over events takes one exchange of its own, by user; runs take one more, by file.

    Shuffles and scans that Spark runs once and uses again count once.
    """
    df = catalog.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    ran = [line for line in plan if "ReusedExchange" not in line]
    assert sum("Exchange hashpartitioning" in line for line in ran) <= exchanges
    assert sum("FileScan parquet" in line for line in ran) <= scans and not any("SortAggregate" in line for line in ran)


@needs_data
@pytest.mark.parametrize("name", ["segment_index", "segment_summary", "terminal_trim", "stop_summary"])
def test_nearest_pings_need_no_sort_of_pairs(spark, name):
    assert "SortAggregate" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_every_query_has_rows(spark):
    """Empty would equal empty."""
    empty = [n for n in ("long_enough_runs", "segment_quality", "corridor_pings", "run_traces", "signed_trajectories") if catalog.QUERIES[n](spark, SF).isEmpty()]
    assert not empty
