"""Runs and pings of random logs against their rules worked by hand, and how often a file's lines are sorted."""

import os
import random

import pytest

from transitlake.operators import runs
from transitlake.plans import catalog

SF = "/root/testdata/sf0.001"
LINES = {
    "tag": "   A01,1234,10/01/19,08:00:{:02d},11111,05280",
    "end": "/ 09:00:{:02d} Buswares navigation reported end of route",
    "ping": "38.9,-77.{:02d},90,O,M,10,20,08,   ,9,38.9,-77.0",
    "apc": "apc,55,{},1,21,0,0",
    "bad": "98.9,-77.{:02d},90,O,M,10,20,08,   ,9,38.9,-77.0",
    "long": "1,2,3,4,5,6,7,8,9,10,11,12,{}",
    "": "",
}


def by_hand(kinds):
    """(runs, pings) of a file's kinds of lines."""
    tags = [i for i, k in enumerate(kinds) if k == "tag"]
    if not tags:
        return [], []
    at = lambda i: None if i is None else i - tags[0] - 1
    least, most = lambda v: min(v, default=None), lambda v: max(v, default=None)
    whole = "long" not in kinds[tags[0] :]
    places = [i for i, k in enumerate(kinds) if k == "ping" and i > tags[0]] if whole else []
    found, told = {}, []
    for t, following in zip(tags, [*tags[1:], None], strict=True):
        group = range(t, following if following is not None else len(kinds))
        message = least(i for i in group if kinds[i] == "end")
        end = message if message is not None else following if following is not None else len(kinds) - 1
        clock = f"09:00:{message + 1:02d}" if message is not None else f"08:00:{following + 1:02d}" if following is not None else None
        first, last = least(p for p in places if p >= t), most(p for p in places if p <= end)
        found[first] = (at(t), at(end), clock, at(first), at(last))
        own = [p for p in places if p in group]
        for p in own:
            later = next((k for k in kinds[p + 1 :] if k in ("apc", "ping")), None)
            told.append((at(p), at(own[0]) if p <= end else None, at(most(q for q in own if q <= end)) if p <= end else None, later == "apc"))
    return list(found.values()), told


@pytest.mark.parametrize("seed", range(2))
def test_runs_and_pings_of_random_logs(spark, seed):
    rng = random.Random(seed)
    rows, expected_runs, expected_pings = [], [], []
    for f in range(60):
        weights = [4, 3, 8, 3, 1, 0.3, 2]
        kinds = rng.choices(list(LINES), weights, k=rng.randint(1, 40))
        name = f"rawnav{f:05d}191001.txt"
        rows += [(name, i + 1, LINES[k].format(i + 1)) for i, k in enumerate(kinds)]
        found, told = by_hand(kinds)
        expected_runs += [(name, *r) for r in found]
        expected_pings += [(name, *r) for r in told]
    lines = spark.createDataFrame(rows, "filename string, line_num long, line string").repartition(3)
    pings, summary = runs.clean_pings(lines)
    got = summary.select("filename", "index_run_start_original", "index_run_end_original", "run_end_time", "index_run_start", "index_run_end")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected_runs, key=str)
    got = pings.select("filename", "index_loc", "index_run_start", "index_run_end", "row_before_apc")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected_pings, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name, sorts", [("run_bounds", 3), ("run_summary", 4), ("valid_pings", 3), ("apc_flags", 3), ("run_dividers", 4)])
def test_lines_of_a_file_are_sorted_twice(spark, name, sorts):
    """The view over events sorts once, a file's lines are sorted forwards and backwards; runs and pings are put in order once."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("- Sort [" in line for line in plan.splitlines()) <= sorts
