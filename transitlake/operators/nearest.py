"""Nearest-neighbour and within-distance joins between pings and targets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions import rings
from transitlake.functions.geo import distance, edge_distance, line_edges
from transitlake.operators.windows import RUN

CELL_FEET = 500.0
#: Pings of a run, and places of a pattern's targets, that are held in one row.
RUN_PART, TARGET_PART = 1024, 512
#: Pings of a run that is one row.
LONGEST = 65_536
#: Pings and places that are searched at once; a batch of rows is taken in slices of about as many.
SEARCHED = 200_000


def _closest(within: float | None):
    """Column function over arrays of a row's pings (ranks, x, y) and targets (x, y): target, ping and distance."""
    kind = pa.struct([("target", pa.int32()), ("ping", pa.int32()), ("d", pa.float64())])

    @F.arrow_udf("array<struct<target:int,ping:int,d:double>>")
    def find(rank: pa.Array, x: pa.Array, y: pa.Array, tx: pa.Array, ty: pa.Array) -> pa.Array:
        flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
        bounds = lambda a: a.offsets.to_numpy() - a.offsets[0].as_py()

        def some(*part: pa.Array) -> pa.Array:
            rank, x, y, tx, ty = part
            pings, targets = bounds(x), bounds(tx)
            n = len(x)
            owner, to = np.repeat(np.arange(n), np.diff(pings)), np.repeat(np.arange(n), np.diff(targets))
            found, d = rings.closest(owner, flat(rank), flat(x), flat(y), to, flat(tx), flat(ty), n, within)
            there = np.flatnonzero(found >= 0)
            own = to[there]
            rows = pa.StructArray.from_arrays(
                [pa.array((there - targets[own]).astype(np.int32)), pa.array((found[there] - pings[own]).astype(np.int32)), pa.array(d[there])], fields=list(kind)
            )
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32)), rows)

        total = bounds(x) + bounds(tx)
        cuts = [0, *(np.flatnonzero(np.diff(total[1:] // SEARCHED)) + 1).tolist(), len(x)]
        parts = [some(*(v.slice(i, j - i) for v in (rank, x, y, tx, ty))) for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.concat_arrays(parts)

    return find


def gathered(columns: Sequence[str]) -> list[Column]:
    """Aggregates _p_c, a list of structs (v) for each column c, as lists leave out nulls."""
    return [F.collect_list(F.struct(F.col(c).alias("v"))).alias(f"_p_{c}") for c in columns]


def run_rows(pings: DataFrame, on: Sequence[str], keys: Sequence[str] = RUN) -> DataFrame:
    """keys, on and lists as of gathered(): a row for each run, which has one pattern and at most LONGEST pings, or it is an error."""
    several = [c for c in on if c not in keys]
    ends = [f(c).alias(f"_{n}_{c}") for c in several for n, f in (("lo", F.min), ("hi", F.max))]
    rest = [c for c in pings.columns if c not in (*on, *keys)]
    rows = pings.groupBy(*keys).agg(*gathered(rest), *ends)
    one = reduce(and_, [F.col(f"_lo_{c}") == F.col(f"_hi_{c}") for c in several], F.size("_p_index_loc") <= LONGEST)
    index = F.when(one, F.col("_p_index_loc")).otherwise(F.raise_error(F.lit("a run of several patterns or too many pings")).cast(rows.schema["_p_index_loc"].dataType))
    return rows.select(*keys, *(F.col(f"_lo_{c}").alias(c) for c in several), *(index.alias(f"_p_{c}") if c == "index_loc" else F.col(f"_p_{c}") for c in rest))


class Search:
    """Runs against the targets of their pattern, at first for each place of targets only.

    Targets of one place have one nearest ping, so a run meets each place once, however many targets are there.
    ``found`` has a row for each run and place, final for runs of one pattern whose targets differ in their keys.
    For others, with _again, rows are by run and target (_t, else null). ``expand`` gives all rows their targets.
    """

    def __init__(self, targets: DataFrame, pings: DataFrame, target_keys: Sequence[str], on: Sequence[str], keys: Sequence[str], within: float | None, order: Sequence[str] = (), single: bool = False):
        """``order`` adds _first: the least target of each place by these columns.

        ``single``: runs have one pattern each and no more than LONGEST pings, and no two places of a pattern have targets
        of the same keys. Then a run is one row, and what it finds is final: it is neither moved nor sorted. Other input
        is an error.
        """
        self.on = list(on)
        own = targets.where("x is not null and y is not null").withColumnsRenamed({"x": "target_x", "y": "target_y"})
        self.rest = [c for c in own.columns if c not in on]
        self.columns = [*dict.fromkeys([*keys, *target_keys, *on, *pings.columns, *own.columns]), "dist_to_nearest_point"]
        self.named = [c for c in target_keys if c in own.columns]
        own = own.withColumns({"_x": F.col("target_x").cast("double"), "_y": F.col("target_y").cast("double")})
        by, place, pattern = list(dict.fromkeys([*on, *keys])), [*on, "_x", "_y"], Window.partitionBy(*on)
        # Of rows alike in keys and place one stays; _twin: the same keys at several places of a pattern.
        one = F.row_number().over(Window.partitionBy(*dict.fromkeys([*on, *self.named, "_x", "_y"])).orderBy(*self.rest))
        own = own.withColumn("_one", one).where("_one = 1").drop("_one")
        self.targets = own.withColumn("_twin", F.count(F.lit(1)).over(Window.partitionBy(*dict.fromkeys([*on, *self.named]))) > 1)
        first = [F.array_min(F.collect_list(F.struct(*order))).alias("_first")] if order else []
        per = ["_x", "_y", *(["_first"] if order else [])]
        places = self.targets.groupBy(*place).agg(F.bool_or("_twin").alias("_twin"), *first)
        places = places.withColumns({"_n": F.count(F.lit(1)).over(pattern), "_twins": F.bool_or("_twin").over(pattern)})
        dealt = places.withColumn("_chunk", F.pmod(F.xxhash64("_x", "_y"), F.ceil(F.col("_n") / TARGET_PART)))
        sets = dealt.groupBy(*on, "_chunk", "_twins").agg(F.collect_list(F.struct(*per)).alias("_places"))
        sets = sets.select(*on, "_twins", *(F.col(f"_places.{c}").alias(f"_s{c}") for c in per))
        ping_rest = [c for c in pings.columns if c not in by]
        several = [c for c in on if c not in keys]
        placed = pings.where(reduce(and_, [F.col(c).isNotNull() for c in ("x", "y", *several)]))
        # A list for each column, of structs as lists leave out nulls: columns that nobody asks for are not gathered.
        lists = gathered(ping_rest)
        column = lambda c, kind: F.transform(f"_p_{c}", lambda e: e["v"].cast(kind))
        key, nothing = F.struct(*self.named), F.lit(None)
        units = self.targets.select(*place, F.explode(F.array(F.struct(F.lit(True).alias("_again"), key.alias("_t")))).alias("_u"))
        self.key_type = units.schema["_u"].dataType["_t"].dataType

        def search(parts: DataFrame, index: Column) -> DataFrame:
            # Places are few beside pings, which stay where they are.
            hits = parts.join(F.broadcast(sets), self.on).withColumn("_f", _closest(within)(index, column("x", "double"), column("y", "double"), F.col("_s_x"), F.col("_s_y")))
            # Outer, as Spark would work out the column once more to see whether there is anything to explode.
            rows = hits.select("*", F.explode_outer("_f").alias("_e")).where("_e is not null")
            at = [F.col(f"_p_{c}")[F.col("_e.ping")]["v"].alias(c) for c in ping_rest]
            of = [F.col(f"_s{c}")[F.col("_e.target")].alias(c) for c in per]
            return rows.select(*by, "_twins", *at, *of, F.col("_e.d").alias("dist_to_nearest_point"))

        if single:
            rows = search(run_rows(placed, on, keys), F.when(~F.col("_twins"), column("index_loc", "long")).otherwise(F.raise_error(F.lit("a target at several places")).cast("array<long>")))
            self.found = rows.drop("_twins").withColumns({"_again": F.lit(False), "_t": nothing.cast(self.key_type)})
            return
        parts = placed.groupBy(*by, F.floor(F.col("index_loc") / RUN_PART).alias("_part")).agg(*lists).drop("_part")
        rows = search(parts, column("index_loc", "long")).repartition(*keys)
        run = Window.partitionBy(*keys)
        more = [~F.min(c).over(run).eqNullSafe(F.max(c).over(run)) for c in several]
        rows = rows.withColumn("_again", reduce(or_, more, F.col("_twins"))).drop("_twins")
        units = places.select(*place, F.lit(False).alias("_again"), nothing.cast(self.key_type).alias("_t")).unionByName(units.select(*place, "_u.*"))
        rows = rows.join(F.broadcast(units), [*place, "_again"])
        alone = lambda c: F.when(~F.col("_again"), F.col(c))
        best = Window.partitionBy(*keys, "_again", "_t", alone("_x"), alone("_y")).orderBy("dist_to_nearest_point", "index_loc", *place)
        self.found = rows.withColumn("_i", F.row_number().over(best)).where("_i = 1").drop("_i")

    def expand(self, found: DataFrame) -> DataFrame:
        """A row for each target of the places found; columns of ``found`` besides those of the search stay.

        A place's targets are held TARGET_PART to a row and sent to what is found, which is neither moved nor sorted.
        """
        place = [*self.on, "_x", "_y"]
        own = self.targets.drop("_twin").select(*(F.col(c).alias(f"_s_{c}") for c in place), F.struct(*self.named).alias("_st"), F.struct(*self.rest).alias("_own"))
        place = [f"_s_{c}" for c in place]
        n = F.count(F.lit(1)).over(Window.partitionBy(*place))
        dealt = own.withColumn("_chunk", F.pmod(F.xxhash64("_st"), F.ceil(n / TARGET_PART)))
        listed = F.collect_list("_own").alias("_set")
        sets = dealt.groupBy(*place, "_chunk").agg(listed).drop("_chunk").withColumn("_st", F.lit(None).cast(self.key_type))
        sets = sets.unionByName(own.groupBy(*place, "_st").agg(listed))
        same = reduce(and_, [F.col(c[3:]) == F.col(c) for c in place], F.col("_t").eqNullSafe(F.col("_st")))
        kept = [c for c in found.columns if c not in ("_first", "_again", "_x", "_y", "_t")]
        met = found.join(F.broadcast(sets), same).select(*kept, F.explode("_set").alias("_e"))
        rows = met.select(*kept, *(F.col(f"_e.{c}").alias(c) for c in self.rest))
        return rows.select(*self.columns, *(c for c in kept if c not in self.columns))


def nearest_ping(
    targets: DataFrame, pings: DataFrame, target_keys: Sequence[str], on: Sequence[str] = ("route", "pattern"), keys: Sequence[str] = RUN, within: float | None = None, digits: int | None = None, single: bool = False
) -> DataFrame:
    """For each run and target of the run's pattern, its closest ping; ties go to the lowest index_loc.

    Both sides have x and y in feet; a run has one ping for each index_loc. Runs without targets drop out, pings and
    targets without a place take no part. ``within`` leaves out targets with no ping that close. Distances are rounded to
    ``digits`` places where given, before places get their targets. ``single`` as for Search.

    Pings are shuffled once, with the columns that are asked for, and gathered RUN_PART to a row; a row meets the places
    of its pattern's targets TARGET_PART at a time and looks around each of them in rings of grid cells, so that a place
    is compared with the pings near it only. What each part found is brought together by run (with ``single`` a run is one row).
    Places get their targets last, so rows by run and target are neither moved nor sorted.
    """
    s = Search(targets, pings, target_keys, on, keys, within, single=single)
    return s.expand(s.found if digits is None else s.found.withColumn("dist_to_nearest_point", F.round("dist_to_nearest_point", digits)))


def within_cells(points: DataFrame, targets: DataFrame, radius: float, cell: float = CELL_FEET, sent: bool = False) -> DataFrame:
    """Pairs of points and targets no more than ``radius`` apart, joined on grid cells.

    Both sides have x and y. Targets are copied to the cells that their radius reaches, so a point meets each at most
    once. Target columns must not clash with those of points. ``sent`` targets are broadcast.
    """
    own = targets.withColumnsRenamed({"x": "target_x", "y": "target_y"})
    reached = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / cell), F.floor((F.col(c) + radius) / cell)))
    own = own.where("target_x is not null and target_y is not null").withColumn("_cx", reached("target_x")).withColumn("_cy", reached("target_y"))
    dealt = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    d = distance(F.col("x"), F.col("y"), F.col("target_x"), F.col("target_y"))
    return dealt.join(F.broadcast(own) if sent else own, ["_cx", "_cy"]).withColumn("dist", d).where(F.col("dist") <= radius).drop("_cx", "_cy")


def place_cells(points: DataFrame, targets: DataFrame, radius: float, cell: float = CELL_FEET) -> DataFrame:
    """within_cells with the places of targets, _x and _y, once each: a place with many targets is compared once.

    Places are sent to the points, which stay where they are.
    """
    own = targets.where("x is not null and y is not null").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    return within_cells(points, own, radius, cell, sent=True).withColumnsRenamed({"target_x": "_x", "target_y": "_y"})


def at_places(near: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target at the places _x and _y of ``near``.

    A place's targets are held TARGET_PART to a row and sent to ``near``, which is neither moved nor sorted.
    """
    own = targets.where("x is not null and y is not null").withColumnsRenamed({"x": "target_x", "y": "target_y"})
    placed = own.select(F.col("target_x").cast("double").alias("_x"), F.col("target_y").cast("double").alias("_y"), F.struct(*own.columns).alias("_own"))
    n = F.count(F.lit(1)).over(Window.partitionBy("_x", "_y"))
    dealt = placed.withColumn("_chunk", F.pmod(F.xxhash64("_own"), F.ceil(n / TARGET_PART)))
    sets = dealt.groupBy("_x", "_y", "_chunk").agg(F.collect_list("_own").alias("_set")).drop("_chunk")
    rest = [c for c in near.columns if c not in ("_x", "_y")]
    met = near.join(F.broadcast(sets), ["_x", "_y"]).select(*rest, F.explode("_set").alias("_e"))
    return met.select(*rest, *(F.col(f"_e.{c}").alias(c) for c in own.columns))


def nearest_within(points: DataFrame, targets: DataFrame, target_keys: Sequence[str], radius: float, keys: Sequence[str] = RUN, digits: int | None = None) -> DataFrame:
    """The closest point of each run to each target, where one lies within the radius; ``digits`` as in nearest_ping.

    Found by place; only targets with the same keys at several places are compared once more, by run and target. Points
    are brought together by run before they meet places, so that pairs of a point and a place are not moved.
    """
    least = lambda df, *by: df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, *by).orderBy("dist", "index_loc"))).where("_i = 1").drop("_i")
    rounded = lambda df: df if digits is None else df.withColumn("dist", F.round("dist", digits))
    near = least(place_cells(points.repartition(*keys), targets, radius), "_x", "_y")
    told = targets.where("x is not null and y is not null").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*target_keys)))
    one, several = (told.where(c).drop("_n") for c in ("_n = 1", "_n > 1"))
    return at_places(rounded(near), one).unionByName(rounded(least(at_places(near, several), *target_keys)))


def edge_cells(lines: DataFrame, keys: Sequence[str], radius: float, cell: float = CELL_FEET) -> DataFrame:
    """keys, _cx, _cy, _edges: the cells that come within ``radius`` of a line, each with the edges that do so.

    lines: keys and points (array of x, y). An edge covers, column of cells by column, the rows it passes there and a
    radius more to each side, so a long edge has about as many cells as its length and none beside it.
    """
    edges = lines.select(*keys, F.explode(line_edges(F.col("points"))).alias("_e"))
    a, b = F.col("_e.a"), F.col("_e.b")
    low, high = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
    columns = edges.withColumn("_cx", F.explode(F.sequence(F.floor((low - radius) / cell), F.floor((high + radius) / cell))))
    # The edge's part above the column, widened by the radius.
    left, right = F.greatest(low, F.col("_cx") * cell - radius), F.least(high, (F.col("_cx") + 1) * cell + radius)
    dx = b["x"] - a["x"]
    at = lambda x: a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / dx
    steep = F.abs(dx) < 1e-6
    y1, y2 = F.when(steep, a["y"]).otherwise(at(left)), F.when(steep, b["y"]).otherwise(at(right))
    spare = radius + cell * 1e-6  # more than rounding can take away
    rows = F.explode(F.sequence(F.floor((F.least(y1, y2) - spare) / cell), F.floor((F.greatest(y1, y2) + spare) / cell)))
    return columns.withColumn("_cy", rows).groupBy(*keys, "_cx", "_cy").agg(F.collect_list("_e").alias("_edges"))


def within_corridor(points: DataFrame, lines: DataFrame, line_keys: Sequence[str], radius: float, on: Sequence[str] = (), cell: float = CELL_FEET) -> DataFrame:
    """Points no more than ``radius`` from a line, once for each line, joined on grid cells (and ``on``).

    points have x and y. lines: on, line_keys and points. A cell has a line's edges in one row, and a point lies in one
    cell, so it meets a line once and only the edges that pass near. Lines of one course are compared once, by the least
    of their keys, and get their rows from what is found.
    """
    own = lines.groupBy(*on, *line_keys).agg(F.sort_array(F.collect_list("points")).alias("_course")).withColumn("_key", F.struct(*line_keys))
    own = own.withColumn("_line", F.min("_key").over(Window.partitionBy(*on, "_course")))
    courses = own.where(F.col("_key") == F.col("_line")).select(*on, "_line", F.explode("_course").alias("points"))
    index = edge_cells(courses, [*on, "_line"], radius, cell)
    dealt = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    met = dealt.join(index, [*on, "_cx", "_cy"])
    near = F.exists("_edges", lambda e: edge_distance(F.col("x"), F.col("y"), e) <= radius)
    found = met.where(near).drop("_cx", "_cy", "_edges")
    return found.join(own.select(*on, *line_keys, "_line"), [*on, "_line"]).drop("_line")


def terminal_match(ends: DataFrame, terminals: DataFrame) -> DataFrame:
    """For each row of ends (a run's first or last ping), the closest terminal of its route.

    Of terminals at one place the one of the least stop_id stands for all; an end meets those of its route TARGET_PART at a
    time, in one row, so no pairs are sorted.
    """
    own = terminals.withColumnsRenamed({"x": "target_x", "y": "target_y"})
    rest = [c for c in own.columns if c != "route"]
    route, place = Window.partitionBy("route"), Window.partitionBy("route", "target_x", "target_y")
    own = own.withColumn("_i", F.row_number().over(place.orderBy("stop_id"))).where("_i = 1").drop("_i")
    dealt = own.withColumn("_chunk", F.pmod(F.xxhash64("target_x", "target_y"), F.ceil(F.count(F.lit(1)).over(route) / TARGET_PART)))
    sets = dealt.groupBy("route", "_chunk").agg(F.collect_list(F.struct(*rest)).alias("_set")).drop("_chunk")
    d = lambda t: distance(F.col("x"), F.col("y"), t["target_x"], t["target_y"])
    # Ends or terminals without a place come last, as in SQL.
    least = F.array_min(F.transform("_set", lambda t: F.struct(F.coalesce(d(t), F.lit(float("nan"))).alias("d"), t["stop_id"].alias("stop_id"), t.alias("t"))))
    met = ends.join(F.broadcast(sets), "route").withColumn("_b", least).drop("_set")
    w = Window.partitionBy(*RUN).orderBy("_b.d", "_b.stop_id")
    best = met.withColumn("_i", F.row_number().over(w)).where("_i = 1")
    return best.select(*ends.columns, *(F.col(f"_b.t.{c}").alias(c) for c in rest), d(F.col("_b.t")).alias("dist"))
