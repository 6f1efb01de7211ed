"""From log lines to tags, run bounds, pings and run summaries.

Lines are (filename, line_num, line), numbered from 1 in each file. Everything below is grouped by file, so all as-of
joins and windows share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions.geo import planar_metres
from transitlake.functions.values import FEET_A_MILE, MILES_A_METRE, extract, is_numeric, safe_div, tag_timestamp, weekday
from transitlake.operators.windows import ahead, from_here, keep_last, over, so_far

# Formats of log lines.
TAG = r"^\s*(\S+),(\d{1,5}),(\d{2}/\d{2}/\d{2}),(\d{2}:\d{2}:\d{2}),(\S+),(\S+)"
END = r"(?i)^\s*/\s*(\d{2}:\d{2}:\d{2})\s*(Buswares navigation reported end of route|Buswares is now using route zero)"
ROUTE_PATTERN = r"^(?:\s*)(?:(?!PO))(?:(?!PI))(?:(?!DH))(\S+)(\d{2})$"
FILE_NAME = r"rawnav(\d{5})(\d{6})\.txt"

PING_FIELDS = ("lat", "long", "heading", "door_state", "veh_state", "odom_ft", "sec_past_st", "sat_cnt", "stop_window", "blank", "lat_raw", "long_raw")


def file_fields(name: Column) -> dict[str, Column]:
    """file_busid and file_id from a log's file name."""
    return {"file_busid": extract(name, FILE_NAME, 1).cast("long"), "file_id": extract(name, r"(\d{11})\.txt", 1)}


def _tag_columns(line: Column) -> dict[str, Column]:
    """What a tag line says."""
    part = lambda i: F.trim(F.regexp_extract(line, TAG, i))
    stamp = tag_timestamp(part(3), part(4))
    return {
        "taglist": F.trim(line),
        "route_pattern": part(1),
        "route": extract(part(1), ROUTE_PATTERN, 1),
        "pattern": extract(part(1), ROUTE_PATTERN, 2),
        "tag_busid": part(2).cast("long"),
        "tag_date": F.to_date(stamp),
        "tag_time": part(4),
        "tag_datetime": stamp,
        "tag_starthour": F.hour(stamp),
        "wday": weekday(stamp),
        "unk1": part(5),
        "mi_to_ft": part(6),
    }


INVENTORY = ("taglist", "line_num", "line_num_next", "route_pattern", "route", "pattern", "tag_busid", "tag_date", "tag_time", "tag_datetime", "tag_starthour", "wday", "unk1", "mi_to_ft")


def tag_inventory(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A row for each tag; files without one (empty, unreadable) keep one row of nulls."""
    found = lines.where(F.col("line").rlike(TAG))
    number = {"line_num": F.col("line_num").cast("long"), "line_num_next": F.lead("line_num").over(over(["filename"], ["line_num"])).cast("long")}
    told = {**_tag_columns(F.col("line")), **number}
    tags = found.select("filename", *(told[c].alias(c) for c in INVENTORY))
    every = (files if files is not None else lines.select("filename").distinct()).select("filename")
    return every.join(tags, "filename", "left").withColumns(file_fields(F.col("filename")))


def analysis_files(inventory: DataFrame, routes: Sequence[str]) -> DataFrame:
    """All tags of the files that have a tag of one of the routes."""
    hit = F.bool_or(F.coalesce(F.col("route").isin(*routes), F.lit(False))).over(Window.partitionBy("filename"))
    return inventory.withColumn("_hit", hit).where("_hit").drop("_hit")


def file_rows(lines: DataFrame, inventory: DataFrame | None = None, fields: Sequence[str] = ()) -> DataFrame:
    """Lines from each file's first tag on: kind, index_loc (line number - first tag line - 1), and where their run ends.

    A file is sorted twice, forwards and backwards, and all is read by running windows. An end message belongs to the latest
    tag at or before it, the first one counts. Tags without one end at the next tag; the last ends at the file's last
    place, with no time. With an inventory only its files are read. ``run_end`` and ``run_end_time`` are those of the run for
    tags and for rows no end message of the run stands before; ``ended`` says where one does. Only tags keep their line.

    With ``fields`` also ping (index_loc and these fields, typed; null in other rows), first_ping (the first at or behind the
    row), last_ping (the last at or before the run's end) and row_before_apc. Files with a row of too many fields have no
    pings. Lines are parsed before they are moved, so only what is asked for is sorted.
    """
    own = lines.select("filename", F.col("line_num").cast("long").alias("line_num"), "line")
    if inventory is not None:
        own = own.join(inventory.where("line_num is not null").select("filename").distinct(), "filename", "left_semi")
    line, number = F.col("line"), F.col("line_num")
    own = own.withColumn("kind", F.when(line.rlike(TAG), "tag").when(line.rlike(END), "end"))
    is_tag, is_end = F.col("kind") == "tag", F.col("kind") == "end"
    time = F.when(is_tag, F.regexp_extract(line, TAG, 4)).when(is_end, F.regexp_extract(line, END, 1))
    own = own.select("filename", "line_num", "kind", F.when(is_tag, line).alias("line"), time.alias("_time"), *_parsed(fields))
    told = so_far(["filename"], ["line_num"])
    last = lambda c: F.last(c, ignorenulls=True)
    own = own.withColumns({"_base": F.first(F.when(is_tag, number), ignorenulls=True).over(told), "_tag": last(F.when(is_tag, number)).over(told), "_ended": last(F.when(is_end, number)).over(told)})
    own = own.where("_base is not null")
    if fields:
        own = own.withColumn("_whole", F.max("_size").over(Window.partitionBy("filename")) <= len(PING_FIELDS))
        own = own.withColumn("ping", F.when(F.col("_whole"), F.col("ping"))).withColumn("_before", last("ping").over(told))
    held = ["_before"] if fields else []
    here, from_row, behind = F.struct("line_num", "_time", *held), from_here(["filename"], ["line_num"]), ahead(["filename"], ["line_num"])
    marks = {"_next": last(F.when(is_tag, here)).over(behind), "_end": last(F.when(is_end, here)).over(behind), "_bottom": F.first(here).over(from_row)}
    if fields:
        # A ping stands before an APC row if an APC row comes before the next ping.
        apc = last(F.when(F.col("_whole") & F.col("_apc"), True).when(F.col("ping").isNotNull(), False)).over(behind)
        marks |= {"first_ping": last("ping").over(from_row), "row_before_apc": F.coalesce(apc, F.lit(False))}
    own = own.withColumns(marks)
    by_message = F.col("_end").isNotNull() & F.coalesce(F.col("_end.line_num") < F.col("_next.line_num"), F.lit(True))
    end = lambda c: F.when(by_message, F.col(f"_end.{c}")).when(F.col("_next").isNotNull(), F.col(f"_next.{c}"))
    place = lambda c: c - F.col("_base") - 1
    at = lambda p: F.when(p.isNotNull(), F.struct(place(p["line_num"]).alias("index_loc"), *(p[k].alias(k) for k in fields)))
    pings = {"ping": F.col("ping"), "first_ping": F.col("first_ping"), "last_ping": end("_before").otherwise(F.col("_bottom._before"))} if fields else {}
    return own.select(
        "filename",
        "line_num",
        "line",
        "kind",
        place(number).alias("index_loc"),
        place(F.col("_tag")).alias("tag_loc"),
        F.col("_next.line_num").alias("line_num_next"),
        place(end("line_num").otherwise(F.col("_bottom.line_num"))).alias("run_end"),
        end("_time").alias("run_end_time"),
        F.coalesce(F.col("_ended") > F.col("_tag"), F.lit(False)).alias("ended"),
        *(at(c).alias(k) for k, c in pings.items()),
        *(["row_before_apc"] if fields else []),
    )


def run_bounds(lines: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """filename, index_run_start (the tag's place), index_run_end and run_end_time of each tag."""
    tags = file_rows(lines, inventory).where("kind = 'tag'")
    return tags.select("filename", F.col("index_loc").alias("index_run_start"), F.col("run_end").alias("index_run_end"), "run_end_time")


def valid_ping(fields: dict[str, Column] | None = None) -> Column:
    """Coordinates and heading in range, door O or C, vehicle M or S."""
    c = fields or {k: F.col(k) for k in PING_FIELDS}
    number = lambda k: F.trim(c[k].cast("string")).try_cast("double")
    ok = number("lat").between(-90, 90) & number("long").between(-180, 180) & number("heading").between(0, 360)
    return F.coalesce(ok & c["door_state"].isin("O", "C") & c["veh_state"].isin("M", "S"), F.lit(False))


def _parsed(keep: Sequence[str]) -> list[Column]:
    """ping (line_num and the fields to keep, typed; null in other lines), _apc and _size of lines with their kind."""
    if not keep:
        return []
    part, line = F.split("line", ","), F.col("line")
    data = F.col("kind").isNull() & (F.trim("line") != "")
    size = F.when(data & ~line.rlike(r"^\s*/"), F.size(part))
    fields = {k: F.trim(F.try_element_at(part, F.lit(i + 1))) for i, k in enumerate(PING_FIELDS)}
    typed = {k: fields[k] for k in ("door_state", "veh_state", "stop_window", "blank")}
    typed |= {k: fields[k].try_cast("double") for k in ("lat", "long", "heading", "lat_raw", "long_raw")}
    typed |= {k: fields[k].try_cast("double").cast("long") for k in ("odom_ft", "sec_past_st", "sat_cnt")}
    is_apc = data & (F.upper(F.trim(F.try_element_at(part, F.lit(1)))) == "APC")
    ping = F.struct("line_num", *(typed[k].alias(k) for k in keep))
    whole = F.when(data & ~is_apc & (F.size(part) == len(PING_FIELDS)) & valid_ping(fields), ping)
    return [whole.alias("ping"), is_apc.alias("_apc"), size.alias("_size")]


def ping_lines(lines: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Typed pings of each file with row_before_apc; files with a row of too many fields are left out whole."""
    return file_rows(lines, inventory, PING_FIELDS).where("ping is not null").select("filename", "ping.*", "row_before_apc")


def _run_columns() -> dict[str, Column]:
    """Distances, durations and speeds between a run's first and last ping."""
    feet, secs = F.col("odom_ft_end") - F.col("odom_ft_start"), F.col("sec_end") - F.col("sec_start")
    by_tags = F.unix_timestamp("end_date_time") - F.unix_timestamp("start_date_time")
    miles = feet / FEET_A_MILE
    crow = planar_metres(F.col("long_start"), F.col("lat_start"), F.col("long_end"), F.col("lat_end")) * MILES_A_METRE
    return {
        "run_duration_from_sec": secs,
        "run_duration_from_tags": by_tags,
        "dist_odom_mi": miles,
        "mph_odom": safe_div(miles * 3600, secs),
        "mph_run_tag": safe_div(miles * 3600, by_tags),
        "dist_crow_fly_mi": crow,
    }


def clean_pings(lines: DataFrame, inventory: DataFrame | None = None, service_day_cutoff_hour: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pings with their runs, run summary) of the files in the inventory, or of all.

    A run for each tag: from the first ping at or behind the tag to the last ping at or before its end. Pings outside of
    any run keep null bounds. A run without pings keeps a row of nulls, or the bounds of what lies around it; of runs with
    the same first ping the last tag stays. Runs that start before the cut-off hour count to the weekday before.
    Everything is grouped by file, so a file's lines are shuffled once for each; runs move no more than their columns need.
    """
    pings = file_rows(lines, inventory, PING_FIELDS).where("ping is not null")
    group = Window.partitionBy("filename", "tag_loc")
    bounds = {"index_run_start": F.min("index_loc").over(group), "index_run_end": F.col("last_ping.index_loc")}
    pings = pings.select("filename", "ping.*", "row_before_apc", *(F.when(~F.col("ended"), c).alias(k) for k, c in bounds.items()))

    tags = file_rows(lines, inventory, ("odom_ft", "sec_past_st", "lat", "long")).where("kind = 'tag'").withColumns(_tag_columns(F.col("line")))
    names = {"index_loc": "index_run", "odom_ft": "odom_ft", "sec_past_st": "sec", "lat": "lat", "long": "long"}
    sides = [F.col(f"{at}.{c}").alias(f"{to}_{side}") for at, side in (("first_ping", "start"), ("last_ping", "end")) for c, to in names.items()]
    day = F.date_sub("tag_date", 1)
    runs = tags.select(
        "filename",
        *(F.col(c) for c in INVENTORY if c != "wday"),
        F.when(F.col("tag_starthour") < service_day_cutoff_hour, F.date_format(day, "EEEE")).otherwise(F.col("wday")).alias("wday"),
        *(c.alias(k) for k, c in file_fields(F.col("filename")).items()),
        F.col("index_loc").alias("index_run_start_original"),
        F.col("run_end").alias("index_run_end_original"),
        "run_end_time",
        F.col("tag_datetime").alias("start_date_time"),
        tag_timestamp(F.date_format("tag_date", "MM/dd/yy"), F.col("run_end_time")).alias("end_date_time"),
        *sides,
    )
    return pings, keep_last(runs.withColumns(_run_columns()), ["filename", "index_run_start"], ["index_run_start_original"])


def misplaced_tags(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Tags of the inventory whose line doesn't hold them: a check of line numbers."""
    own = inventory.where("line_num is not null").select("filename", "line_num", "taglist")
    return own.join(lines, ["filename", "line_num"], "left").where(~F.trim("line").eqNullSafe(F.col("taglist"))).select("filename", "line_num", "taglist")


def file_quality(inventory: DataFrame) -> DataFrame:
    """filename, n_tags, is_empty, is_mislabelled: logs without tags, or whose bus number isn't that of their tags."""
    wrong = F.coalesce(F.bool_or(F.col("file_busid") != F.col("tag_busid")), F.lit(False))
    n = F.count("line_num")
    return inventory.groupBy("filename").agg(n.alias("n_tags"), (n == 0).alias("is_empty"), wrong.alias("is_mislabelled"))


def long_enough(runs: DataFrame, seconds: float = 600, miles: float = 2) -> DataFrame:
    """Runs that are not known to be short in time or distance."""
    short = (F.col("run_duration_from_sec") < seconds) | (F.col("dist_odom_mi") < miles)
    return runs.where(~F.coalesce(short, F.lit(False)))


def numeric_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds is_numeric_<column> for each column."""
    return df.withColumns({f"is_numeric_{c}": is_numeric(F.col(c)) for c in columns})
