"""Schemas, and readers and writers of the library's tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from transitlake.operators.windows import keep_last

_KINDS = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def _struct(columns: str) -> StructType:
    """From "name kind, name kind": unlike Spark's own parser it needs no session."""
    return StructType([StructField(*(f(x) for f, x in zip((str, _KINDS.__getitem__), c.split(), strict=True))) for c in columns.split(",")])


PINGS = _struct(
    "filename string, index_run_start long, index_run_end long, index_loc long, lat double, long double, heading double, door_state string, veh_state string, "
    "odom_ft long, sec_past_st long, sat_cnt long, stop_window string, blank string, lat_raw double, long_raw double, row_before_apc boolean, "
    "route_pattern string, pattern int, start_date_time timestamp, route string, wday string"
)
RUNS = _struct(
    "filename string, file_busid long, file_id string, taglist string, route_pattern string, tag_busid long, pattern int, index_run_start_original long, "
    "index_run_end_original long, index_run_start long, index_run_end long, start_date_time timestamp, end_date_time timestamp, sec_start long, sec_end long, "
    "odom_ft_start long, odom_ft_end long, run_duration_from_sec long, run_duration_from_tags long, dist_odom_mi double, mph_odom double, mph_run_tag double, "
    "dist_crow_fly_mi double, lat_start double, long_start double, lat_end double, long_end double, route string, wday string"
)
GTFS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, pickup_type int, drop_off_type int",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, direction_id int",
}
#: A parameter of the reader: names of the observation columns, all text.
FIELD_COLUMNS = (
    "metrobus_route", "bus_id", "date_obs", "signal_phase", "time_entered_stop_zone", "time_left_stop_zone", "front_door_open", "front_door_close",
    "rear_door_open", "rear_door_close", "dwell_time", "boardings", "alightings", "total_time_at_intersection", "traffic_conditions", "notes",
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are null, others dropped."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("route", "wday"), run_existing: bool = True) -> None:
    """Writes by partition: those that exist are replaced, or skipped without run_existing."""
    spark = df.sparkSession
    if not run_existing:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            there = spark.read.parquet(path).select(*by).distinct()
            df = df.join(there, list(by), "left_anti")
    # Spark splits a partition that holds very many rows over tasks, and files, and joins small ones.
    df.hint("rebalance", *(F.col(c) for c in by)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def write_segments(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ("route", "wday", "seg_name_id"))


def write_inventory(df: DataFrame, path: str) -> None:
    """Clustered by file, not partitioned by it: one folder a file would be too many."""
    df.repartitionByRange("filename").sortWithinPartitions("filename", "line_num").write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_cleaned(spark: SparkSession, path: str, routes: str | Sequence[str], days: str | Sequence[str] | None = None, runs: bool = False) -> DataFrame:
    """Pings (or runs) of routes and weekdays; of rows with the same key the last written stays."""
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    schema = RUNS if runs else PINGS
    df = spark.read.schema(schema).parquet(path).where(F.col("route").isin(as_list(routes)))
    if days is not None:
        df = df.where(F.col("wday").isin(as_list(days)))
    keys = ["filename", "index_run_start"] if runs else ["filename", "index_run_start", "index_loc"]
    written = df.select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_name").alias("_file"))
    return keep_last(written, keys, ["_at", "_file"]).drop("_at", "_file")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """seg_name_id and coords of a GeoJSON file's lines."""
    schema = "features array<struct<properties:struct<seg_name_id:string>,geometry:struct<type:string,coordinates:array<array<double>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    point = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    return rows.select(F.col("f.properties.seg_name_id").alias("seg_name_id"), F.transform("f.geometry.coordinates", point).alias("coords"))


def read_gtfs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {k: _by_header(spark, f"{path}/{k}.txt", v) for k, v in GTFS.items()}


def _by_header(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Columns by their names in the header, in whatever order the file has them."""
    return conform(spark.read.option("header", True).csv(path), _struct(ddl))


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    df = df.withColumnsRenamed({c: c.strip().lower().replace(" ", "_") for c in df.columns})
    kinds = {"pattern": "int", "stop_sort_order": "int", "order": "int", "stop_lat": "double", "stop_lon": "double", "dist_from_previous_stop": "double", "trip_length": "double"}
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items() if c in df.columns}).withColumn("route", F.trim("route"))


def read_schedule_tables(spark: SparkSession, url: str, tables: dict[str, str], properties: dict[str, str]) -> dict[str, DataFrame]:
    """The schedule's tables over JDBC, by name."""
    return {k: spark.read.jdbc(url, t, properties=properties) for k, t in tables.items()}


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], keys: Sequence[str], batch: str | None = None) -> int:
    """Adds rows, with an id hashed from their natural key, that the table doesn't have yet; returns their number.

    Tasks write to a staging table of the batch. What they write twice, as a task is tried again after its rows arrived,
    stands there under one id. One statement in the database then moves one row of each id that the table lacks, so a
    batch that is written again, or rows of one key in two batches, add nothing. A missing table is created; one that is
    there has the rows' columns and id, and an index on id is advised.
    """
    batch = batch or uuid.uuid4().hex
    if not re.fullmatch(r"\w+", batch):
        raise ValueError("a batch is named by letters, digits and underscores")
    spark, staging, rows = df.sparkSession, f"{table}_stage_{batch}", df.withColumn("id", F.xxhash64(*keys))
    rows.limit(0).write.mode("append").jdbc(url, table, properties=properties)
    # Another value each time that a row is written, also by the same task.
    tried = F.xxhash64(F.expr("java_method('java.util.UUID', 'randomUUID')"))
    rows.withColumn("tried", tried).write.mode("overwrite").jdbc(url, staging, properties=properties)
    dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    names, of, at = ", ".join(map(dialect.quoteIdentifier, rows.columns)), dialect.quoteIdentifier("id"), dialect.quoteIdentifier("tried")
    added = _in_database(
        spark,
        url,
        properties,
        f"insert into {table} ({names}) select {names} from {staging} s "
        f"where s.{at} = (select min(o.{at}) from {staging} o where o.{of} = s.{of}) and not exists (select 1 from {table} t where t.{of} = s.{of})",
    )
    _in_database(spark, url, properties, f"drop table {staging}")
    return added


def _in_database(spark: SparkSession, url: str, properties: dict[str, str], sql: str) -> int:
    """Runs a statement as one transaction; returns how many rows it changed."""
    jvm = spark._jvm
    told = jvm.java.util.Properties()
    for k, v in properties.items():
        told.setProperty(k, v)
    if "driver" in properties:
        jvm.java.lang.Class.forName(properties["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    connection = jvm.java.sql.DriverManager.getConnection(url, told)
    try:
        connection.setAutoCommit(False)
        changed = connection.createStatement().executeUpdate(sql)
        connection.commit()
        return changed
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def read_jdbc(spark: SparkSession, url: str, table: str, schema: StructType, properties: dict[str, str], split_by: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 1) -> DataFrame:
    """A table of runs or readings in a schema's columns, read by ``parts`` ranges of a numeric column where one is named."""
    by = {"column": split_by, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts} if split_by else {}
    df = spark.read.jdbc(url, table, properties=properties, **by)
    return conform(df.withColumnsRenamed({c: c.lower() for c in df.columns}), schema)


def read_field_sheets(spark: SparkSession, sheets: dict[str, str], columns: Sequence[str] = FIELD_COLUMNS) -> DataFrame:
    """Observation sheets (CSV exports) by location, columns renamed with _field, all as text."""

    def one(location: str, path: str) -> DataFrame:
        ddl = ", ".join(f"{c}_field string" for c in columns)
        return spark.read.schema(ddl).option("header", True).csv(path).withColumn("field_qjump_loc", F.lit(location))

    return reduce(DataFrame.unionByName, (one(k, p) for k, p in sheets.items()))


def inline(spark: SparkSession, columns: Sequence[str], *values) -> DataFrame:
    """A table written out row by row: inline(spark, ["a", "b"], 1, 2, 3, 4)."""
    n = len(columns)
    if not n or len(values) % n:
        raise ValueError("values don't fill whole rows")
    return spark.createDataFrame([tuple(values[i : i + n]) for i in range(0, len(values), n)], list(columns))


def first_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *(c for c in df.columns if c not in first))
