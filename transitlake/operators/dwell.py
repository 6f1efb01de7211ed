"""Dwell times and door openings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.operators.windows import RUN, change_id, over

SEG = (*RUN, "seg_name_id")


def dwell_first_open(pings: DataFrame, keys=SEG) -> DataFrame:
    """Seconds from the first open record to the record after it."""
    after = pings.withColumn("_next", F.lead("sec_past_st").over(over(keys)))
    first = after.where("door_state = 'O'").groupBy(*keys).agg(F.min_by(F.struct("sec_past_st", "_next"), "index_loc").alias("r"))
    return first.select(*keys, (F.col("r._next") - F.col("r.sec_past_st")).alias("dwell_secs"))


def dwell_first_to_last(pings: DataFrame, moved_feet: float = 30.0, keys=SEG) -> DataFrame:
    """Seconds from the first opening to the last closing of each spell at one place (moved less than moved_feet)."""
    spells = pings.withColumn("door_id", change_id(F.col("door_state"), keys)).withColumn("_next", F.lead("sec_past_st").over(over(keys)))
    per = spells.where("door_state = 'O'").groupBy(*keys, "door_id").agg(F.min("sec_past_st").alias("a"), F.max(F.coalesce("_next", "sec_past_st")).alias("b"), (F.max("odom_ft") - F.min("odom_ft")).alias("moved"))
    return per.where(F.col("moved") < moved_feet).groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("dwell_secs"), F.count(F.lit(1)).alias("n_spells"))


def stop_window_dwell(pings: DataFrame, terminals: tuple[str, ...] = (), keys=RUN) -> DataFrame:
    """Seconds in each stop window by door state, no more than the 95th percentile of all, rounded up."""
    timed = pings.withColumn("secs", F.lead("sec_past_st").over(over(keys)) - F.col("sec_past_st")).where("stop_window is not null")
    per = timed.where(~F.col("stop_window").isin(*terminals)).groupBy(*keys, "stop_window", "door_state").agg(F.sum("secs").alias("secs"), F.max("secs").alias("most"))
    # The percentile is taken from counts of distinct seconds, as its state holds every distinct value.
    counted = per.where("secs is not null").groupBy("secs").agg(F.count(F.lit(1)).alias("n"))
    top = counted.agg(F.ceil(F.percentile("secs", F.lit(0.95), F.col("n"))).alias("top"))
    return per.crossJoin(F.broadcast(top)).where(F.col("secs") <= F.col("top")).drop("top")  # one row


def door_openings(pings: DataFrame, keys=RUN) -> DataFrame:
    """Openings of each group, from its number of changes of the door's state (closed at both ends)."""
    ids = pings.withColumn("door_id", change_id(F.col("door_state"), keys)).groupBy(*keys).agg(F.max("door_id").alias("most"))
    return ids.select(*keys, "most", ((F.col("most") - 1) / 2).alias("openings"))


def no_opening_share(pings: DataFrame, keys=SEG) -> DataFrame:
    """By segment, the share of runs whose doors never change state."""
    return door_openings(pings, keys).groupBy("seg_name_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("most") == 1) / F.count(F.lit(1))).alias("share"))


def mean_phase_seconds(phases: DataFrame, keys=SEG) -> DataFrame:
    """Mean over runs of each phase's seconds, for runs that were served."""
    served = phases.where("any_open")
    per = served.groupBy(*keys, "phase").agg(F.sum("secs_marg").alias("secs"))
    return per.groupBy("seg_name_id", "phase").agg(F.avg("secs").alias("mean_secs"), F.count(F.lit(1)).alias("n"))
