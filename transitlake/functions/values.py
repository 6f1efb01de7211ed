"""Scalar column helpers: division, numbers, times, labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors of the published results.
FEET_A_MILE = 5280.0
FPS_A_MPH = 1.467
MPH_A_FPS = 0.681818
MILES_A_METRE = 0.000621371
FEET_A_METRE = 3.28084


def safe_div(num: Column, den: Column) -> Column:
    """IEEE division without errors: x/0 is an infinity of x's sign, 0/0 is null (a missing value)."""
    num, den = num.cast("double"), den.cast("double")
    over = F.when(num > 0, F.lit(float("inf"))).when(num < 0, F.lit(float("-inf")))
    return F.when(den != 0, num / den).when(den == 0, over)


def is_numeric(text: Column) -> Column:
    return F.trim(text).try_cast("double").isNotNull()


def half_even(value: Column, places: int = 2) -> Column:
    return F.bround(value, places)


def spread(value: Column) -> Column:
    """max - min of a group."""
    return F.max(value) - F.min(value)


def first_of(value: str, order: str = "index_loc") -> Column:
    """A group's first value that isn't null."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def last_of(value: str, order: str = "index_loc") -> Column:
    """A group's last value that isn't null."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null where the pattern doesn't match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def seconds_of(text: Column) -> Column:
    """Seconds from H:M:S, M:S, :S or a plain number; null for anything else."""
    part = F.split(F.trim(text), ":")
    n, at = F.size(part), lambda i: F.coalesce(F.try_element_at(part, F.lit(i)).try_cast("double"), F.lit(None))
    blank = F.trim(F.try_element_at(part, F.lit(1))) == ""
    minutes = F.when(blank, F.lit(0.0)).otherwise(at(1))
    return F.when(n == 3, at(1) * 3600 + at(2) * 60 + at(3)).when(n == 2, minutes * 60 + at(2)).when(n == 1, at(1))


def tag_timestamp(date: Column, time: Column) -> Column:
    """Timestamp from MM/dd/yy and HH:mm:ss; null where either doesn't parse."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("MM/dd/yy HH:mm:ss"))


def weekday(day: Column) -> Column:
    """Full English name of the weekday."""
    return F.date_format(day, "EEEE")


def service_date(file_date: Column) -> Column:
    """The day before a yyMMdd file date."""
    return F.date_sub(F.to_date(F.try_to_timestamp(file_date, F.lit("yyMMdd"))), 1)


def seconds_past_midnight(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


# Starts of the periods of the day, left-closed.
PERIODS = ((0, "late night"), (4, "early am"), (6, "am peak"), (9, "midday"), (15, "pm peak"), (19, "evening"), (23, "late night"))
#: The bands of the time-space charts.
BANDS = ((0, "other"), (6, "am"), (10, "midday"), (15, "pm"), (19, "other"))


def period(hour: Column, periods=PERIODS) -> Column:
    out = F.when(hour.isNull(), F.lit(None).cast("string"))
    for start, name in reversed(periods):
        out = out.when(hour >= start, F.lit(name))
    return out


def label(code: Column, names: Mapping[str, str]) -> Column:
    """The code's name, or the code itself where it has none."""
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, code), code)
