"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd HH:mm:ss"
LIFETIME_END = "2099-12-31 23:59:59"
PLAN_DAYS = {"month": 30, "year": 365}
PERIODS = ("day", "week", "month", "quarter", "year")


def stamp(ts) -> Column:
    return F.date_format(ts, STAMP)


def ntz(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text), F.lit(STAMP))


def period_key(ts, period: str) -> Column:
    """Text key of a calendar period. Weeks start on Monday; days before the first Monday are week 00."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    year = F.date_format(ts, "yyyy")
    if period == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if period == "week":
        week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
        return F.concat(year, F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    if period == "month":
        return F.date_format(ts, "yyyy-MM")
    if period == "quarter":
        return F.concat(year, F.lit("-Q"), F.quarter(ts).cast("string"))
    if period == "year":
        return year
    raise ValueError(f"period must be one of {PERIODS}")


def plan_days(plan) -> Column:
    plan = F.col(plan) if isinstance(plan, str) else plan
    days = F.lit(None).cast("int")
    for name, n in PLAN_DAYS.items():
        days = F.when(plan == name, n).otherwise(days)
    return days


def plan_expiry(plan, start) -> Column:
    plan = F.col(plan) if isinstance(plan, str) else plan
    start = F.col(start) if isinstance(start, str) else start
    return F.when(plan == "lifetime", ntz(LIFETIME_END)).otherwise(
        start + F.make_dt_interval(days=plan_days(plan)))
