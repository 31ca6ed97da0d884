"""Time helpers of the splitters; instants are datetimes on the driver, columns in a query."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"Y": "year", "A": "year", "Q": "quarter", "M": "month", "W": "week", "D": "day", "H": "hour", "min": "minute", "s": "second"}


def floor_date(ts: Column, precision: str) -> Column:
    """The first instant of the year, quarter, month, week, day, hour... of ts."""
    if precision not in _UNITS:
        raise ValueError(f"unknown precision {precision!r}")
    return F.date_trunc(_UNITS[precision], ts)


def floor_instant(ts: datetime, precision: str) -> datetime:
    if precision not in _UNITS:
        raise ValueError(f"unknown precision {precision!r}")
    return pd.Timestamp(ts).to_period({"H": "h"}.get(precision, precision)).start_time.to_pydatetime()


def split_intervals(start: datetime, end: datetime, n: int) -> list[datetime]:
    """The n - 1 inner points that cut [start, end] into n equal parts."""
    if n <= 0 or start >= end:
        raise ValueError("n must be positive and start before end")
    us = (end - start) // timedelta(microseconds=1)
    return [start + timedelta(microseconds=us * i // n) for i in range(1, n)]


def thresholds_for_n_years(final: datetime, n_years: int, splits_per_year: int = 1, precision: str = "D") -> list[datetime]:
    """Descending thresholds over the n years that end at final; ValueError if flooring makes two equal."""
    out: list[datetime] = []
    for k in range(n_years):
        end = (pd.Timestamp(final) - pd.DateOffset(years=k)).to_pydatetime()
        start = (pd.Timestamp(final) - pd.DateOffset(years=k + 1)).to_pydatetime()
        out += [end, *split_intervals(start, end, splits_per_year)]
    out = sorted((floor_instant(t, precision) for t in out), reverse=True)
    if len(set(out)) < len(out):
        raise ValueError("thresholds are not unique at this precision")
    return out


def resolve_instant(value: str | datetime, now: datetime | None = None) -> datetime:
    """A datetime, a text that pandas reads, "now", "today", or "Q1".."Q4": the first day of that quarter of this year."""
    if isinstance(value, datetime):
        return value
    now = now or datetime.now()
    if value == "now":
        return now
    if value == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0)
    if value in ("Q1", "Q2", "Q3", "Q4"):
        return datetime(now.year, 3 * int(value[1]) - 2, 1)
    try:
        return pd.Timestamp(value).to_pydatetime()
    except ValueError as e:
        raise ValueError(f"not a point in time: {value!r}") from e


def group_of(ts: Column, thresholds: list[datetime]) -> Column:
    """How many thresholds are at or before ts, whatever their order."""
    out = F.lit(0)
    for t in thresholds:
        out = out + (ts >= F.lit(t).cast("timestamp_ntz")).cast("int")
    return out


def q_floor_dates(spark, sf_dir):
    """The day of each order floored to every precision, as days since 1970; and its group among five yearly thresholds."""
    ts = F.col("o_orderdate").cast("timestamp")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = [F.datediff(floor_date(ts, p), F.lit("1970-01-01").cast("date")).cast("long").alias(p.lower()) for p in ("Y", "Q", "M", "W", "D")]
    return o.select(F.col("o_orderkey").alias("row_id"), *days, group_of(F.col("o_orderdate"), thresholds_for_n_years(datetime(1999, 1, 1), 5)).cast("long").alias("grp"))


QUERIES = {"floor_dates": q_floor_dates}
_FLOORS = ", ".join(f"date_diff('day', DATE '1970-01-01', CAST(date_trunc('{u}', CAST(o_orderdate AS TIMESTAMP)) AS DATE)) AS {p}" for p, u in (("y", "year"), ("q", "quarter"), ("m", "month"), ("w", "week"), ("d", "day")))
ORACLE_SQL = {"floor_dates": f"SELECT o_orderkey AS row_id, {_FLOORS}, CAST((SELECT count(*) FROM range(5) t(i) WHERE o_orderdate >= make_date(CAST(1995 + i AS INT), 1, 1)) AS BIGINT) AS grp FROM orders"}
