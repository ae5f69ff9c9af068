"""Registration of queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.bars import ticks_to_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR

#: Events as ticks and their hourly bars, for the SQL side.
TICKS = "ticks as (select event_type as symbol, user_id, event_id, epoch_us(ts) as us, value, props from events)"
BARS = (
    TICKS
    + """, bars as (
  select symbol, us - us % 3600000000 as open_us, arg_min(value, us) as open, max(value) as high, min(value) as low, arg_max(value, us) as close,
    sum(value) as turnover, coalesce(sum(value) filter (where user_id % 2 = 0), 0) as taker, count(*) as trades
  from ticks group by all)"""
)
#: Admitted bars (a price of 0 is none, the segment breaks there) with the number of their contiguous segment.
SEGMENTS = (
    BARS
    + """, flagged as (select *, case when open_us - lag(open_us) over (partition by symbol order by open_us) = 3600000000 then 0 else 1 end as fresh from bars where low > 0),
segs as (select *, sum(fresh) over (partition by symbol order by open_us)::bigint as segment from flagged)"""
)


def query(name: str, sql: str | None = None):
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, user_id, event_id, us, value, props. Epoch microseconds do not depend on the session's zone."""
    us = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as us"
    return read(spark, sf_dir, "events").selectExpr("event_type as symbol", "user_id", "event_id", us, "value", "props")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), HOUR, taker="user_id % 2 = 0")
