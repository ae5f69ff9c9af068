"""Bars: ticks to OHLCV, rollups that refuse incomplete buckets, grid and gap audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucket_start(us: str | Column, step: int) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return us - F.pmod(us, F.lit(step))


def ticks_to_bars(ticks: DataFrame, step: int, key: str = "symbol", us: str = "us", value: str = "value", taker: str = "false") -> DataFrame:
    """One aggregate with partial sums on the map side; key and bucket spread a hot symbol over its buckets."""
    return ticks.groupBy(key, bucket_start(us, step).alias("open_us")).agg(
        F.min_by(value, us).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, us).alias("close"),
        F.sum(value).alias("turnover"),
        F.coalesce(F.sum(F.when(F.expr(taker), F.col(value))), F.lit(0.0)).alias("taker"),
        F.count("*").alias("trades"),
    )


def roll_up(bars: DataFrame, step: int, period: int, key: str = "symbol") -> DataFrame:
    """Bars of `step` to bars of `period`, aligned to the epoch; only buckets that hold every bar come out."""
    out = bars.groupBy(key, bucket_start("open_us", period).alias("open_us")).agg(
        F.min_by("open", F.col("open_us")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.col("open_us")).alias("close"),
        F.sum("turnover").alias("turnover"),
        F.sum("taker").alias("taker"),
        F.sum("trades").alias("trades"),
        F.count("*").alias("n_bars"),
    )
    return out.withColumn("complete", F.col("n_bars") == period // step)


def gaps(bars: DataFrame, step: int, key: str = "symbol") -> DataFrame:
    """Missing bars between neighbours: first, last and number."""
    last = F.lag("open_us").over(W.partitionBy(key).orderBy("open_us"))
    holes = bars.withColumn("_last", last).where(F.col("open_us") - F.col("_last") > step)
    return holes.select(key, (F.col("_last") + step).alias("first_missing_us"), (F.col("open_us") - step).alias("last_missing_us"), F.expr(f"(open_us - _last) div {step} - 1").alias("n_missing"))


def missing_grid(bars: DataFrame, step: int, key: str = "symbol") -> DataFrame:
    """Every expected bar of each key's span that is absent: generated grid, anti-joined."""
    span = bars.groupBy(key).agg(F.min("open_us").alias("a"), F.max("open_us").alias("b"))
    grid = span.select(key, F.explode(F.expr(f"sequence(a, b, {step}L)")).alias("open_us"))
    return grid.join(bars, [key, "open_us"], "left_anti")


def admit(bars: DataFrame, step: int, key: str = "symbol") -> DataFrame:
    """Counts by rule that a bar breaks, one row a key: nothing is repaired, and `admitted` is all or nothing."""
    rules = {
        "bad_time": f"open_us is null or pmod(open_us, {step}) <> 0",
        "bad_price": "low is null or low <= 0 or isnan(low) or isnan(high) or close < low or close > high",
        "bad_flow": "turnover < 0 or taker > turnover * (1 + 1e-10) or taker < 0",
        "bad_trades": "trades < 0",
    }
    counts = bars.groupBy(key).agg(F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct("open_us")).alias("duplicate_rows"), *[F.count_if(F.expr(r)).alias(n) for n, r in rules.items()])
    return counts.withColumn("admitted", F.expr("duplicate_rows + " + " + ".join(rules) + " = 0"))


def violations(rules: dict[str, str]) -> Column:
    """Codes of the broken rules of a row, as an array in the order of the rules."""
    return F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(code)) for code, rule in rules.items()]))


def source_quality(bars: DataFrame, step: int, key: str = "symbol", jump: float = 0.5) -> DataFrame:
    """Receipt of a source: rows, missing bars inside the span, idle rows, adjacent jumps."""
    by = W.partitionBy(key).orderBy("open_us")
    near = bars.withColumn("_p", F.lag("close").over(by)).withColumn("_t", F.lag("open_us").over(by))
    jumped = (F.col("open_us") - F.col("_t") == step) & (F.abs(F.try_divide(F.col("close"), F.col("_p")) - 1) > jump)
    return near.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.expr(f"(max(open_us) - min(open_us)) div {step} + 1 - count(*)").alias("missing_rows"),
        F.count_if(F.col("taker") == 0).alias("idle_rows"),
        F.count_if(jumped).alias("jumps"),
    )


def grid_breaks(bars: DataFrame, step: int, key: str = "symbol") -> DataFrame:
    """How often neighbours of a key are not one step apart, and whether its grid is complete."""
    gap = F.col("open_us") - F.lag("open_us").over(W.partitionBy(key).orderBy("open_us"))
    broken = F.coalesce(gap != step, F.lit(False))
    return bars.withColumn("_x", broken).groupBy(key).agg(F.count_if("_x").alias("breaks"), (F.count_if("_x") == 0).alias("complete"))


def latest(bars: DataFrame, expected_us: int, key: str = "symbol") -> DataFrame:
    """The last bar of each key, and whether it is the expected one: a stale or unfinished key is not fresh."""
    return bars.groupBy(key).agg(F.max("open_us").alias("latest_us")).withColumn("fresh", F.col("latest_us") == expected_us)


def complete_rows(rows: DataFrame, needed: list[str], key: list[str]) -> DataFrame:
    """Rows whose needed values are known; infinite, negative or repeated ones are refused in the plan."""
    known = rows.dropna(subset=needed)
    fine = F.lit(True)
    for c in needed:
        fine = fine & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))) & (F.col(c) >= 0)
    once = F.count("*").over(W.partitionBy(*key)) == 1
    checked = known.withColumn("_ok", fine & once)
    return checked.where(F.when(F.col("_ok"), True).otherwise(F.raise_error(F.lit("a value is not finite and positive, or a key repeats")).cast("boolean"))).drop("_ok")
