"""Queries over ticks and bars: scans, rollups, audits, features, labels, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators import bars as B, features as X, islands as I, labels as L
from tidemark.operators.rolling import Frame
from tidemark.plans.base import BARS, DAY, HOUR, SEGMENTS, TICKS, bars, query, ticks

r6 = lambda c: F.round(c, 6).alias(c)
S = X.FeatureSpec(short=2, middle=3, long=4, base=5, day=6, horizon=5)


def segs(spark: SparkSession, d: str) -> DataFrame:
    """Admitted bars in contiguous segments; a bar without a positive price breaks them."""
    return I.segments(bars(spark, d).where("low > 0"), HOUR)


@query("s01_window_scan", f"with {TICKS} select symbol, us, value from ticks where us >= 1704153600000000 and us < 1704326400000000 - 60000000")
def window_scan(spark, d):
    """A half-open window whose last bar must be complete strictly before the end."""
    return ticks(spark, d).where((F.col("us") >= 1704153600000000) & (F.col("us") < 1704326400000000 - 60_000_000)).select("symbol", "us", "value")


@query("s15_json_frames", f"with {TICKS} select event_id, symbol, cast(json_extract_string(props, '$.k') as bigint) as k, case when symbol = 'click' then 'kline' when symbol = 'view' then 'trade' else 'other' end as kind from ticks")
def json_frames(spark, d):
    """Every frame is decoded; its stream's name says what it is."""
    frame = ticks(spark, d).withColumn("k", F.from_json("props", "k bigint")["k"])
    kind = F.when(F.col("symbol") == "click", "kline").when(F.col("symbol") == "view", "trade").otherwise("other")
    return frame.select("event_id", "symbol", "k", kind.alias("kind"))


@query("a01_tick_bars", f"with {BARS} select symbol, open_us, open, high, low, close, round(turnover, 6) as turnover, round(taker, 6) as taker, trades from bars")
def tick_bars(spark, d):
    return bars(spark, d).withColumns({c: F.round(c, 6) for c in ("turnover", "taker")})


@query("a01_rollup", f"""with {BARS} select symbol, open_us - open_us % 14400000000 as open_us, arg_min(open, bars.open_us) as open, max(high) as high, min(low) as low,
  arg_max(close, bars.open_us) as close, round(sum(turnover), 6) as turnover, round(sum(taker), 6) as taker, sum(trades)::bigint as trades, count(*) as n_bars, count(*) = 4 as complete from bars group by 1, 2""")
def rollup(spark, d):
    return B.roll_up(bars(spark, d), HOUR, 4 * HOUR).withColumns({c: F.round(c, 6) for c in ("turnover", "taker")})


@query("p01_admission", f"""with {BARS} select symbol, count(*) as n_rows, count(*) - count(distinct open_us) as duplicate_rows, count(*) filter (where open_us % 3600000000 <> 0) as bad_time,
  count(*) filter (where low <= 0 or close < low or close > high) as bad_price, count(*) filter (where turnover < 0 or taker > turnover * (1 + 1e-10) or taker < 0) as bad_flow, count(*) filter (where trades < 0) as bad_trades,
  count(*) filter (where low <= 0 or close < low or close > high or turnover < 0 or taker > turnover * (1 + 1e-10) or taker < 0) = 0 as admitted from bars group by symbol""")
def admission(spark, d):
    return B.admit(bars(spark, d), HOUR)


@query("p03_invariants", f"""with {TICKS}, v as (select event_id, concat_ws(',', case when value > 40 then 'high' end, case when user_id % 7 = 0 then 'user' end, case when us % 2 = 1 then 'odd' end) as codes from ticks) select * from v where codes <> ''""")
def invariants(spark, d):
    rules = {"high": "value > 40", "user": "user_id % 7 = 0", "odd": "us % 2 = 1"}
    out = ticks(spark, d).select("event_id", F.array_join(B.violations(rules), ",").alias("codes"))
    return out.where("codes <> ''")


@query("p06_time_contract", f"""with {BARS} select symbol, open_us, open_us % 3600000000 = 0 as aligned, open_us + 3599999999 as close_us, coalesce(open_us > lag(open_us) over (partition by symbol order by open_us), true) as increasing from bars""")
def time_contract(spark, d):
    by = W.partitionBy("symbol").orderBy("open_us")
    return bars(spark, d).select("symbol", "open_us", (F.pmod("open_us", F.lit(HOUR)) == 0).alias("aligned"), (F.col("open_us") + HOUR - 1).alias("close_us"), F.coalesce(F.col("open_us") > F.lag("open_us").over(by), F.lit(True)).alias("increasing"))


@query("w13_gaps", f"with {BARS}, l as (select symbol, open_us, lag(open_us) over (partition by symbol order by open_us) as p from bars) select symbol, p + 3600000000 as first_missing_us, open_us - 3600000000 as last_missing_us, (open_us - p) // 3600000000 - 1 as n_missing from l where open_us - p > 3600000000")
def gap_list(spark, d):
    return B.gaps(bars(spark, d), HOUR)


@query("u03_missing_grid", f"with {BARS}, g as (select symbol, unnest(generate_series(min(open_us), max(open_us), 3600000000)) as open_us from bars group by symbol) select * from g anti join bars using (symbol, open_us)")
def missing_grid(spark, d):
    return B.missing_grid(bars(spark, d), HOUR)


@query("a08_source_quality", f"""with {BARS}, l as (select *, lag(close) over w as p, lag(open_us) over w as t from bars window w as (partition by symbol order by open_us))
select symbol, count(*) as n_rows, (max(open_us) - min(open_us)) // 3600000000 + 1 - count(*) as missing_rows, count(*) filter (where taker = 0) as idle_rows, count(*) filter (where open_us - t = 3600000000 and abs(close / nullif(p, 0) - 1) > 0.5) as jumps from l group by symbol""")
def source_quality(spark, d):
    return B.source_quality(bars(spark, d), HOUR)


@query("a09_month_audit", f"""with {BARS} select symbol, strftime(make_timestamp(open_us), '%Y-%m') as month, count(*) as n_rows, min(open_us) as first_us, max(open_us) as last_us from bars group by 1, 2""")
def month_audit(spark, d):
    month = F.expr("date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, open_us / 1000000), 'yyyy-MM')")
    return bars(spark, d).groupBy("symbol", month.alias("month")).agg(F.count("*").alias("n_rows"), F.min("open_us").alias("first_us"), F.max("open_us").alias("last_us"))


@query("w03_segments", f"with {SEGMENTS} select symbol, open_us, segment, row_number() over (partition by symbol, segment order by open_us) as position, count(*) over (partition by symbol, segment) as length from segs")
def segment_rows(spark, d):
    by = W.partitionBy("symbol", "segment")
    return segs(spark, d).select("symbol", "open_us", "segment", F.row_number().over(by.orderBy("open_us")).cast("long").alias("position"), F.count("*").over(by).alias("length"))


@query("w12_day_intervals", f"""with {TICKS}, k as (select distinct user_id, us // 86400000000 as day from ticks), g as (select *, day - row_number() over (partition by user_id order by day) as g from k)
select user_id, min(day) as first_day, max(day) as last_day, count(*) as n_days from g group by user_id, g""")
def day_intervals(spark, d):
    days = ticks(spark, d).select("user_id", F.expr(f"us div {DAY}").alias("day"))
    return I.day_intervals(days, "user_id", "day")


@query("w01_returns", f"""with {SEGMENTS} select symbol, open_us, round(close / lag(close) over w - 1, 6) as return_1, round(close / lag(close, 2) over w - 1, 6) as return_2,
  round(ln(close / lag(close) over w), 6) as log_return from segs window w as (partition by symbol, segment order by open_us)""")
def returns(spark, d):
    f = Frame("symbol", "segment")
    c = F.col("close")
    return segs(spark, d).select("symbol", "open_us", F.round(c / f.lag("close", 1) - 1, 6).alias("return_1"), F.round(c / f.lag("close", 2) - 1, 6).alias("return_2"), F.round(F.ln(c / f.lag("close", 1)), 6).alias("log_return"))


@query("w02_rolling", f"""with {SEGMENTS} select symbol, open_us, case when count(*) over w = 4 then round(sum(turnover) over w, 6) end as sum_4, case when count(*) over w = 4 then round(avg(turnover) over w, 6) end as mean_4,
  case when count(*) over w = 4 then round(stddev_samp(turnover) over w, 4) end as std_4, case when count(*) over w = 4 then max(high) over w end as max_4, case when count(*) over w = 4 then min(low) over w end as min_4
  from segs window w as (partition by symbol, segment order by open_us rows between 3 preceding and current row)""")
def rolling(spark, d):
    f = Frame("symbol", "segment")
    return segs(spark, d).select("symbol", "open_us", F.round(f.roll(F.sum, "turnover", 4), 6).alias("sum_4"), F.round(f.roll(F.avg, "turnover", 4), 6).alias("mean_4"), F.round(f.roll(F.stddev_samp, "turnover", 4), 4).alias("std_4"), f.roll(F.max, "high", 4).alias("max_4"), f.roll(F.min, "low", 4).alias("min_4"))


_BASE = f"""with {SEGMENTS}, f0 as (select *, ln(close / lag(close) over w) as lr,
    case when count(*) over w2 = 2 then sum(turnover) over w2 end as q_s, case when count(*) over w2 = 2 then sum(taker) over w2 end as b_s, case when count(*) over w2 = 2 then sum(trades) over w2 end as n_s,
    case when count(*) over w4 = 4 then sum(turnover) over w4 end as q_l, case when count(*) over w4 = 4 then sum(taker) over w4 end as b_l,
    case when count(*) over w3 = 3 then sum(turnover) over w3 end as q_m, case when count(*) over w3 = 3 then sum(taker) over w3 end as b_m,
    case when count(*) over w6 = 6 then sum(turnover) over w6 end as q_d
  from segs window w as (partition by symbol, segment order by open_us), w2 as (partition by symbol, segment order by open_us rows between 1 preceding and current row),
    w3 as (partition by symbol, segment order by open_us rows between 2 preceding and current row), w4 as (partition by symbol, segment order by open_us rows between 3 preceding and current row),
    w6 as (partition by symbol, segment order by open_us rows between 5 preceding and current row)),
f1 as (select *, greatest(lr, 0) as up, close / lag(close) over w - 1 as return_1, close / lag(close, 2) over w - 1 as return_short, close / lag(close, 3) over w - 1 as return_middle, close / lag(close, 4) over w - 1 as return_long, close / lag(close, 5) over w - 1 as return_horizon,
    case when count(lr) over w4 = 4 then stddev_samp(lr) over w4 end as volatility_long, case when count(lr) over w5 = 5 then stddev_samp(lr) over w5 end as volatility_horizon,
    case when count(*) over w4 = 4 then close / max(close) over w4 - 1 end as drawdown_long, case when count(*) over w5 = 5 then close / max(close) over w5 - 1 end as drawdown_horizon,
    case when count(*) over p4 = 4 then ln(((q_s + 1) / (n_s + 1)) / ((sum(turnover) over p4 + 1) / (sum(trades) over p4 + 1))) end as trade_size_change,
    case when count(*) over w4 = 4 then max(high) over w4 / min(low) over w4 - 1 end as range_long,
    case when high > low then (close - low) / (high - low) else 0.5 end as close_location,
    lag(close, 2) over w / lag(close, 4) over w - 1 as return_previous,
    case when count(*) over p4 = 4 then ln((q_s + 1) / (avg(turnover) over p4 * 2 + 1)) end as activity_short,
    case when count(*) over p5 = 5 then ln((q_l + 1) / (avg(turnover) over p5 * 4 + 1)) end as activity_long,
    case when count(*) over p4 = 4 then ln((n_s + 1) / (avg(trades) over p4 * 2 + 1)) end as trade_activity,
    case when q_s is not null then case when q_s > 0 then b_s / q_s else 0.5 end end as buy_short,
    case when q_l is not null then case when q_l > 0 then b_l / q_l else 0.5 end end as buy_long,
    case when q_m is not null then case when q_m > 0 then b_m / q_m else 0.5 end end as buy_middle,
    ln(1 + q_d) as log_turnover
  from f0 window w as (partition by symbol, segment order by open_us), w4 as (partition by symbol, segment order by open_us rows between 3 preceding and current row),
    w5 as (partition by symbol, segment order by open_us rows between 4 preceding and current row),
    p4 as (partition by symbol, segment order by open_us rows between 5 preceding and 2 preceding), p5 as (partition by symbol, segment order by open_us rows between 8 preceding and 4 preceding))"""


@query("w06_price_features", _BASE + " select symbol, open_us, " + ", ".join(f"round({c}, 6) as {c}" for c in X.PRICE) + " from f1")
def price_features(spark, d):
    return X.enrich(segs(spark, d), S).select("symbol", "open_us", *map(r6, X.PRICE))


@query("w06_flow_features", _BASE + " select symbol, open_us, " + ", ".join(f"round({c}, 6) as {c}" for c in X.FLOW if c != "buy_change") + ", round(buy_short - buy_long, 6) as buy_change from f1")
def flow_features(spark, d):
    return X.enrich(segs(spark, d), S).select("symbol", "open_us", *map(r6, X.FLOW))


@query("w06_path_features", _BASE + """ select symbol, open_us,
  case when count(lr) over w3 = 3 then round(case when sum(abs(lr)) over w3 > 0 then sum(lr) over w3 / sum(abs(lr)) over w3 else 0 end, 6) end as path_efficiency,
  case when count(up) over w3 = 3 then round(case when sum(up) over w3 > 0 then max(up) over w3 / sum(up) over w3 else 0 end, 6) end as up_impulse,
  case when count(lr) over w3 = 3 then round(avg((lr > 0)::double) over w3, 6) end as positive_fraction,
  case when count(*) over w4 = 4 then round(case when max(close) over w4 > min(close) over w4 then (close - min(close) over w4) / (max(close) over w4 - min(close) over w4) else 0.5 end, 6) end as close_position,
  case when count(lr) over w3 = 3 and count(lr) over p4 = 4 then round(stddev_samp(lr) over w3 / (stddev_samp(lr) over p4 + 1e-8), 5) end as compression,
  round(ln(close / lag(close, 2) over w) / (volatility_long * sqrt(2.0) + 1e-6), 5) as scaled_return
  from f1 window w as (partition by symbol, segment order by open_us), w3 as (partition by symbol, segment order by open_us rows between 2 preceding and current row),
  w4 as (partition by symbol, segment order by open_us rows between 3 preceding and current row), p4 as (partition by symbol, segment order by open_us rows between 6 preceding and 3 preceding)""")
def path_features(spark, d):
    out = X.enrich(segs(spark, d), S)
    five = [F.round(c, 5).alias(c) for c in ("compression", "scaled_return")]
    return out.select("symbol", "open_us", r6("path_efficiency"), F.round("up_impulse", 6).alias("up_impulse"), r6("positive_fraction"), r6("close_position"), *five)


@query("w06_dynamics", _BASE + """ select symbol, open_us, round(ln((q_s + 1) / (lag(q_s, 2) over w + 1)), 6) as turnover_change, round(lag(buy_short, 2) over w, 6) as buy_previous,
  round(buy_short - lag(buy_short, 2) over w, 6) as buy_acceleration, round(return_short - return_previous, 6) as price_acceleration, round((2 * buy_middle - 1) * return_middle, 6) as agreement, round(trade_size_change, 6) as trade_size_change
  from f1 window w as (partition by symbol, segment order by open_us)""")
def dynamics(spark, d):
    return X.enrich(segs(spark, d), S).select("symbol", "open_us", *map(r6, X.DYNAMICS))


@query("p07_eligible", _BASE + " select symbol, open_us from f1 where q_d >= 100 and volatility_long is not null and activity_long is not null and return_long is not null and ends_with(symbol, 'e')")
def eligible(spark, d):
    fit = F.lit(True)
    for c in ("volatility_long", "activity_long", "return_long"):
        fit = fit & I.finite(c)
    return X.enrich(segs(spark, d), S).where((F.col("q_d") >= 100) & fit & F.col("symbol").endswith("e")).select("symbol", "open_us")


@query("w05_observability", f"""with {BARS}, v as (select *, turnover < 60 as valid from bars), a as (select *, valid and trades > 0 and turnover > 0 as seen, case when open_us - lag(open_us) over w = 3600000000 and lag(valid) over w and valid then 0 else 1 end as f from v window w as (partition by symbol order by open_us)),
b as (select *, sum(f) over (partition by symbol order by open_us) as s from a), c as (select *, case when valid then row_number() over (partition by symbol, s order by open_us) else 0 end as contiguous,
  (open_us - last_value(case when seen then open_us end ignore nulls) over (partition by symbol order by open_us)) / 3600000000 as last_traded_age, avg(seen::int) over (partition by symbol order by open_us rows between 3 preceding and current row) as fraction from b)
select symbol, open_us, contiguous::bigint as contiguous, last_traded_age, case when contiguous >= 4 then round(fraction, 6) end as observed_fraction, contiguous >= 3 and seen as origin_admissible,
  case when not valid then 'invalid_bar' when contiguous < 3 then 'insufficient_contiguous_history' when not seen then 'origin_without_trade' else 'admitted' end as selection_reason from c""")
def observability(spark, d):
    out = X.observability(bars(spark, d).withColumn("valid", F.col("turnover") < 60), HOUR, 3, mean_of=4)
    return out.select("symbol", "open_us", F.col("contiguous").cast("long").alias("contiguous"), "last_traded_age", r6("observed_fraction"), "origin_admissible", "selection_reason")


@query("p08_batch_eligible", _BASE + """, l as (select *, count(*) over (partition by symbol, segment) as length from f1), x as (select *, case when count(lr) over w3 = 3 and sum(abs(lr)) over w3 >= 0 and count(lr) over p4 = 4 and stddev_samp(lr) over w3 is not null and stddev_samp(lr) over p4 is not null then 1 end as path_known, lag(q_s, 2) over w as q_before, lag(buy_short, 2) over w as b_before
  from l window w as (partition by symbol, segment order by open_us), w3 as (partition by symbol, segment order by open_us rows between 2 preceding and current row), p4 as (partition by symbol, segment order by open_us rows between 6 preceding and 3 preceding))
select symbol, open_us from x where length >= 9 and open_us % 7200000000 = 3600000000 and q_d >= 100 and path_known = 1 and q_before is not null and b_before is not null and """ + " and ".join(f"{c} is not null and isfinite({c})" for c in [*X.PRICE, "activity_short", "activity_long", "trade_activity", "buy_short", "buy_long", "log_turnover", "trade_size_change"]))
def batch_eligible(spark, d):
    """All 31 features finite, on the grid of two hours, in segments of nine bars and more."""
    rows = X.enrich(X.long_segments(segs(spark, d), 9), S).withColumn("decision_us", F.col("open_us") + HOUR)
    return X.eligible(rows, 2 * HOUR, 100).select("symbol", "open_us")


@query("a03_peer_context", f"""with {SEGMENTS}, x as (select symbol, open_us, close / lag(close) over w - 1 as s, close / lag(close, 2) over w - 1 as m, close / lag(close, 3) over w - 1 as l from segs window w as (partition by symbol, segment order by open_us)),
y as (select * from x where l is not null), t as (select *, count(*) over c - 1 as n, sum(s) over c as ts, sum(m) over c as tm, sum(l) over c as tl, sum(m * m) over c as tmm, count(*) filter (where m > 0) over c as up from y window c as (partition by open_us))
select symbol, open_us, case when n >= 2 then round((ts - s) / n, 6) end as peer_return, case when n >= 2 then round(s - (ts - s) / n, 6) end as relative_short, case when n >= 2 then round(l - (tl - l) / n, 6) end as relative_long,
  case when n >= 2 then round((up - (m > 0)::int) / n, 6) end as peer_positive, case when n >= 2 then round(sqrt(greatest((tmm - m * m) / n - ((tm - m) / n) ** 2, 0)), 5) end as peer_dispersion from t""")
def peer_context(spark, d):
    f = Frame("symbol", "segment")
    change = lambda n: F.try_divide(F.col("close"), f.lag("close", n)) - 1
    rows = segs(spark, d).select("symbol", "open_us", change(1).alias("s"), change(2).alias("m"), change(3).alias("l")).where("l is not null")
    out = X.peers(rows, "open_us", "s", "m", "l", minimum=2)
    return out.select("symbol", "open_us", r6("peer_return"), r6("relative_short"), r6("relative_long"), r6("peer_positive"), F.round("peer_dispersion", 5).alias("peer_dispersion"))


@query("w07_sequence", f"""with {SEGMENTS}, x as (select symbol, open_us, segment, round((close / lag(close) over w - 1) * 10000)::bigint as r, round(ln(1 + turnover) * 10000)::bigint as q from segs window w as (partition by symbol, segment order by open_us))
select symbol, open_us, concat_ws(',', lag(r, 2) over w, lag(r) over w, r) as returns, concat_ws(',', lag(q, 2) over w, lag(q) over w, q) as turnovers from x window w as (partition by symbol, segment order by open_us) qualify lag(r, 2) over w is not null""")
def sequence(spark, d):
    out = X.past_sequence(segs(spark, d), 3).where("c_returns is not null")
    told = lambda c: F.concat_ws(",", F.transform(c, lambda v: F.round(v * 10000).cast("long").cast("string")))
    return out.select("symbol", "open_us", told("c_returns").alias("returns"), told("c_turnovers").alias("turnovers"))


@query("w08_sequence_context", f"""with {SEGMENTS}, x as (select *, close / lag(close) over w - 1 as r, row_number() over w as n from segs window w as (partition by symbol, segment order by open_us))
select symbol, open_us, round((1 + r) * (1 + lag(r) over w) * (1 + lag(r, 2) over w) - 1, 6) as x_return, round(stddev_samp(ln(1 + r)) over w3, 5) as x_volatility,
  round(ln((turnover + 1) / ((lag(turnover) over w + lag(turnover, 2) over w) / 2 + 1)), 6) as x_activity, round(sum(taker) over w3 / sum(turnover) over w3, 6) as x_buy
from x window w as (partition by symbol, segment order by open_us), w3 as (partition by symbol, segment order by open_us rows between 2 preceding and current row) qualify lag(r, 2) over w is not null""")
def sequence_context(spark, d):
    out = X.sequence_context(X.past_sequence(segs(spark, d), 3).where("c_returns is not null"))
    return out.select("symbol", "open_us", r6("x_return"), F.round("x_volatility", 5).alias("x_volatility"), r6("x_activity"), r6("x_buy"))


@query("w09_future_max", f"with {SEGMENTS} select symbol, open_us, case when count(*) over w = 5 then round(max(close) over w / close - 1, 6) end as label from segs window w as (partition by symbol, segment order by open_us rows between current row and 4 following)")
def future_max(spark, d):
    f = Frame("symbol", "segment")
    return segs(spark, d).select("symbol", "open_us", F.round(f.ahead(F.max, "close", 0, 4) / F.col("close") - 1, 6).alias("label"))


@query("w10_path_targets", f"""with {SEGMENTS}, p as (select symbol, open_us, close, [close, lead(close, 1) over w, lead(close, 2) over w, lead(close, 3) over w, lead(close, 4) over w] as path from segs window w as (partition by symbol, segment order by open_us) qualify lead(close, 4) over w is not null),
r as (select *, list_transform(path, lambda c: c / close - 1) as r from p),
t as (select *, list_max(r) as up, -list_min(r) as down, r[5] as terminal, abs(r[2] - r[1]) + abs(r[3] - r[2]) + abs(r[4] - r[3]) + abs(r[5] - r[4]) as travel, list_position(list_transform(r, lambda v: v >= 0.5), true) as u, list_position(list_transform(r, lambda v: -v >= 0.5), true) as dn from r)
select symbol, open_us, round(up, 6) as up, round(down, 6) as down, round(terminal, 6) as terminal, case when up > 0 then round(greatest(terminal, 0) / up, 6) end as retention_up, case when down > 0 then round(greatest(-terminal, 0) / down, 6) end as retention_down,
  round(case when travel > 0 then terminal / travel else 0 end, 6) as efficiency, ((r[2] > 0)::int + (r[3] > 0)::int + (r[4] > 0)::int + (r[5] > 0)::int) / 4 as above_fraction, ((r[2] < 0)::int + (r[3] < 0)::int + (r[4] < 0)::int + (r[5] < 0)::int) / 4 as below_fraction,
  round(greatest(0, 1 - path[2] / list_max(path[1:2]), 1 - path[3] / list_max(path[1:3]), 1 - path[4] / list_max(path[1:4]), 1 - path[5] / list_max(path)), 6) as drawdown,
  (list_position(r, up) - 1)::int as peak_step, (list_position(r, -down) - 1)::int as trough_step, (coalesce(u, 0) > 0)::int as up_hit, (u - 1)::int as up_first, case when u > 0 then round(greatest(0, -list_min(r[1:u])), 6) end as up_adverse,
  (coalesce(dn, 0) > 0)::int as down_hit, (dn - 1)::int as down_first, case when dn > 0 then round(greatest(0, list_max(r[1:dn])), 6) end as down_adverse from t""")
def path_targets(spark, d):
    rows = L.future_path(segs(spark, d), 4).where("path is not null")
    out = L.path_targets(rows, 4, 0.5)
    six = ["up", "down", "terminal", "retention_up", "retention_down", "efficiency", "drawdown", "up_adverse", "down_adverse"]
    return out.select("symbol", "open_us", *map(r6, six), "above_fraction", "below_fraction", "peak_step", "trough_step", "up_hit", "up_first", "down_hit", "down_first")


_SIGMA = f"""with {SEGMENTS}, s0 as (select *, close / lag(close) over w - 1 as ret from segs window w as (partition by symbol, segment order by open_us)),
s1 as (select *, case when count(ret) over (partition by symbol, segment order by open_us rows between 4 preceding and current row) >= 2 then sqrt(avg(ret * ret) over (partition by symbol, segment order by open_us rows between 4 preceding and current row)) end as sigma from s0)"""


@query("w11_sigma", _SIGMA + " select symbol, open_us, round(sigma, 5) as sigma from s1")
def sigma(spark, d):
    return L.causal_sigma(segs(spark, d), 5, 2).select("symbol", "open_us", F.round("sigma", 5).alias("sigma"))


@query("w14_first_hit", f"""with {SEGMENTS} select symbol, open_us, case when lead(high, 1) over w >= close * 1.5 then 1 when lead(high, 2) over w >= close * 1.5 then 2 when lead(high, 3) over w >= close * 1.5 then 3 end as up_step,
  case when lead(low, 1) over w <= close * 0.5 then 1 when lead(low, 2) over w <= close * 0.5 then 2 when lead(low, 3) over w <= close * 0.5 then 3 end as low_step from segs window w as (partition by symbol, segment order by open_us)""")
def first_hit(spark, d):
    rows = segs(spark, d).withColumns({"top": F.col("close") * 1.5, "floor": F.col("close") * 0.5})
    return L.first_hit_steps(rows, 3, "top", "floor").select("symbol", "open_us", "up_step", "low_step")


@query("w15_range_extreme", f"with {SEGMENTS} select symbol, open_us, case when count(*) over w = 3 then max(high) over w end as top, case when count(*) over w = 3 then min(low) over w end as bottom from segs window w as (partition by symbol, segment order by open_us rows between 1 following and 3 following)")
def range_extreme(spark, d):
    f = Frame("symbol", "segment")
    return segs(spark, d).select("symbol", "open_us", f.ahead(F.max, "high", 1, 3).alias("top"), f.ahead(F.min, "low", 1, 3).alias("bottom"))


_BARRIER = _SIGMA + """, b0 as (select *, case when trades % 11 = 0 then null else trades % 13 <> 0 end as eligible, lead(open) over w as entry, lead(close, 3) over w as last, [lead(high, 1) over w, lead(high, 2) over w, lead(high, 3) over w] as hs, [lead(low, 1) over w, lead(low, 2) over w, lead(low, 3) over w] as ls
  from s1 window w as (partition by symbol, segment order by open_us)),
b1 as (select *, entry * (1 + 0.5 * sigma) as top, entry * (1 - 0.4 * sigma) as floor from b0),
b2 as (select *, case when hs[1] >= top then 1 when hs[2] >= top then 2 when hs[3] >= top then 3 end as u, case when ls[1] <= floor then 1 when ls[2] <= floor then 2 when ls[3] <= floor then 3 end as l from b1),
b3 as (select *, case when eligible is null then 'missing_eligibility' when not eligible then 'ineligible' when sigma is null then 'no_volatility' when sigma = 0 then 'zero_volatility' when last is null then 'incomplete_horizon'
  when l <= coalesce(u, 4) then 'lower_barrier' when u is not null then 'upper_barrier' else 'expiry' end as exit from b2),
b4 as (select symbol, open_us, exit, case exit when 'lower_barrier' then l when 'upper_barrier' then u when 'expiry' then 3 end as exit_step,
  case exit when 'lower_barrier' then floor when 'upper_barrier' then top when 'expiry' then last end * (1 - 0.0015::double) / (entry * (1 + 0.0015::double)) - 1 as net from b3),
lab as (select *, case when exit_step is null then 'unavailable' when exit = 'upper_barrier' and net > 0 then 'positive' else 'negative' end as outcome from b4)"""


def barrier_labels(spark, d):
    rows = L.causal_sigma(segs(spark, d), 5, 2).withColumn("eligible", F.when(F.col("trades") % 11 != 0, F.col("trades") % 13 != 0))
    return L.triple_barrier(rows, 3, 0.5, 0.4, 15)


@query("w16_triple_barrier", _BARRIER + " select symbol, open_us, exit, exit_step, round(net, 5) as net_return, outcome from lab")
def triple_barrier(spark, d):
    return barrier_labels(spark, d).select("symbol", "open_us", "exit", "exit_step", F.round("net_return", 5).alias("net_return"), "outcome")


@query("a04_exit_counts", _BARRIER + " select outcome, exit, count(*) as n from lab group by all")
def exit_counts(spark, d):
    return barrier_labels(spark, d).groupBy("outcome", "exit").agg(F.count("*").alias("n"))


@query("a05_prevalence", _BARRIER + " select symbol, count(*) as total, count(*) filter (where outcome <> 'unavailable') as available, count(*) filter (where outcome = 'positive') as positive, count(*) filter (where outcome = 'negative') as negative, round(count(*) filter (where outcome = 'positive') / nullif(count(*) filter (where outcome <> 'unavailable'), 0), 6) as positive_rate from lab group by symbol")
def prevalence(spark, d):
    return L.prevalence(barrier_labels(spark, d), "symbol").withColumn("positive_rate", F.round("positive_rate", 6))


@query("w18_episodes", _BARRIER + """, pos as (select symbol, open_us, open_us + exit_step * 3600000000 as exit_us from lab where outcome = 'positive'),
n as (select *, case when open_us > max(exit_us) over (partition by symbol order by open_us, exit_us rows between unbounded preceding and 1 preceding) then 1 when row_number() over (partition by symbol order by open_us, exit_us) = 1 then 1 else 0 end as f from pos)
select symbol, open_us, exit_us, (sum(f) over (partition by symbol order by open_us, exit_us))::bigint as episode from n""")
def episodes(spark, d):
    rows = barrier_labels(spark, d).where("outcome = 'positive'").select("symbol", "open_us", (F.col("open_us") + F.col("exit_step") * F.lit(HOUR)).alias("exit_us"))
    return I.episodes(rows, ["symbol"], "open_us", "exit_us")


@query("w20_greedy_spacing", f"""with recursive {TICKS}, t as (select user_id, us, row_number() over (partition by user_id order by us) as k from (select distinct user_id, us from ticks)),
g as (select user_id, us, k, us as kept, true as keep from t where k = 1 union all select t.user_id, t.us, t.k, case when t.us > g.kept + 86400000000 then t.us else g.kept end, t.us > g.kept + 86400000000 from g join t on t.user_id = g.user_id and t.k = g.k + 1) select user_id, us from g where keep""")
def spacing(spark, d):
    rows = ticks(spark, d).select("user_id", "us").distinct()
    return I.greedy_spacing(rows, "user_id", "us", DAY)


@query("w22_purged_folds", f"""with {TICKS}, t as (select distinct us - us % 3600000000 as us from ticks), n as (select count(*) as n, ceil(count(*) / 5)::bigint as h from t), k as (select us, row_number() over (order by us) - 1 as position from t),
f as (select us, position, case when position >= n - h then 3 when position >= 2 * (n - h) // 3 then 2 when position >= (n - h) // 3 then 1 else 0 end as fold from k, n), m as (select fold - 1 as fold, min(us) as s from f group by fold)
select f.us, f.position::int as position, f.fold::int as fold, coalesce(f.us + 7200000000 >= m.s, false) as purged from f left join m using (fold)""")
def folds(spark, d):
    hours = ticks(spark, d).select(B.bucket_start("us", HOUR).alias("us")).distinct()
    return I.purged_folds(hours, "us", 3, 1, 5, 2 * HOUR)


_STAGE = f"""with {SEGMENTS}, a as (select *, case when count(*) over p = 6 then avg(turnover) over p end as mean, case when count(*) over p = 6 then stddev_pop(turnover) over p end as deviation,
  case when lag(close, 2) over w is not null then 0.5 * close + 0.25 * lag(close) over w + 0.25 * lag(close, 2) over w end as average
  from segs window w as (partition by symbol, segment order by open_us), p as (partition by symbol, segment order by open_us rows between 6 preceding and 1 preceding)),
b as (select *, turnover / case when mean > 0 then mean end as ratio, case when deviation > 0 then (turnover - mean) / deviation end as z, close / average - 1 as premium, 2 * taker - turnover as net_taker from a),
c as (select *, case when ratio >= 2 and z >= 2 and net_taker > 0 then 2 when ratio >= 1.5 and z >= 1 then 1 else 0 end as stage from b),
s as (select *, stage > coalesce(lag(stage) over (partition by symbol, segment order by open_us), 0) as upgraded from c)"""


@query("alert_stage", _STAGE + " select symbol, open_us, round(ratio, 5) as ratio, round(z, 4) as z, round(premium, 5) as premium, stage from s where upgraded order by stage desc, ratio desc, symbol limit 30")
def alert_stage(spark, d):
    """Flagship: ticks to bars, segments, rolling context, stages, upgrades, ranking."""
    out = L.alert_stages(segs(spark, d), 6, 3).where("upgraded").orderBy(F.desc("stage"), F.desc("ratio"), "symbol").limit(30)
    return out.select("symbol", "open_us", F.round("ratio", 5).alias("ratio"), F.round("z", 4).alias("z"), F.round("premium", 5).alias("premium"), "stage")


@query("w23_stages", _STAGE + " select symbol, open_us, round(mean, 5) as mean, round(z, 4) as z, round(net_taker, 5) as net_taker, stage, upgraded from s where mean is not null")
def stages(spark, d):
    out = L.alert_stages(segs(spark, d), 6, 3).where("mean is not null")
    return out.select("symbol", "open_us", F.round("mean", 5).alias("mean"), F.round("z", 4).alias("z"), F.round("net_taker", 5).alias("net_taker"), "stage", "upgraded")
