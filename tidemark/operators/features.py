"""Causal features of bars: price, flow, path, dynamics, peers, bucketed sequences. Windows are in rows of one segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.islands import finite
from tidemark.operators.rolling import Frame, ratio


@dataclass(frozen=True)
class FeatureSpec:
    """Window lengths in rows; minute bars use the defaults."""

    short: int = 5
    middle: int = 15
    long: int = 60
    base: int = 1380
    day: int = 1440
    horizon: int = 360


def enrich(bars: DataFrame, s: FeatureSpec = FeatureSpec(), key: tuple = ("symbol", "segment")) -> DataFrame:
    """Price, flow, path and dynamics features of every bar. All frames share one partitioning and order: one shuffle
    and one sort serve them."""
    f = Frame(*key)
    x = F.col
    d = bars.withColumn("lr", F.when(f.lag("close", 1) > 0, F.ln(F.try_divide(x("close"), f.lag("close", 1)))))
    d = d.withColumns({
        "q_s": f.roll(F.sum, "turnover", s.short), "b_s": f.roll(F.sum, "taker", s.short), "n_s": f.roll(F.sum, "trades", s.short),
        "q_p": f.roll(F.sum, "turnover", s.long, s.short), "n_p": f.roll(F.sum, "trades", s.long, s.short),
        "q_l": f.roll(F.sum, "turnover", s.long), "b_l": f.roll(F.sum, "taker", s.long),
        "q_m": f.roll(F.sum, "turnover", s.middle), "b_m": f.roll(F.sum, "taker", s.middle), "q_d": f.roll(F.sum, "turnover", s.day),
        "up": F.greatest(x("lr"), F.lit(0.0)),
    })
    change = lambda n: F.try_divide(x("close"), f.lag("close", n)) - 1
    d = d.withColumns({
        "return_1": change(1), "return_short": change(s.short), "return_middle": change(s.middle), "return_long": change(s.long), "return_horizon": change(s.horizon),
        "volatility_long": f.roll(F.stddev_samp, "lr", s.long), "volatility_horizon": f.roll(F.stddev_samp, "lr", s.horizon),
        "drawdown_long": F.try_divide(x("close"), f.roll(F.max, "close", s.long)) - 1,
        "drawdown_horizon": F.try_divide(x("close"), f.roll(F.max, "close", s.horizon)) - 1,
        "range_long": F.try_divide(f.roll(F.max, "high", s.long), f.roll(F.min, "low", s.long)) - 1,
        "close_location": F.when(x("high") > x("low"), (x("close") - x("low")) / (x("high") - x("low"))).otherwise(0.5),
        "return_previous": F.try_divide(f.lag("close", s.short), f.lag("close", 2 * s.short)) - 1,
        "activity_short": F.ln((x("q_s") + 1) / (f.roll(F.avg, "turnover", s.long, s.short) * s.short + 1)),
        "activity_long": F.ln((x("q_l") + 1) / (f.roll(F.avg, "turnover", s.base, s.long) * s.long + 1)),
        "trade_activity": F.ln((x("n_s") + 1) / (f.roll(F.avg, "trades", s.long, s.short) * s.short + 1)),
        "buy_short": F.when(x("q_s").isNotNull(), ratio(x("b_s"), x("q_s"), 0.5)),
        "buy_long": F.when(x("q_l").isNotNull(), ratio(x("b_l"), x("q_l"), 0.5)),
        "buy_middle": F.when(x("q_m").isNotNull(), ratio(x("b_m"), x("q_m"), 0.5)),
        "log_turnover": F.log1p("q_d"),
    })
    travel = f.roll(F.sum, F.abs(x("lr")), s.middle)
    rise = f.roll(F.sum, "up", s.middle)
    top, bottom = f.roll(F.max, "close", s.long), f.roll(F.min, "close", s.long)
    return d.withColumns({
        "buy_change": x("buy_short") - x("buy_long"),
        "path_efficiency": F.when(travel.isNotNull(), ratio(f.roll(F.sum, "lr", s.middle), travel, 0.0)),
        "up_impulse": F.when(rise.isNotNull(), ratio(f.roll(F.max, "up", s.middle), rise, 0.0)),
        "positive_fraction": f.roll(F.avg, (x("lr") > 0).cast("double"), s.middle),
        "close_position": F.when(top.isNotNull(), F.when(top > bottom, (x("close") - bottom) / (top - bottom)).otherwise(0.5)),
        "compression": f.roll(F.stddev_samp, "lr", s.middle) / (f.roll(F.stddev_samp, "lr", s.long, s.middle) + 1e-8),
        "scaled_return": F.ln(F.try_divide(x("close"), f.lag("close", s.short))) / (x("volatility_long") * F.sqrt(F.lit(float(s.short))) + 1e-6),
        "turnover_change": F.ln((x("q_s") + 1) / (f.lag("q_s", s.short) + 1)),
        "buy_previous": f.lag("buy_short", s.short),
        "buy_acceleration": x("buy_short") - f.lag("buy_short", s.short),
        "price_acceleration": x("return_short") - x("return_previous"),
        "agreement": (2 * x("buy_middle") - 1) * x("return_middle"),
        "trade_size_change": F.ln(((x("q_s") + 1) / (x("n_s") + 1)) / ((x("q_p") + 1) / (x("n_p") + 1))),
    })


PRICE = ["return_1", "return_short", "return_middle", "return_long", "return_horizon", "volatility_long", "volatility_horizon", "drawdown_long", "drawdown_horizon", "range_long", "close_location", "return_previous"]
FLOW = ["activity_short", "activity_long", "trade_activity", "buy_short", "buy_long", "buy_change", "log_turnover"]
PATH = ["path_efficiency", "up_impulse", "positive_fraction", "close_position", "compression", "scaled_return"]
DYNAMICS = ["turnover_change", "buy_previous", "buy_acceleration", "price_acceleration", "agreement", "trade_size_change"]
#: All 31 features of a batch.
BATCH = [*PRICE, *FLOW, *PATH, *DYNAMICS]


def peers(rows: DataFrame, clock: str, short: str, middle: str, long: str, minimum: int = 20) -> DataFrame:
    """Leave-one-out context of each row among all rows of its clock; null under `minimum` peers. Totals by clock are
    a small aggregate joined back, so one busy clock is not sorted into one task."""
    totals = rows.groupBy(clock).agg(F.count("*").alias("_n"), F.sum(short).alias("_s"), F.sum(long).alias("_l"), F.sum(middle).alias("_m"), F.sum(F.col(middle) * F.col(middle)).alias("_mm"), F.count_if(F.col(middle) > 0).alias("_up"))
    d = rows.join(totals, clock)
    n = F.col("_n") - 1
    x = F.col
    mean_m = (x("_m") - x(middle)) / n
    told = lambda c: F.when(n >= max(1, minimum), c)
    return d.withColumns({
        "peer_return": told((x("_s") - x(short)) / n),
        "relative_short": told(x(short) - (x("_s") - x(short)) / n),
        "relative_long": told(x(long) - (x("_l") - x(long)) / n),
        "peer_positive": told((x("_up") - (x(middle) > 0).cast("int")) / n),
        "peer_dispersion": told(F.sqrt(F.greatest((x("_mm") - x(middle) * x(middle)) / n - mean_m * mean_m, F.lit(0.0)))),
    }).drop("_n", "_s", "_l", "_m", "_mm", "_up")


def past_sequence(bars: DataFrame, width: int, step: int = 1, key: tuple = ("symbol", "segment")) -> DataFrame:
    """Six channels of `width` buckets of `step` bars, oldest first, ending at each bar; null without a full history."""
    f = Frame(*key)
    x = F.col
    q = f.roll(F.sum, "turnover", step)
    d = bars.withColumns({
        "c_return": F.try_divide(x("close"), f.lag("close", step)) - 1,
        "c_range": F.try_divide(f.roll(F.max, "high", step), f.roll(F.min, "low", step)) - 1,
        "c_turnover": F.log1p(q), "c_trades": F.log1p(f.roll(F.sum, "trades", step)),
        "c_buy": F.when(q.isNotNull(), ratio(f.roll(F.sum, "taker", step), q, 0.5)),
        "c_seen": f.roll(F.avg, ((x("trades") > 0) & (x("turnover") > 0)).cast("double"), step),
    })
    names = ["c_return", "c_range", "c_turnover", "c_trades", "c_buy", "c_seen"]
    lists = {c: F.array(*[(f.lag(c, k * step) if k else x(c)) for k in range(width - 1, -1, -1)]) for c in names}
    full = f.lag("c_return", (width - 1) * step).isNotNull()
    return d.withColumns({f"{c}s": F.when(full, a) for c, a in lists.items()}).drop(*names)


def sequence_context(rows: DataFrame) -> DataFrame:
    """Compounded return, volatility (ddof 1), activity against the earlier buckets, weighted buy share, observed share."""
    r = "c_returns"
    n = F.size(r)
    logs = F.transform(r, lambda v: F.log1p(v))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, v: a + v) / n
    q = F.transform("c_turnovers", lambda v: F.expm1(v))
    total = F.aggregate(q, F.lit(0.0), lambda a, v: a + v)
    return rows.withColumns({
        "x_return": F.aggregate(r, F.lit(1.0), lambda a, v: a * (1 + v)) - 1,
        "x_volatility": F.sqrt(F.aggregate(logs, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / (n - 1)),
        "x_activity": F.ln((F.element_at(q, -1) + 1) / ((total - F.element_at(q, -1)) / (n - 1) + 1)),
        "x_buy": ratio(F.aggregate(F.zip_with(q, "c_buys", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v), total, 0.5),
        "x_seen": F.aggregate("c_seens", F.lit(0.0), lambda a, v: a + v) / n,
    })


def eligible(rows: DataFrame, step: int, floor: float, names: list[str] = BATCH, turnover: str = "q_d", decision: str = "decision_us") -> DataFrame:
    """Rows whose decision lies on the step's grid, whose day's turnover reaches the floor and whose features are finite."""
    fit = (F.pmod(F.col(decision), F.lit(step)) == 0) & (F.col(turnover) >= floor)
    for c in names:
        fit = fit & finite(c)
    return rows.where(fit)


def long_segments(bars: DataFrame, least: int, key: tuple = ("symbol", "segment")) -> DataFrame:
    """Bars of segments of at least `least` bars; shorter ones have no feature row."""
    long = bars.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return bars.join(long, list(key), "left_semi")


def observability(rows: DataFrame, step: int, history: int, key: str = "symbol", mean_of: int = 60) -> DataFrame:
    """Islands that keep invalid rows, the age of the last traded bar (across gaps), the share of observed bars among
    the last `mean_of` (null before so many valid ones in a row), and the reason of selection."""
    by = W.partitionBy(key).orderBy("open_us")
    near = (F.col("open_us") - F.lag("open_us").over(by) == step) & F.lag("valid").over(by) & F.col("valid")
    d = rows.withColumn("_f", F.when(near, 0).otherwise(1)).withColumn("_s", F.sum("_f").over(by))
    d = d.withColumn("_seen", F.col("valid") & (F.col("trades") > 0) & (F.col("turnover") > 0))
    inside = W.partitionBy(key, "_s").orderBy("open_us")
    traded = F.when(F.col("_seen"), F.col("open_us"))
    d = d.withColumn("contiguous", F.when(F.col("valid"), F.row_number().over(inside)).otherwise(0))
    d = d.withColumn("last_traded_age", (F.col("open_us") - F.last(traded, True).over(by.rowsBetween(W.unboundedPreceding, 0))) / step)
    d = d.withColumn("observed_fraction", F.when(F.col("contiguous") >= mean_of, F.avg(F.col("_seen").cast("double")).over(by.rowsBetween(1 - mean_of, 0))))
    ready = F.col("contiguous") >= history
    reason = F.when(~F.col("valid"), "invalid_bar").when(~ready, "insufficient_contiguous_history").when(~F.col("_seen"), "origin_without_trade").otherwise("admitted")
    return d.withColumns({"selection_reason": reason, "origin_admissible": ready & F.col("_seen")}).drop("_f", "_s", "_seen")
