"""Labels from the future of a bar: extremes, path targets, threshold hits, triple barriers, their accounts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidemark.operators.rolling import Frame

#: Horizons up to this many bars are arrays of leads in one window; longer ones are slid over blocks of rows.
SHORT = 8


def ahead_of(bars: DataFrame, horizon: int, columns: list[str], slide: Callable, added: str, key: tuple = ("symbol", "segment"), block: int = 4096) -> DataFrame:
    """bars with the columns `added` that slide(frame, windows) computes; windows holds for each of `columns` an array
    (rows, horizon + 1) of its values from this row on, NaN past the segment's end.

    Rows are dealt in blocks of `block` bars of a segment, each with the horizon that follows as a halo, so a symbol
    of any length is spread over tasks, and a task holds one block."""
    by = W.partitionBy(*key).orderBy("open_us")
    d = bars.withColumn("_k", F.row_number().over(by) - 1).withColumn("_b", F.expr(f"_k div {block}"))
    last = F.expr(f"greatest(0, (_k - {horizon}) div {block})")
    d = d.withColumn("_home", F.explode(F.sequence(last.cast("long"), F.col("_b").cast("long"))))
    schema = T.StructType([*bars.schema.fields, *T._parse_datatype_string(added).fields])
    names = schema.names

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_k", ignore_index=True)
        own = group["_b"] == group["_home"]
        n = int(own.sum())
        windows = {}
        for c in columns:
            values = np.concatenate([group[c].to_numpy(float), np.full(horizon, np.nan)])
            windows[c] = np.lib.stride_tricks.sliding_window_view(values, horizon + 1)[:n]
        return slide(group[:n].copy(), windows)[names]

    return d.groupBy(*key, "_home").applyInPandas(run, schema)


def future_path(bars: DataFrame, horizon: int, key: tuple = ("symbol", "segment")) -> DataFrame:
    """Adds `path`: closes of this bar and the next `horizon`; null where the segment ends before."""
    if horizon > SHORT:
        def slide(frame: pd.DataFrame, windows: dict) -> pd.DataFrame:
            whole = ~np.isnan(windows["close"][:, -1])
            frame["path"] = [list(w) if ok else None for w, ok in zip(windows["close"], whole)]
            return frame

        return ahead_of(bars, horizon, ["close"], slide, "path array<double>", key)
    f = Frame(*key)
    steps = [F.col("close"), *[f.lead("close", k) for k in range(1, horizon + 1)]]
    return bars.withColumn("path", F.when(f.lead("close", horizon).isNotNull(), F.array(*steps)))


def path_targets(rows: DataFrame, horizon: int, amplitude: float) -> DataFrame:
    """Up, down, terminal, retention, efficiency, fractions, drawdown, first extremes and threshold hits of `path`."""
    first = F.element_at("path", 1)
    r = F.transform("path", lambda c: F.try_divide(c, first) - 1)
    d = rows.withColumn("_r", r)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    moves = F.zip_with(F.slice("_r", 2, horizon), F.slice("_r", 1, horizon), lambda a, b: F.abs(a - b))
    later = F.slice("_r", 2, horizon)
    share = lambda test: total(F.transform(later, lambda v: test(v).cast("double"))) / horizon
    fall = F.aggregate(
        "path",
        F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("worst")),
        lambda s, c: F.struct(F.greatest(s["top"], c).alias("top"), F.greatest(s["worst"], 1 - F.try_divide(c, F.greatest(s["top"], c))).alias("worst")),
        lambda s: s["worst"],
    )
    d = d.withColumns({"up": F.array_max("_r"), "down": -F.array_min("_r"), "terminal": F.element_at("_r", -1), "_travel": total(moves), "drawdown": fall, "above_fraction": share(lambda v: v > 0), "below_fraction": share(lambda v: v < 0)})
    x = F.col
    hit = lambda sign: F.when(x("_r").isNotNull(), F.array_position(F.transform("_r", lambda v: sign * v >= amplitude), True).cast("int"))
    d = d.withColumns({
        "retention_up": F.when(x("up") > 0, F.greatest(x("terminal"), F.lit(0.0)) / x("up")),
        "retention_down": F.when(x("down") > 0, F.greatest(-x("terminal"), F.lit(0.0)) / x("down")),
        "efficiency": F.when(x("_travel") > 0, x("terminal") / x("_travel")).when(x("_travel").isNotNull(), 0.0),
        "peak_step": (F.array_position("_r", x("up")) - 1).cast("int"),
        "trough_step": (F.array_position("_r", -x("down")) - 1).cast("int"),
        "_u": hit(1), "_d": hit(-1),
    })
    for side, at, sign in (("up", "_u", -1), ("down", "_d", 1)):
        before = F.slice("_r", F.lit(1), F.greatest(F.col(at), F.lit(1)))
        worst = F.greatest(sign * (F.array_min(before) if sign < 0 else F.array_max(before)), F.lit(0.0))
        d = d.withColumns({f"{side}_hit": (F.col(at) > 0).cast("int"), f"{side}_first": F.when(F.col(at) > 0, F.col(at) - 1), f"{side}_adverse": F.when(F.col(at) > 0, worst)})
    return d.drop("_r", "_travel", "_u", "_d", "path")


def first_hit_steps(bars: DataFrame, horizon: int, high: str, low: str, key: tuple = ("symbol", "segment")) -> DataFrame:
    """First of the next `horizon` bars whose high reaches column `high`, or low reaches `low`; null if none does.

    Short horizons are arrays of leads of one sorted window; long ones slide over blocks of rows with a halo."""
    if horizon > SHORT:
        def slide(frame: pd.DataFrame, windows: dict) -> pd.DataFrame:
            for out, values, line, side in (("up_step", windows["high"], frame[high], 1), ("low_step", windows["low"], frame[low], -1)):
                hit = side * values[:, 1:] >= side * line.to_numpy(float)[:, None]
                frame[out] = pd.array(np.where(hit.any(1), hit.argmax(1) + 1, 0), "Int32")
                frame.loc[~hit.any(1), out] = pd.NA
            return frame

        return ahead_of(bars, horizon, ["high", "low"], slide, "up_step int, low_step int", key)
    f = Frame(*key)
    highs = F.array(*[f.lead("high", k) for k in range(1, horizon + 1)])
    lows = F.array(*[f.lead("low", k) for k in range(1, horizon + 1)])
    d = bars.withColumns({"_h": highs, "_l": lows})
    first = lambda a, test: F.nullif(F.array_position(F.transform(a, lambda v: F.coalesce(test(v), F.lit(False))), True).cast("int"), F.lit(0))
    return d.withColumns({"up_step": first("_h", lambda v: v >= F.col(high)), "low_step": first("_l", lambda v: v <= F.col(low))}).drop("_h", "_l")


def causal_sigma(bars: DataFrame, window: int, minimum: int, key: tuple = ("symbol", "segment")) -> DataFrame:
    """Root mean square of the last returns; null under `minimum` of them."""
    f = Frame(*key)
    d = bars.withColumn("ret", F.try_divide(F.col("close"), f.lag("close", 1)) - 1)
    w = f.by.rowsBetween(-(window - 1), 0)
    return d.withColumn("sigma", F.when(F.count("ret").over(w) >= minimum, F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(w))))


def triple_barrier(rows: DataFrame, horizon: int, upper: float, lower: float, cost_bps: float = 0.0, key: tuple = ("symbol", "segment")) -> DataFrame:
    """Exit, outcome, exit step and net return of a long entry at the next open. Lower is tested before upper.

    rows need sigma and eligible (null: no evidence). Unknown is not negative: a missing future is unavailable."""
    f = Frame(*key)
    d = rows.withColumns({"entry": f.lead("open", 1), "_last": f.lead("close", horizon)})
    d = d.withColumns({"_top": F.col("entry") * (1 + upper * F.col("sigma")), "_floor": F.col("entry") * (1 - lower * F.col("sigma"))})
    d = first_hit_steps(d, horizon, "_top", "_floor", key)
    x = F.col
    d = d.withColumn("exit", F.when(x("eligible").isNull(), "missing_eligibility").when(~x("eligible"), "ineligible").when(x("sigma").isNull(), "no_volatility").when(x("sigma") == 0, "zero_volatility").when(x("_last").isNull(), "incomplete_horizon").when(x("low_step") <= F.coalesce(x("up_step"), F.lit(horizon + 1)), "lower_barrier").when(x("up_step").isNotNull(), "upper_barrier").otherwise("expiry"))
    known = x("exit").isin("lower_barrier", "upper_barrier", "expiry")
    step = F.when(x("exit") == "lower_barrier", x("low_step")).when(x("exit") == "upper_barrier", x("up_step")).when(x("exit") == "expiry", F.lit(horizon))
    price = F.when(x("exit") == "lower_barrier", x("_floor")).when(x("exit") == "upper_barrier", x("_top")).when(x("exit") == "expiry", x("_last"))
    cost = cost_bps / 10000
    d = d.withColumns({"exit_step": step, "net_return": price * (1 - cost) / (x("entry") * (1 + cost)) - 1})
    outcome = F.when(~known, "unavailable").when((x("exit") == "upper_barrier") & (x("net_return") > 0), "positive").otherwise("negative")
    return d.withColumn("outcome", outcome).drop("_top", "_floor", "_last", "up_step", "low_step")


def prevalence(labels: DataFrame, *by: str) -> DataFrame:
    known = F.col("outcome") != "unavailable"
    return labels.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(known).alias("available"), F.count_if(F.col("outcome") == "positive").alias("positive"), F.count_if(F.col("outcome") == "negative").alias("negative"), F.try_divide(F.count_if(F.col("outcome") == "positive"), F.count_if(known)).alias("positive_rate")
    )


class Barrier:
    """Upper and lower distance in sigmas, and a horizon in bars."""

    def __init__(self, name: str, horizon: int, upper: float, lower: float):
        self.name, self.horizon, self.upper, self.lower = name, horizon, upper, lower


#: Fixed values of the default benchmark: three horizons, two pairs of distances.
DEFAULT_BARRIERS = [Barrier(f"h{h}_u{u}_l{l}", h, u, l) for h in (30, 120, 360) for u, l in ((2, 1), (3, 2))]


def barrier_table(rows: DataFrame, barriers: list[Barrier] = DEFAULT_BARRIERS, cost_bps: float = 15.0, key: tuple = ("symbol", "segment")) -> DataFrame:
    """Labels of every barrier, in long form with barrier (name) and barrier_index. One pass slides the longest horizon."""
    told = [triple_barrier(rows, b.horizon, b.upper, b.lower, cost_bps, key).withColumns({"barrier": F.lit(b.name), "barrier_index": F.lit(i)}) for i, b in enumerate(barriers)]
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return out


def ambiguity_band(value: str | Column, ulps: int = 16) -> Column:
    """Width of `ulps` units in the last place above positive values, 0 elsewhere: by the exponent, which for a positive
    binary64 number fixes the unit as 2^(floor(log2 v) - 52). Within a power of two the units are equal, so the band is
    exact; where it crosses the next power, the part beyond counts double."""
    v = F.col(value) if isinstance(value, str) else value
    # floor(log2 v) by the number's own hexadecimal form would need a cast that SQL lacks: correct log2 by comparison
    e = F.floor(F.log2(v))
    e = F.when(F.pow(F.lit(2.0), e) > v, e - 1).when(F.pow(F.lit(2.0), e + 1) <= v, e + 1).otherwise(e)
    unit = F.pow(F.lit(2.0), F.greatest(e, F.lit(-1022)) - 52)
    top = F.pow(F.lit(2.0), e + 1)
    left = (top - v) / unit  # units until the next power of two
    band = F.when(left >= ulps, unit * ulps).otherwise(unit * left + 2 * unit * (F.lit(float(ulps)) - left))
    return F.when(v > 0, band).when(v.isNotNull(), F.lit(0.0))


def decimal_admission(bars: DataFrame, prices: list[str], close: str, key: str = "symbol", order: str = "open_us") -> DataFrame:
    """One row a key for the float64 policy: prices that are not positive and finite as doubles, and neighbours whose
    decimal closes differ but collapse to one double; `admitted` if there are none of either."""
    bad = F.lit(False)
    for c in prices:
        d = F.col(c).cast("double")
        bad = bad | d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")) | (d <= 0)
    by = W.partitionBy(key).orderBy(order)
    before = F.lag(close).over(by)
    same = (F.col(close) != before) & (F.col(close).cast("double") == before.cast("double"))
    told = bars.withColumn("_bad", bad).withColumn("_same", F.coalesce(same, F.lit(False)))
    return told.groupBy(key).agg(F.count_if("_bad").alias("bad_prices"), F.count_if("_same").alias("collapsed"), (F.count_if(F.col("_bad") | F.col("_same")) == 0).alias("admitted"))


def alert_stages(bars: DataFrame, window: int, ema: int, key: tuple = ("symbol", "segment"), history: int = 0) -> DataFrame:
    """Turnover against the mean and deviation of the `window` bars before, premium over an exponential mean of the
    last closes (seeded at the oldest), stage 0/1/2 and whether it rose. A rise counts only from the bar that has
    `history` bars up to it in its segment (two more than the window where alerts need a judged bar before)."""
    f = Frame(*key)
    past = f.by.rowsBetween(-window, -1)
    full = F.count("turnover").over(past) == window
    d = bars.withColumns({"mean": F.when(full, F.avg("turnover").over(past)), "deviation": F.when(full, F.stddev_pop("turnover").over(past))})
    closes = F.array(*[f.lag("close", k) if k else F.col("close") for k in range(ema - 1, -1, -1)])
    alpha = 2.0 / (ema + 1)
    smooth = F.aggregate(F.slice(closes, 2, ema - 1), F.element_at(closes, 1), lambda a, v: a + alpha * (v - a))
    d = d.withColumn("average", F.when(f.lag("close", ema - 1).isNotNull(), smooth))
    x = F.col
    d = d.withColumns({"ratio": x("turnover") / F.when(x("mean") > 0, x("mean")), "z": F.when(x("deviation") > 0, (x("turnover") - x("mean")) / x("deviation")), "premium": F.try_divide(x("close"), x("average")) - 1, "net_taker": 2 * x("taker") - x("turnover")})
    d = d.withColumn("stage", F.when((x("ratio") >= 2.0) & (x("z") >= 2) & (x("net_taker") > 0), 2).when((x("ratio") >= 1.5) & (x("z") >= 1), 1).otherwise(0))
    risen = x("stage") > F.coalesce(F.lag("stage").over(f.by), F.lit(0))
    return d.withColumn("upgraded", risen & (F.row_number().over(f.by) >= history) if history else risen)
