"""Scores, distribution distances, histograms, quality gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def pinball(y: Column, p: Column, q: float) -> Column:
    e = y - p
    return F.greatest(q * e, (q - 1) * e)


def scores(rows: DataFrame, y: str, p: str, q: float, *by: str) -> DataFrame:
    """Loss and coverage overall and by each of the slices: one pass with grouping sets."""
    sets = [[], *[[c] for c in by]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *by)
    return grouped.agg(F.count("*").alias("n_rows"), F.avg(pinball(F.col(y), F.col(p), q)).alias("loss"), F.avg((F.col(y) <= F.col(p)).cast("double")).alias("coverage"))


def running_counts(counts: DataFrame, by: list[str], value: str, sums: dict[str, str], buckets: int = 4096) -> DataFrame:
    """Running sums over the values of each group, in order, without one task for a group: values are dealt to `buckets`
    equal ranges between the group's extremes, sums by range give each range its start. sums: column -> name."""
    ends = counts.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    d = counts.join(ends, by) if by else counts.crossJoin(F.broadcast(ends))  # one row
    d = d.withColumn("_range", F.when(wide > 0, F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("_lo")) / wide * buckets))).otherwise(0).cast("long"))
    of_range = d.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    w = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = of_range.select(*by, "_range", *[F.coalesce(F.sum(f"_s_{c}").over(w), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = W.partitionBy(*by, "_range").orderBy(value)
    d = d.withColumns({n: F.sum(c).over(inside) for c, n in sums.items()}).join(starts, [*by, "_range"])
    return d.withColumns({n: F.col(n) + F.col(f"_b_{c}") for c, n in sums.items()}).drop("_range", "_lo", "_hi", *[f"_b_{c}" for c in sums])


def exact_quantiles(rows: DataFrame, value: str, qs: list[float], *by: str) -> DataFrame:
    """Linearly interpolated quantiles of each group, one column a quantile (q10, q50...): values are counted, their
    running counts say which two order statistics a quantile lies between; no task holds a group."""
    known = rows.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count("*").alias("_c"))
    run = running_counts(counts, list(by), value, {"_c": "_run"})
    total = known.groupBy(*by).agg(F.count("*").alias("_n"))
    d = run.join(total, list(by)) if by else run.crossJoin(F.broadcast(total))  # one row
    before = F.col("_run") - F.col("_c")
    picks = []
    for i, q in enumerate(qs):
        at = (F.col("_n") - 1) * F.lit(float(q))
        for j, side in enumerate((F.floor(at), F.ceil(at))):
            picks.append(F.max(F.when((before <= side) & (side < F.col("_run")), F.col(value))).alias(f"_{j}_{i}"))
    found = d.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    told = [(F.col(f"_0_{i}") + (F.col(f"_1_{i}") - F.col(f"_0_{i}")) * ((F.col("_n") - 1) * F.lit(float(q)) - F.floor((F.col("_n") - 1) * F.lit(float(q))))).alias(f"q{round(q * 100)}") for i, q in enumerate(qs)]
    return found.select(*by, *told)


def distribution_shift(rows: DataFrame, feature: str, value: str, is_reference: str) -> DataFrame:
    """Per feature: means, medians, standardised change (null if the reference is constant), largest distance of the two
    distribution functions, share outside the reference's range.

    Values are first counted by (feature, value) on both sides, so ties are one row; the functions are
    right-continuous, and their running counts come from ranges of values, so no task sorts a feature."""
    ref = F.col(is_reference)
    x = F.col(value)
    stats = rows.groupBy(feature).agg(
        F.avg(F.when(ref, x)).alias("ref_mean"), F.avg(F.when(~ref, x)).alias("cur_mean"), F.stddev_pop(F.when(ref, x)).alias("_sd"),
        F.count_if(ref).alias("_nr"), F.count_if(~ref).alias("_nc"), F.min(F.when(ref, x)).alias("_lo"), F.max(F.when(ref, x)).alias("_hi"),
    )
    counts = rows.groupBy(feature, value).agg(F.count_if(ref).alias("_r"), F.count_if(~ref).alias("_c"))
    d = running_counts(counts, [feature], value, {"_r": "_run_r", "_c": "_run_c"}).join(F.broadcast(stats), feature)  # one row a feature
    out = (x < F.col("_lo")) | (x > F.col("_hi"))
    middle = lambda run, n, c: F.max(F.when((F.col(run) - F.col(c) <= F.floor((F.col(n) - 1) / 2)) & (F.floor((F.col(n) - 1) / 2) < F.col(run)), x)) + F.max(F.when((F.col(run) - F.col(c) <= F.ceil((F.col(n) - 1) / 2)) & (F.ceil((F.col(n) - 1) / 2) < F.col(run)), x))
    return d.groupBy(feature).agg(
        F.first("ref_mean").alias("ref_mean"), F.first("cur_mean").alias("cur_mean"),
        (middle("_run_r", "_nr", "_r") / 2).alias("ref_median"), (middle("_run_c", "_nc", "_c") / 2).alias("cur_median"),
        F.first(F.when(F.col("_sd") > 0, (F.col("cur_mean") - F.col("ref_mean")) / F.col("_sd"))).alias("standardised"),
        F.max(F.abs(F.try_divide(F.col("_run_r"), F.col("_nr")) - F.try_divide(F.col("_run_c"), F.col("_nc")))).alias("cdf_distance"),
        F.try_divide(F.sum(F.when(out, F.col("_c")).otherwise(0)), F.first("_nc")).alias("outside"),
    )


def top_shifts(shift: DataFrame, feature: str, n: int = 10) -> DataFrame:
    """The features whose distributions lie farthest apart, ties by feature."""
    return shift.orderBy(F.desc("cdf_distance"), feature).limit(n)


def latency_bucket(v: Column) -> Column:
    """Bit length: 0 for 0, k for [2^(k-1), 2^k); at most 64. Null for negatives."""
    v = v.cast("long")
    return F.when(v == 0, 0).when(v > 0, F.length(F.bin(v))).cast("int")


def histogram(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.withColumn("bucket", latency_bucket(F.col(value))).where("bucket is not null").groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, numerator: int, denominator: int, *by: str) -> DataFrame:
    """Upper bound of the first bucket whose running count reaches ceil(total*n/d). Histograms merge by sums first."""
    merged = hist.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by)
    d = merged.withColumn("_c", F.sum("n").over(w.orderBy("bucket"))).withColumn("_t", F.sum("n").over(w))
    d = d.where(F.col("_c") >= F.expr(f"(_t * {numerator} + {denominator - 1}) div {denominator}"))
    bound = F.min("bucket")
    return d.groupBy(*by).agg(F.when(bound == 0, 0).otherwise(F.expr("shiftleft(1L, min(bucket))")).cast("long").alias("percentile"))


def block_bootstrap(days: np.ndarray, loss: np.ndarray, base: np.ndarray, draws: int = 400, block: int = 7, seed: int = 0) -> dict:
    """Interval of 1 - loss/base over resampled spans of moving blocks of days; a day without rows counts as zero. The
    arrays hold a row a day. A draw is how often it covers each day, so its sums are one product with the daily sums.
    A draw without any baseline loss makes the status zero_baseline_loss."""
    if len(days) < 28:
        return {"status": "insufficient_days"}
    place = days - days.min()
    span = int(place.max()) + 1
    daily = np.stack([np.bincount(place, loss, span), np.bincount(place, base, span)], 1)
    if daily[:, 1].sum() <= 0:
        return {"status": "zero_baseline_loss"}
    per_draw = -(-span // block)
    begins = np.random.default_rng(seed).integers(0, max(1, span - block + 1), (draws, per_draw))  # fixed: generator and its call
    covers = np.zeros((draws, span))
    for k in range(per_draw):
        for step in range(min(block, span - k * block)):
            np.add.at(covers, (np.arange(draws), (begins[:, k] + step) % span), 1)
    sums = covers @ daily
    if (sums[:, 1] <= 0).any():
        return {"status": "zero_baseline_loss"}
    low, high = np.quantile(1 - sums[:, 0] / sums[:, 1], [0.025, 0.975])
    whole = daily.sum(0)
    return {"status": "ok", "gain": float(1 - whole[0] / whole[1]), "low": float(low), "high": float(high)}


#: The gates of a day's capture report, in the order of their codes; columns are the report's facts.
CAPTURE_GATES = {
    "NO_CAPTURED_MESSAGES": "persisted = 0",
    "CLOSED_KLINE_EXPECTATION_UNAVAILABLE": "expected is null or expected = 0",
    "CLOSED_KLINE_COVERAGE_BELOW_99_9_PERCENT": "expected > 0 and closed * 1000 < expected * 999",
    "CONFLICTING_EVIDENCE": "conflicts > 0",
    "UNRESOLVED_GAP": "gaps > 0",
    "SCHEMA_MISMATCH": "schema_mismatches > 0",
    "CAPTURE_QUEUE_OVERFLOW": "queue_overflows > 0",
    "UNRESOLVED_RECOVERY": "unresolved_recoveries > 0",
    "UNKNOWN_INSTRUMENT": "unknown_symbols > 0",
    "STALE_METADATA": "metadata_age_ns > 86400000000000",
    "CLOCK_QUALIFICATION_UNAVAILABLE": "clock_offset_ms is null",
    "CLOCK_OFFSET_EXCEEDS_100_MS": "abs(clock_offset_ms) > 100",
    "NEGATIVE_EVENT_LATENCY": "negative_latency > 0",
    "EVENT_LATENCY_P95_EXCEEDS_500_MS": "latency_p95 > 500000000",
    "EVENT_LATENCY_P99_EXCEEDS_1500_MS": "latency_p99 > 1500000000",
    "CLOSED_KLINE_LATENCY_P95_EXCEEDS_3_S": "kline_latency_p95 > 3000000000",
    "REPRESENTATIVE_WINDOW_PENDING": "not representative",
}


def gates(rules: dict[str, str]) -> Column:
    """Codes of the gates that a report fails."""
    return F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(code)) for code, rule in rules.items()]))


def irls(rows: DataFrame, features: list[str], label: str, weight: str | None = None, penalty: float = 1.0, steps: int = 8) -> np.ndarray:
    """Penalised weighted logistic regression. Each step sums the normal equations over all rows in one aggregate of
    (p+1)(p+2)/2 + p+1 numbers, and solves them on the driver; the first coefficient is the free intercept."""
    x = [F.lit(1.0), *map(F.col, features)]
    p = len(x)
    beta = np.zeros(p)
    w0 = F.col(weight) if weight else F.lit(1.0)
    for _ in range(steps):
        eta = sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        w = w0 * mu * (1 - mu)
        sums = [F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
        sums += [F.sum(w0 * (F.col(label) - mu) * x[i]).alias(f"g{i}") for i in range(p)]
        got = rows.agg(*sums).first()
        h, g = np.zeros((p, p)), np.array([got[f"g{i}"] for i in range(p)])
        for i in range(p):
            for j in range(i, p):
                h[i, j] = h[j, i] = got[f"h{i}_{j}"]
        ridge = penalty * np.diag([0.0] + [1.0] * (p - 1))
        move = np.linalg.solve(h + ridge, g - ridge @ beta)
        beta = beta + move
        if np.abs(move).max() < 1e-10:
            break
    return beta


def outcome_summary(rows: DataFrame, state: str = "state", loss: str = "loss", below: str = "below") -> DataFrame:
    """One row: members, observed ones, their mean pinball loss and the share that came out at or below its quantile."""
    seen = F.col(state) == "observed"
    return rows.agg(F.count("*").alias("members"), F.count_if(seen).alias("observed"), F.avg(F.when(seen, F.col(loss))).alias("mean_loss"), F.avg(F.when(seen, F.col(below).cast("double"))).alias("coverage"))


def state_counts(rows: DataFrame, state: str = "state") -> DataFrame:
    return rows.groupBy(state).agg(F.count("*").alias("n"))


def expected_klines(start_us: int, end_us: int, symbols: int, step: int = 60_000_000) -> int:
    """Closed bars that a window of a campaign should bring."""
    return (end_us // step - start_us // step) * symbols


def spline_basis(x: Column, knots: list[float]) -> list[Column]:
    """Natural cubic spline basis of x: x itself and one term for each inner knot (linear beyond the outer knots)."""
    last, before = knots[-1], knots[-2]
    cube = lambda k: F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), 3)
    part = lambda k: (cube(k) - cube(last)) / float(last - k)
    return [x, *[part(k) - part(before) for k in knots[:-2]]]


def harmonics(us: Column, period_us: int, n: int) -> list[Column]:
    """Sines and cosines of the first n harmonics of a time within a period."""
    at = F.pmod(us, F.lit(period_us)) / F.lit(float(period_us)) * F.lit(2 * float(np.pi))
    return [f(at * k) for k in range(1, n + 1) for f in (F.sin, F.cos)]


def isotonic(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Pool adjacent violators over (score, mean label, weight) sorted by score, one row a distinct score or bin: the
    calibrated value of each."""
    pools: list[list[float]] = []
    for x, y, w in points:
        pools.append([x, x, y * w, w])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            top = pools.pop()
            pools[-1] = [pools[-1][0], top[1], pools[-1][2] + top[2], pools[-1][3] + top[3]]
    out = []
    for lo, hi, s, w in pools:
        out += [(x, s / w) for x, _, _ in points if lo <= x <= hi]
    return out


def calibrated(rows: DataFrame, score: str, label: str, bins: int = 1000) -> DataFrame:
    """bin, n, rate and calibrated rate: scores in [0, 1] are counted by bin, which bounds what the driver pools."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    found = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate")).orderBy("bin").collect()
    told = dict(isotonic([(x["bin"], x["rate"], x["n"]) for x in found]))
    return rows.sparkSession.createDataFrame([(x["bin"], x["n"], x["rate"], float(told[x["bin"]])) for x in found], "bin int, n long, rate double, calibrated double")
