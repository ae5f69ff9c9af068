"""Hand-made inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidemark.operators import bars as B, evaluate as E, features as X, islands as I, joins as J, labels as L, replay as R

MIN = 60_000_000


def minute_bars(spark, closes, missing=(), high=None, low=None):
    rows = [("A", i * MIN, float(c), float(c + 0.1 if high is None else high[i]), float(c - 0.1 if low is None else low[i]), float(c), 100.0, 50.0, 10) for i, c in enumerate(closes) if i not in missing]
    return spark.createDataFrame(rows, "symbol string, open_us long, open double, high double, low double, close double, turnover double, taker double, trades long")


def test_rollup_refuses_incomplete_buckets(spark):
    got = {x["open_us"]: x for x in B.roll_up(minute_bars(spark, range(1, 11), missing=[7]), MIN, 5 * MIN).collect()}
    assert got[0]["complete"] and got[0]["open"] == 1 and got[0]["close"] == 5 and got[0]["turnover"] == 500
    assert not got[5 * MIN]["complete"]


def test_path_targets_of_a_known_path(spark):
    rows = L.future_path(I.segments(minute_bars(spark, [100, 110, 90, 120, 105]), MIN), 4).where("path is not null")
    x = L.path_targets(rows, 4, 0.15).first()
    assert math.isclose(x["up"], 0.2) and math.isclose(x["down"], 0.1) and math.isclose(x["terminal"], 0.05)
    assert math.isclose(x["retention_up"], 0.25) and math.isclose(x["efficiency"], 0.05 / 0.75)
    assert math.isclose(x["drawdown"], 1 - 90 / 110) and x["above_fraction"] == 0.75
    assert x["up_first"] == 3 and math.isclose(x["up_adverse"], 0.1) and x["down_hit"] == 0 and x["down_first"] is None


def test_flat_path(spark):
    x = L.path_targets(L.future_path(I.segments(minute_bars(spark, [10] * 5), MIN), 4).where("path is not null"), 4, 0.1).first()
    assert x["retention_up"] is None and x["efficiency"] == 0


def test_features_see_the_past_only(spark):
    closes = [10 + math.sin(i / 3) for i in range(40)]
    spec = X.FeatureSpec(2, 3, 4, 5, 6, 4)
    whole = X.enrich(I.segments(minute_bars(spark, closes), MIN), spec).select("open_us", *X.PRICE, *X.FLOW).orderBy("open_us").collect()
    part = X.enrich(I.segments(minute_bars(spark, closes[:25]), MIN), spec).select("open_us", *X.PRICE, *X.FLOW).orderBy("open_us").collect()
    assert whole[:25] == part


def test_peers_leave_themselves_out(spark):
    rows = spark.createDataFrame([("A", 0, 0.1, 0.1, 0.3), ("B", 0, 0.2, 0.2, 0.4), ("C", 0, -0.1, -0.1, 0.2)], "symbol string, at long, s double, m double, l double")
    a = X.peers(rows, "at", "s", "m", "l", 2).where("symbol = 'A'").first()
    assert math.isclose(a["peer_return"], 0.05) and math.isclose(a["peer_dispersion"], 0.15) and a["peer_positive"] == 0.5
    assert X.peers(rows, "at", "s", "m", "l", 20).first()["peer_return"] is None


def test_lower_barrier_wins_a_tie(spark):
    bars = minute_bars(spark, [100, 101, 102.01, 100, 100], high=[100.1, 101.1, 102.1, 120, 100], low=[99, 100, 102, 80, 100])
    labels = L.triple_barrier(L.causal_sigma(I.segments(bars, MIN), 3, 2).selectExpr("*", "true as eligible"), 1, 2, 2)
    assert labels.where(f"open_us = {2 * MIN}").first()["exit"] == "lower_barrier"
    assert labels.where(f"open_us = {4 * MIN}").first()["outcome"] == "unavailable"


def test_asof_is_inclusive(spark):
    left = spark.createDataFrame([("k", 5), ("k", 4), ("k", 1), ("x", 9)], "key string, t long")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b")], "key string, r long, v string")
    got = {(x["key"], x["t"]): x["v"] for x in J.asof(left, right, ["key"], "t", "r", ["v"]).collect()}
    assert got == {("k", 5): "b", ("k", 4): "a", ("k", 1): None, ("x", 9): None}


def test_one_to_one_refuses_a_repeated_key(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, a int")
    with pytest.raises(PySparkException):
        J.one_to_one(a, spark.createDataFrame([(1, 5)], "k int, b int"), ["k"]).collect()


def test_day_intervals(spark):
    days = spark.createDataFrame([("a", d) for d in (2, 3, 5, 5)], "k string, d long")
    assert sorted(tuple(x) for x in I.day_intervals(days, "k", "d").select("first_day", "last_day").collect()) == [(2, 3), (5, 5)]


def test_histograms_merge_before_percentiles(spark):
    h = E.histogram(spark.createDataFrame([(1, 1), (2, 600)], "day int, v long"), "v", "day")
    assert E.histogram_percentile(h, 95, 100).first()["percentile"] == 1024


def test_bootstrap():
    days = np.arange(30)
    assert E.block_bootstrap(days, np.full(30, 0.5), np.ones(30))["low"] == 0.5
    assert E.block_bootstrap(days[:20], np.ones(20), np.ones(20))["status"] == "insufficient_days"
    assert E.block_bootstrap(days, np.zeros(30), np.zeros(30))["status"] == "zero_baseline_loss"


def sequential_replay(rows, lateness):
    """One row at a time: pending rows leave when the watermark reaches them."""
    seen, pending, state, mark = {}, {}, {}, -1
    for i, (identity, event, arrival, digest) in enumerate(rows):
        if identity in seen:
            if digest == seen[identity][0] and not seen[identity][1]:
                state[i] = "DUPLICATE"
            else:
                state[i] = "CONFLICT"
                seen[identity] = (seen[identity][0], True)
                if identity in pending:
                    state[pending.pop(identity)[1]] = "CONFLICT"
        else:
            seen[identity] = (digest, False)
            if event <= mark:
                state[i] = "LATE"
            else:
                pending[identity] = (event, i)
        mark = max(mark, arrival - lateness)
        for k in [k for k, (e, _) in pending.items() if e <= mark]:
            state[pending.pop(k)[1]] = "VALID"
    return state | {i: "VALID" for _, i in pending.values()}


def test_replay_equals_a_sequential_run(spark):
    draw = np.random.default_rng(0)
    streams = []
    for s in range(12):
        arrivals = np.sort(draw.integers(0, 60, 25))
        streams += [(s, i, int(draw.integers(0, 9)), int(a - draw.integers(-5, 20)), int(a), int(draw.integers(0, 2))) for i, a in enumerate(arrivals)]
    df = spark.createDataFrame(streams, "s int, i int, identity int, event long, arrival long, digest int")
    got = {(x["s"], x["i"]): x["state"] for x in R.replay(df, "s", "identity", "event", "arrival", "digest", "i", 8).collect()}
    for s in range(12):
        own = [(k, e, a, g) for z, _, k, e, a, g in streams if z == s]
        assert {i: got[s, i] for i in range(25)} == sequential_replay(own, 8)
