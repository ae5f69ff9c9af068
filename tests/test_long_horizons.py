"""Real horizons, the ambiguity band, bootstrap, isotonic fits, replay under faults: against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E, labels as L, replay as R


def path(spark, n=900, seed=3):
    draw, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        price *= math.exp(draw.gauss(0, 0.01))
        rows.append(("A", 1, i, price, price * (1 + draw.random() * 0.01), price * (1 - draw.random() * 0.01), price))
    return rows, spark.createDataFrame(rows, "symbol string, segment int, open_us long, open double, high double, low double, close double")


def test_first_hits_at_360(spark):
    rows, df = path(spark)
    got = {x["open_us"]: (x["up_step"], x["low_step"]) for x in L.first_hit_steps(df.withColumns({"t": F.col("close") * 1.05, "f": F.col("close") * 0.95}), 360, "t", "f").collect()}
    for i, r in enumerate(rows):
        ahead = rows[i + 1 : i + 361]
        up = next((k + 1 for k, x in enumerate(ahead) if x[4] >= r[6] * 1.05), None)
        low = next((k + 1 for k, x in enumerate(ahead) if x[5] <= r[6] * 0.95), None)
        assert got[i] == (up, low)


def test_blocks_equal_leads(spark):
    rows, df = path(spark, 100)
    d = df.withColumns({"t": F.col("close") * 1.01, "f": F.col("close") * 0.99})
    slid = L.ahead_of(d, 8, ["close"], lambda frame, w: frame.assign(path=list(w["close"])), "path array<double>", block=16)
    short = {x["open_us"]: x["path"] for x in L.future_path(d, 8).collect()}
    for x in slid.collect():
        whole = [v for v in x["path"] if v is not None and v == v]
        assert short[x["open_us"]] is None or whole == short[x["open_us"]]
    assert slid.count() == 100


def test_path_targets_at_360(spark):
    rows, df = path(spark, 500)
    got = L.path_targets(L.future_path(df, 360).where("path is not null"), 360, 0.1).collect()
    assert len(got) == 140
    for x in got:
        r = np.array([rows[x["open_us"] + k][6] for k in range(361)]) / x["close"] - 1
        assert np.isclose(x["up"], r.max()) and np.isclose(x["terminal"], r[-1]) and x["peak_step"] == r.argmax()


def test_band_is_16_units_in_the_last_place(spark):
    draw = random.Random(1)
    values = [draw.random() * 10 ** draw.randint(-12, 12) for _ in range(200)] + [1.0, 2.0, 0.5, 1 - 2**-53, 2 - 2**-50, 0.0, -3.0, None]
    for x in spark.createDataFrame([(v,) for v in values], "v double").withColumn("band", L.ambiguity_band("v")).collect():
        v = x["v"]
        if v is None:
            assert x["band"] is None
        elif v <= 0:
            assert x["band"] == 0
        else:
            up = v
            for _ in range(16):
                up = math.nextafter(up, math.inf)
            assert x["band"] == up - v


def test_collapsed_decimals_are_refused(spark):
    rows = [("A", 1, "1.000000000000000001"), ("A", 2, "1.000000000000000002"), ("B", 1, "1.0"), ("B", 2, "1.1"), ("C", 1, "0")]
    df = spark.createDataFrame(rows, "symbol string, open_us long, c string").withColumn("close", F.col("c").cast("decimal(38,18)"))
    got = {x["symbol"]: (x["bad_prices"], x["collapsed"], x["admitted"]) for x in L.decimal_admission(df, ["close"], "close").collect()}
    assert got == {"A": (0, 1, False), "B": (0, 0, True), "C": (1, 0, False)}


def test_bootstrap():
    draw = np.random.default_rng(4)
    days, loss, base = np.arange(10, 70), draw.random(60), draw.random(60) + 0.5
    got = E.block_bootstrap(days, loss, base)
    begins = np.random.default_rng(0).integers(0, 54, (400, 9))
    gains = []
    for b in begins:
        at = [(s + k) % 60 for s in b for k in range(7)][:60]
        gains.append(1 - loss[at].sum() / base[at].sum())
    assert np.isclose(got["low"], np.quantile(gains, 0.025)) and np.isclose(got["high"], np.quantile(gains, 0.975))
    assert E.block_bootstrap(days[:20], loss[:20], base[:20])["status"] == "insufficient_days"
    rare = np.where(np.arange(60) == 5, 1.0, 0.0)
    assert E.block_bootstrap(days, loss, rare)["status"] == "zero_baseline_loss"  # some draw misses the one day


def test_isotonic(spark):
    points = [(0, 0.2, 1), (1, 0.1, 1), (2, 0.5, 2), (3, 0.4, 1), (4, 0.9, 1)]
    got = dict(E.isotonic(points))
    assert np.allclose([got[i] for i in range(5)], [0.15, 0.15, 1.4 / 3, 1.4 / 3, 0.9])
    rows = spark.createDataFrame([(i / 200, int((i * 7919) % 200 < i)) for i in range(200)], "s double, y int")
    told = E.calibrated(rows, "s", "y", 20).toPandas()
    assert told["calibrated"].is_monotonic_increasing and told["n"].sum() == 200


def test_quantiles_by_counts(spark):
    draw = random.Random(2)
    rows = [(g, draw.choice([1.0, 2.0, 3.5, draw.gauss(0, 10)])) for g in "ab" for _ in range(301)] + [("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for x in E.exact_quantiles(df, "v", [0.1, 0.5, 0.99], "g").collect():
        own = [v for g, v in rows if g == x["g"]]
        assert np.allclose([x["q10"], x["q50"], x["q99"]], np.quantile(own, [0.1, 0.5, 0.99]))


def test_replay_under_faults(spark):
    rows = [("s", i, f"e{i}", i, i, "d") for i in range(8)]
    df = spark.createDataFrame(rows, "stream string, row long, identity string, event long, arrival long, digest string")
    plan = spark.createDataFrame([("GAP", 1, 1), ("DISCONNECT", 3, 2), ("DUPLICATE", 6, 1)], "kind string, first_index int, n int")
    got = [(x["row"], x["state"], x["authoritative"]) for x in R.replay_with_faults(df, plan, "stream", "identity", "event", "arrival", "digest", "row", 2).orderBy("row", "copy").collect()]
    assert got == [(0, "VALID", True), (1, "GAP", False), (2, "VALID", True), (3, "DISCONNECT", False), (4, "DISCONNECT", False), (5, "VALID", True), (6, "VALID", True), (6, "DUPLICATE", False), (7, "VALID", True)]
