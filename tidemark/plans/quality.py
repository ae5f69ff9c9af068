"""Queries over scores, drift, histograms, gates, replay and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W, functions as F

from tidemark.operators import evaluate as E, replay as R
from tidemark.plans.base import DAY, TICKS, query, read, ticks


@query("a12_exact_quantiles", "select event_type, round(quantile_cont(value, 0.1), 5) as q10, round(quantile_cont(value, 0.5), 5) as q50, round(quantile_cont(value, 0.9), 5) as q90 from events group by 1")
def exact_quantiles(spark, d):
    out = E.exact_quantiles(read(spark, d, "events"), "value", [0.1, 0.5, 0.9], "event_type")
    return out.select("event_type", *[F.round(c, 5).alias(c) for c in ("q10", "q50", "q90")])


@query("a13_pinball", """with p as (select l_returnflag, l_linestatus, l_extendedprice as y, l_quantity * 1400 as p from lineitem)
select l_returnflag, l_linestatus, count(*) as n_rows, round(avg(greatest(0.9 * (y - p), -0.1 * (y - p))), 4) as loss, round(avg((y <= p)::int), 6) as coverage from p group by grouping sets ((), (l_returnflag), (l_linestatus))""")
def pinball(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1400).alias("p"))
    out = E.scores(rows, "y", "p", 0.9, "l_returnflag", "l_linestatus")
    return out.withColumns({"loss": F.round("loss", 4), "coverage": F.round("coverage", 6)})


@query("a14_tail_support", f"with {TICKS} select count(*) filter (where value > 20) as n_rows, count(distinct (symbol, us // {DAY})) filter (where value > 20) as symbol_days from ticks")
def tail_support(spark, d):
    t = ticks(spark, d).where("value > 20")
    return t.groupBy("symbol", F.expr(f"us div {DAY}").alias("day")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("symbol_days"))


@query("a15_drift", """with x as (select label < 5 as ref, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as f from embeddings), s as (select f, avg(v) filter (where ref) as ref_mean, avg(v) filter (where not ref) as cur_mean, stddev_pop(v) filter (where ref) as sd, quantile_cont(v, 0.5) filter (where ref) as ref_median, quantile_cont(v, 0.5) filter (where not ref) as cur_median,
  count(*) filter (where ref) as nr, count(*) filter (where not ref) as nc, min(v) filter (where ref) as lo, max(v) filter (where ref) as hi from x group by f),
c as (select f, v, sum(ref::int) over (partition by f order by v range between unbounded preceding and current row) as r, sum((not ref)::int) over (partition by f order by v range between unbounded preceding and current row) as c from x),
k as (select f, max(abs(r / nr - c / nc)) as cdf_distance from c join s using (f) group by f), o as (select f, count(*) filter (where not ref and (v < lo or v > hi)) / max(nc) as outside from x join s using (f) group by f)
select f::bigint as feature, round(ref_mean, 6) as ref_mean, round(cur_mean, 6) as cur_mean, round(ref_median, 6) as ref_median, round(cur_median, 6) as cur_median, round((cur_mean - ref_mean) / sd, 5) as standardised, round(cdf_distance, 6) as cdf_distance, round(outside, 6) as outside from s join k using (f) join o using (f)""")
def drift(spark, d):
    rows = read(spark, d, "embeddings").select((F.col("label") < 5).alias("ref"), F.posexplode("embedding").alias("pos", "v")).select("ref", (F.col("pos") + 1).cast("long").alias("feature"), F.col("v").cast("double").alias("v"))
    out = E.distribution_shift(rows, "feature", "v", "ref")
    return out.select("feature", F.round("ref_mean", 6).alias("ref_mean"), F.round("cur_mean", 6).alias("cur_mean"), F.round("ref_median", 6).alias("ref_median"), F.round("cur_median", 6).alias("cur_median"), F.round("standardised", 5).alias("standardised"), F.round("cdf_distance", 6).alias("cdf_distance"), F.round("outside", 6).alias("outside"))


@query("a16_equal_origin", f"with {TICKS} select symbol, round(avg(m), 6) as mean_of_days from (select symbol, us // {DAY} as day, avg(value) as m from ticks group by 1, 2) group by 1")
def equal_origin(spark, d):
    days = ticks(spark, d).groupBy("symbol", F.expr(f"us div {DAY}").alias("day")).agg(F.avg("value").alias("m"))
    return days.groupBy("symbol").agg(F.round(F.avg("m"), 6).alias("mean_of_days"))


@query("a18_histogram", f"with {TICKS}, w as (select symbol, (us - lag(us) over (partition by symbol order by us)) // 1000 as v from ticks) select symbol, case when v = 0 then 0 else floor(log2(v))::int + 1 end as bucket, count(*) as n from w where v >= 0 group by all")
def histogram(spark, d):
    return E.histogram(waits(spark, d), "v", "symbol")


def waits(spark, d):
    w = W.partitionBy("symbol").orderBy("us")
    return ticks(spark, d).withColumn("v", F.expr("(us - lag(us) over (partition by symbol order by us)) div 1000")).where("v >= 0").select("symbol", "us", "v")


_HIST = f"""with {TICKS}, w as (select symbol, us // {DAY} as day, (us - lag(us) over (partition by symbol order by us)) // 1000 as v from ticks), h as (select symbol, day, case when v = 0 then 0 else floor(log2(v))::int + 1 end as bucket, count(*) as n from w where v >= 0 group by all),
m as (select symbol, bucket, sum(n) as n from h group by all), c as (select symbol, bucket, sum(n) over (partition by symbol order by bucket) as c, sum(n) over (partition by symbol) as t from m)"""


@query("a19_percentile", _HIST + " select symbol, case when min(bucket) = 0 then 0 else (2 ** min(bucket))::bigint end as percentile from c where c >= ceil(t * 95 / 100) group by symbol")
def percentile(spark, d):
    """Daily histograms merged by sums, then one percentile; percentiles are never averaged."""
    daily = E.histogram(waits(spark, d).withColumn("day", F.expr(f"us div {DAY}")), "v", "symbol", "day")
    return E.histogram_percentile(daily, 95, 100, "symbol")


@query("a21_daily_gates", f"""with {TICKS}, q as (select us // {DAY} as day, count(*) as n, count(distinct user_id) as users, count(*) filter (where symbol = 'error') as errors, max(value) as top from ticks group by 1)
select day, n, concat_ws(',', case when n < 330 then 'coverage' end, case when errors * 5 > n then 'errors' end, case when top > 60 then 'outlier' end) as failed from q""")
def daily_gates(spark, d):
    q = ticks(spark, d).groupBy(F.expr(f"us div {DAY}").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("symbol") == "error").alias("errors"), F.max("value").alias("top"))
    rules = {"coverage": "n < 330", "errors": "errors * 5 > n", "outlier": "top > 60"}
    return q.select("day", "n", F.array_join(E.gates(rules), ",").alias("failed"))


@query("a22_cross_day", f"with {TICKS}, q as (select symbol, us // {DAY} as day, count(*) as n from ticks group by all) select symbol, count(*) as days, max(day) - min(day) + 1 = count(*) as contiguous, sum(n)::bigint as n, count(*) >= 7 and max(day) - min(day) + 1 = count(*) as ready from q group by 1")
def cross_day(spark, d):
    q = ticks(spark, d).groupBy("symbol", F.expr(f"us div {DAY}").alias("day")).agg(F.count("*").alias("n"))
    same = F.max("day") - F.min("day") + 1 == F.count("*")
    return q.groupBy("symbol").agg(F.count("*").alias("days"), same.alias("contiguous"), F.sum("n").alias("n"), ((F.count("*") >= 7) & same).alias("ready"))


@query("w27_rolling_week", f"with {TICKS}, q as (select symbol, us // {DAY} as day, count(*) as n from ticks group by all) select symbol, day, (sum(n) over w)::bigint as week from q window w as (partition by symbol order by day rows between 6 preceding and current row) qualify day - min(day) over w = 6")
def rolling_week(spark, d):
    q = ticks(spark, d).groupBy("symbol", F.expr(f"us div {DAY}").alias("day")).agg(F.count("*").alias("n"))
    w = W.partitionBy("symbol").orderBy("day").rowsBetween(-6, 0)
    return q.withColumns({"week": F.sum("n").over(w), "a": F.min("day").over(w)}).where("day - a = 6").select("symbol", "day", "week")


@query("a23_daily_counters", f"with {TICKS} select us // {DAY} as day, symbol, count(*) as n from ticks group by all")
def daily_counters(spark, d):
    return ticks(spark, d).groupBy(F.expr(f"us div {DAY}").alias("day"), "symbol").agg(F.count("*").alias("n"))


@query("a24_cluster_weights", "with w as (select l_returnflag, l_orderkey, avg(-ln(1 - l_discount)) as m from lineitem group by all) select l_returnflag, count(*) as clusters, round(avg(m), 6) as loss from w group by 1")
def cluster_weights(spark, d):
    loss = -F.ln(1 - F.col("l_discount"))
    w = read(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.avg(loss).alias("m"))
    return w.groupBy("l_returnflag").agg(F.count("*").alias("clusters"), F.round(F.avg("m"), 6).alias("loss"))


@query("a25_audit", "select bool_and(l_quantity > 0) as positive, bool_and(l_discount between 0 and 0.2) as bounded, bool_and(l_linenumber >= 1) as numbered, count(distinct (l_orderkey, l_linenumber)) = count(*) as unique_keys from lineitem")
def audit(spark, d):
    li = read(spark, d, "lineitem")
    keys = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_quantity").alias("q"), F.min("l_discount").alias("a"), F.max("l_discount").alias("b"))
    return keys.agg(F.every(F.col("q") > 0).alias("positive"), F.every((F.col("a") >= 0) & (F.col("b") <= 0.2)).alias("bounded"), F.every(F.col("l_linenumber") >= 1).alias("numbered"), (F.max("n") == 1).alias("unique_keys"))


@query("w19_clusters", f"""with {TICKS}, i as (select user_id, us as s, us + (value * 3600000000)::bigint as e from ticks), f as (select *, case when s > max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) or row_number() over (partition by user_id order by s, e) = 1 then 1 else 0 end as n from i)
select user_id, s, e, (sum(n) over (partition by user_id order by s, e))::bigint as cluster from f""")
def clusters(spark, d):
    from tidemark.operators.islands import episodes

    rows = ticks(spark, d).select("user_id", F.col("us").alias("s"), (F.col("us") + F.round(F.col("value") * 3_600_000_000).cast("long")).alias("e"))
    return episodes(rows, ["user_id"], "s", "e", "cluster")


@query("w28_ordered_surface", "select event_id, round(greatest(value - 5, 0), 6) as q1, round(greatest(value - 5, value * 0.8 - 2, 0), 6) as q2, round(greatest(value - 5, value * 0.8 - 2, 3), 6) as q3 from events")
def ordered_surface(spark, d):
    """Predictions clipped at 0 and made monotone over quantiles."""
    raw = [F.col("value") - 5, F.col("value") * 0.8 - 2, F.lit(3.0)]
    return read(spark, d, "events").select("event_id", *[F.round(F.greatest(*raw[: i + 1], F.lit(0.0)), 6).alias(f"q{i + 1}") for i in range(3)])


_STREAM = "select user_id, event_id, (us // 60000000) as arrival, (us // 60000000) - (event_id * 7) % 90 as event_time, (event_id // 3) % 40 as identity, (event_id % 5 <> 0)::int as digest from ticks"


def stream_rows(spark, d):
    t = ticks(spark, d)
    return t.select("user_id", "event_id", F.expr("us div 60000000").alias("arrival"), F.expr("us div 60000000 - (event_id * 7) % 90").alias("event_time"), F.expr("(event_id div 3) % 40").alias("identity"), F.expr("cast(event_id % 5 <> 0 as int)").alias("digest"))


@query("r01_replay", f"""with {TICKS}, s as ({_STREAM}), n as (select *, row_number() over (partition by user_id order by arrival, event_id) as i, greatest(-1, arrival - 30) as wa from s),
b as (select *, coalesce(lag(wa) over (partition by user_id order by i), -1) as wb, first_value(digest) over (partition by user_id, identity order by i) as f, row_number() over (partition by user_id, identity order by i) as k from n),
c as (select *, min(case when digest <> f then i end) over (partition by user_id, identity) as c from b),
e as (select c.user_id, c.i, min(x.i) as due from c left join c x on x.user_id = c.user_id and x.wa >= c.event_time group by 1, 2)
select c.user_id, c.event_id, case when k > 1 and c <= c.i then 'CONFLICT' when k > 1 then 'DUPLICATE' when event_time <= wb then 'LATE' when c <= greatest(c.i, coalesce(due, 2147483647)) then 'CONFLICT' else 'VALID' end as state,
  case when k > 1 or event_time <= wb or coalesce(c <= greatest(c.i, coalesce(due, 2147483647)), false) then false else true end as authoritative from c join e on e.user_id = c.user_id and e.i = c.i""")
def replay(spark, d):
    out = R.replay(stream_rows(spark, d), "user_id", "identity", "event_time", "arrival", "digest", "event_id", 30)
    return out.select("user_id", "event_id", "state", "authoritative")


@query("r04_faults", f"with {TICKS}, n as (select user_id, event_id, row_number() over (partition by user_id order by us, event_id) - 1 as i from ticks) select user_id, event_id, i::int as index, case when i = 1 then 'GAP' when i between 2 and 3 then 'DISCONNECT' when i = 5 then 'DUPLICATE' end as fault from n")
def faults(spark, d):
    plan = spark.createDataFrame([("GAP", 1, 1), ("DISCONNECT", 2, 2), ("DUPLICATE", 5, 1)], "kind string, first_index int, n int")
    return R.inject(ticks(spark, d), "user_id", "us", "event_id", plan).select("user_id", "event_id", "index", "fault")


@query("r11_day_windows", f"with {TICKS} select us - us % {DAY} as day_us, symbol, count(*) as n, round(sum(value), 6) as total from ticks group by all")
def day_windows(spark, d):
    w = F.window(F.timestamp_micros("us"), "1 day")
    out = ticks(spark, d).groupBy(w, "symbol").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.unix_micros("window.start").alias("day_us"), "symbol", "n", "total")


@query("a17_bootstrap")
def bootstrap(spark, d):
    """Daily sums in Spark, blocks drawn on the driver (a row a day)."""
    t = ticks(spark, d).where("symbol = 'purchase'")
    days = t.groupBy(F.expr(f"us div {DAY}").alias("day")).agg(F.sum(E.pinball(F.col("value"), F.lit(12.0), 0.9)).alias("loss"), F.sum(E.pinball(F.col("value"), F.lit(0.0), 0.9)).alias("base")).orderBy("day").toPandas()
    got = E.block_bootstrap(days["day"].to_numpy(), days["loss"].to_numpy(), days["base"].to_numpy())
    return spark.createDataFrame([(got["status"], got.get("gain"), got.get("low"), got.get("high"))], "status string, gain double, low double, high double")


@query("m11_logistic")
def logistic(spark, d):
    """Chance of a return flag from quantity and discount; coefficients."""
    li = read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    beta = E.irls(li, ["a", "b"], "y")
    return spark.createDataFrame([(n, float(v)) for n, v in zip(("intercept", "a", "b"), np.asarray(beta))], "name string, value double")
