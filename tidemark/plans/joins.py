"""Queries over joins, sets, sorts and reconciliation."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemark.operators import bars as B, joins as J
from tidemark.plans.base import BARS, DAY, HOUR, TICKS, bars, query, read, ticks

US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


@query("j05_asof_eligibility", f"""with {TICKS}, l as (select event_id, user_id, us from ticks where symbol = 'purchase'), r as (select user_id, us as rus, symbol = 'signup' and value > 3 as eligible from ticks where symbol = 'signup')
select l.event_id, l.user_id, l.us, r.eligible, r.rus as asof_time from l asof left join r on l.user_id = r.user_id and l.us >= r.rus""")
def asof_eligibility(spark, d):
    t = ticks(spark, d)
    left = t.where("symbol = 'purchase'").select("user_id", "event_id", "us")
    right = t.where("symbol = 'signup'").select("user_id", F.col("us").alias("rus"), (F.col("value") > 3).alias("eligible"))
    return J.asof(left, right, ["user_id"], "us", "rus", ["eligible"])


@query("j06_asof_usable", f"""with {TICKS}, l as (select event_id, user_id, us from ticks where symbol = 'click'), r as (select user_id, us as rus, value as limit_value from ticks where symbol = 'view' and value > 5)
select l.event_id, l.user_id, l.us, r.limit_value, r.rus as asof_time from l asof left join r on l.user_id = r.user_id and l.us >= r.rus""")
def asof_usable(spark, d):
    """The right side is filtered before the join: the last usable row, not the last row if usable."""
    t = ticks(spark, d)
    left = t.where("symbol = 'click'").select("user_id", "event_id", "us")
    right = t.where("symbol = 'view' and value > 5").select("user_id", F.col("us").alias("rus"), F.col("value").alias("limit_value"))
    return J.asof(left, right, ["user_id"], "us", "rus", ["limit_value"])


@query("j02_one_to_one", f"with {BARS} select symbol, open_us, close, trades from bars")
def one_to_one(spark, d):
    b = bars(spark, d)
    return J.one_to_one(b.select("symbol", "open_us", "close"), b.select("symbol", "open_us", "trades"), ["symbol", "open_us"])


@query("j03_semi_candidates", "select l_orderkey, l_linenumber, l_quantity from lineitem semi join (select * from orders where o_orderpriority = '1-URGENT') o on l_orderkey = o_orderkey")
def semi_candidates(spark, d):
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    li = read(spark, d, "lineitem")
    return li.join(urgent, li["l_orderkey"] == urgent["o_orderkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("j12_trades_in_bar", f"""with {BARS}, s as (select symbol, open_us, us as at, us + 1800000000 as until from (select bars.symbol, bars.open_us, bars.open_us + 600000000 as us from bars where trades > 4))
select s.symbol, s.open_us, count(*) as n, round(sum(value), 6) as total from s join ticks t on t.symbol = s.symbol and t.us between s.at and s.until group by all""")
def trades_in_bar(spark, d):
    spans = bars(spark, d).where("trades > 4").select("symbol", "open_us", (F.col("open_us") + 600_000_000).alias("at"), (F.col("open_us") + 2_400_000_000).alias("until"))
    found = J.in_interval(ticks(spark, d), spans, "symbol", "us", "at", "until", HOUR)
    return found.groupBy("symbol", "open_us").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("j09_products", "select c_nationkey, count(*) as n, string_agg(c_name, ',' order by c_custkey) as names, max(s.k) as suppliers from customer left join (select s_nationkey, count(*) as k from supplier group by 1) s on c_nationkey = s_nationkey where c_mktsegment = 'BUILDING' group by 1")
def products(spark, d):
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("k"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), ",")
    return c.join(s, c["c_nationkey"] == s["s_nationkey"], "left").groupBy("c_nationkey").agg(F.count("*").alias("n"), names.alias("names"), F.max("k").alias("suppliers"))


@query("j08_reconcile", f"""with {BARS}, p as (select symbol, open_us, close * 0.9 as prediction, trades from bars where trades % 2 = 0), f as (select *, max(high) over (partition by symbol order by open_us range between 1 following and 10800000000 following) as future,
  count(*) over (partition by symbol order by open_us range between 1 following and 10800000000 following) as seen from bars)
select p.symbol, p.open_us, case when p.trades > 8 then 'unscored' when p.prediction < 1 then 'invalid_prediction' when p.open_us + 10800000000 > 1706313600000000 then 'pending' when f.seen = 0 then 'missing_source' when f.seen < 3 then 'incomplete_horizon' else 'observed' end as state,
  round(greatest(0.9 * (f.future - p.prediction), -0.1 * (f.future - p.prediction)), 6) as loss from p join f using (symbol, open_us)""")
def reconcile(spark, d):
    """Prediction against the bars that follow, as a ladder of states."""
    b = bars(spark, d)
    w = W.partitionBy("symbol").orderBy("open_us").rangeBetween(1, 3 * HOUR)
    f = b.withColumns({"future": F.max("high").over(w), "seen": F.count("*").over(w)}).where("trades % 2 = 0").withColumn("prediction", F.col("close") * 0.9)
    state = F.when(F.col("trades") > 8, "unscored").when(F.col("prediction") < 1, "invalid_prediction").when(F.col("open_us") + 3 * HOUR > 1706313600000000, "pending").when(F.col("seen") == 0, "missing_source").when(F.col("seen") < 3, "incomplete_horizon").otherwise("observed")
    e = F.col("future") - F.col("prediction")
    return f.select("symbol", "open_us", state.alias("state"), F.round(F.greatest(0.9 * e, -0.1 * e), 6).alias("loss"))


@query("j10_population", f"""with {TICKS}, r as (select distinct user_id from ticks where us < 1705276800000000), c as (select distinct user_id from ticks where us >= 1706140800000000)
select coalesce(r.user_id, c.user_id) as user_id, case when c.user_id is null then 'removed' when r.user_id is null then 'added' else 'matched' end as state from r full join c on r.user_id = c.user_id""")
def population(spark, d):
    t = ticks(spark, d)
    flags = t.groupBy("user_id").agg(F.max((F.col("us") < 1705276800000000).cast("int")).alias("r"), F.max((F.col("us") >= 1706140800000000).cast("int")).alias("c")).where("r + c > 0")
    return flags.select("user_id", F.when(F.col("c") == 0, "removed").when(F.col("r") == 0, "added").otherwise("matched").alias("state"))


@query("j14_slots", f"""with {TICKS}, g as (select s.symbol, unnest(generate_series(1704067200000000, 1706572800000000, 86400000000)) as day_us from (select distinct symbol from ticks) s),
k as (select symbol, us - us % 86400000000 as day_us, count(*) as n, count(distinct user_id) > 1 as conflict from ticks where symbol in ('signup', 'error') group by all)
select g.symbol, g.day_us, coalesce(k.n, 0) as n, case when k.n is null then 'missing' when conflict then 'conflict' else 'available' end as state from g left join k using (symbol, day_us)""")
def slots(spark, d):
    t = ticks(spark, d)
    grid = t.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(1704067200000000), F.lit(1706572800000000), F.lit(DAY))).alias("day_us"))
    got = t.where(F.col("symbol").isin("signup", "error")).groupBy("symbol", B.bucket_start("us", DAY).alias("day_us")).agg(F.count("*").alias("n"), (F.min("user_id") != F.max("user_id")).alias("conflict"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("conflict"), "conflict").otherwise("available")
    return grid.join(got, ["symbol", "day_us"], "left").select("symbol", "day_us", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


@query("j15_quantile_lookup", """with g as (select l_returnflag, quantile_cont(l_extendedprice, 0.9) as q, count(*) as n from lineitem group by 1), a as (select quantile_cont(l_extendedprice, 0.9) as q from lineitem)
select l_returnflag, l_linestatus, count(*) as n_rows, round(max(coalesce(case when g.n >= 1000 then g.q end, a.q)), 4) as q from lineitem left join g using (l_returnflag), a group by 1, 2""")
def quantile_lookup(spark, d):
    li = read(spark, d, "lineitem")
    q = F.percentile("l_extendedprice", F.lit(0.9))
    by = li.groupBy("l_returnflag").agg(q.alias("q"), F.count("*").alias("n")).where("n >= 1000").select("l_returnflag", "q")
    whole = li.agg(q.alias("all_q"))
    rows = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_rows")).join(F.broadcast(by), "l_returnflag", "left")  # one row a flag
    return rows.join(F.broadcast(whole), F.lit(True)).select("l_returnflag", "l_linestatus", "n_rows", F.round(F.coalesce("q", "all_q"), 4).alias("q"))


@query("j16_volatility_bin", "select event_id, (value > 2)::int + (value > 5)::int + (value > 11)::int + (value > 30)::int as bin from events")
def volatility_bin(spark, d):
    return read(spark, d, "events").select("event_id", J.bin_of(F.col("value"), [2.0, 5.0, 11.0, 30.0]).alias("bin"))


@query("a07_canonicalize", f"""with {TICKS}, x as (select user_id, us // 86400000000 as day, symbol as digest from ticks) select user_id, day, count(*) as n_rows, case when count(distinct digest) > 1 then 'CONFLICT' else 'VALID' end as state,
  case when count(distinct digest) > 1 then 0 else count(*) - 1 end as duplicate_rows, case when count(distinct digest) = 1 then min(digest) end as digest from x group by 1, 2""")
def canonicalize(spark, d):
    rows = ticks(spark, d).select("user_id", F.expr(f"us div {DAY}").alias("day"), F.col("symbol").alias("digest"))
    return J.canonicalize(rows, ["user_id", "day"], "digest")


@query("r08_revisions", f"""with {TICKS}, x as (select user_id, us // 86400000000 as day, symbol as digest, us from ticks) select user_id, day, us, digest, case when row_number() over w = 1 then 'FIRST' when digest = first_value(digest) over w then 'DUPLICATE' else 'CONFLICT' end as observation from x window w as (partition by user_id, day order by us)""")
def revisions(spark, d):
    rows = ticks(spark, d).select("user_id", F.expr(f"us div {DAY}").alias("day"), F.col("symbol").alias("digest"), "us")
    return J.classify_revisions(rows, ["user_id", "day"], "digest", "us")


@query("a06_reconstruct", f"""with {TICKS}, t as (select symbol, us - us % 3600000000 as open_us, us, event_id, user_id, round(value * 100)::bigint as price, lag(us) over (partition by symbol order by us) as p from ticks)
select symbol, open_us, arg_min(price, us) as open, max(price) as high, min(price) as low, arg_max(price, us) as close, sum(price * (user_id + 1))::bigint as quote, (coalesce(sum(price * (user_id + 1)) filter (where user_id % 2 = 0), 0))::bigint as taker_quote, count(*) as n,
  concat_ws(',', case when count(*) > 6 then 'count' end, case when max(price) > 3 * min(price) then 'range' end, case when max(us - p) > 1800000000 then 'gap' end) as mismatches from t group by 1, 2""")
def reconstruct(spark, d):
    """Exact integer money: bars rebuilt from trades with the codes of what does not fit."""
    w = W.partitionBy("symbol").orderBy("us")
    t = ticks(spark, d).select("symbol", B.bucket_start("us", HOUR).alias("open_us"), "us", "user_id", F.round(F.col("value") * 100).cast("long").alias("price"), (F.col("us") - F.lag("us").over(w)).alias("wait"))
    money = F.col("price") * (F.col("user_id") + 1)
    rows = t.groupBy("symbol", "open_us").agg(
        F.min_by("price", "us").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "us").alias("close"), F.sum(money).alias("quote"),
        F.coalesce(F.sum(F.when(F.col("user_id") % 2 == 0, money)), F.lit(0)).alias("taker_quote"), F.count("*").alias("n"), F.max("wait").alias("wait"),
    )
    rules = {"count": "n > 6", "range": "high > 3 * low", "gap": "wait > 1800000000"}
    return rows.withColumn("mismatches", F.array_join(B.violations(rules), ",")).drop("wait")


@query("t01_rank", "select c_custkey, c_acctbal, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer order by c_acctbal desc, c_custkey limit 30")
def rank(spark, d):
    """The top is taken first; only 30 rows are numbered."""
    top = read(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(30)
    return top.select("c_custkey", "c_acctbal", F.row_number().over(W.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("rank"))


@query("t04_hash_sample", "select c_custkey, c_name from (select *, sha256('7:' || c_name) as h from customer where c_mktsegment = 'BUILDING') order by h limit 25")
def hash_sample(spark, d):
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return c.orderBy(F.sha2(F.concat_ws(":", F.lit("7"), "c_name"), 256)).limit(25).select("c_custkey", "c_name")


@query("t05_stride", "select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 as k from customer) where k % 3 = 0")
def stride(spark, d):
    k = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return read(spark, d, "customer").withColumn("k", k).where("k % 3 = 0").select("c_nationkey", "c_custkey")


@query("t06_first_per_month", "select month, o_orderkey from (select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, row_number() over (partition by strftime(o_orderdate, '%Y-%m') order by o_orderdate, o_orderkey) as k from orders) where k <= 5")
def first_per_month(spark, d):
    o = read(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return o.withColumn("k", F.row_number().over(W.partitionBy("month").orderBy("o_orderdate", "o_orderkey"))).where("k <= 5").select("month", "o_orderkey")


@query("t07_tail", f"with {BARS} select symbol, open_us, close from bars qualify row_number() over (partition by symbol order by open_us desc) <= 12")
def tail(spark, d):
    k = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("open_us")))
    return bars(spark, d).withColumn("k", k).where("k <= 12").select("symbol", "open_us", "close")


@query("t09_best", "select l_returnflag, arg_min(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) as best, min(l_extendedprice) as price from lineitem group by 1")
def best(spark, d):
    li = read(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("best"), F.min("l_extendedprice").alias("price"))


@query("u02_union_by_name", "select c_custkey as k, c_name as name, null::varchar as brand from customer union all select p_partkey, p_name, p_brand from part")
def union_by_name(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u04_set_difference", "(select o_custkey as k from orders where o_orderstatus = 'F') except (select o_custkey from orders where o_orderstatus = 'O') union all (select c_custkey as k from customer where c_nationkey = 3 intersect select o_custkey from orders)")
def set_difference(spark, d):
    o = read(spark, d, "orders")
    k = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    c = read(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("k"))
    return k("F").subtract(k("O")).union(c.intersect(o.select(F.col("o_custkey").alias("k"))))


@query("p11_pool_policy", "select c_custkey, case when c_acctbal < 0 then 'negative_balance' when c_mktsegment in ('MACHINERY', 'HOUSEHOLD') then 'excluded_segment' when not regexp_matches(c_name, '^Customer#[0-9]+$') then 'bad_name' end as exclusion from customer")
def pool_policy(spark, d):
    """First reason that matches; null is admitted."""
    reason = F.when(F.col("c_acctbal") < 0, "negative_balance").when(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD"), "excluded_segment").when(~F.col("c_name").rlike("^Customer#[0-9]+$"), "bad_name")
    return read(spark, d, "customer").select("c_custkey", reason.alias("exclusion"))


@query("p14_requested", "select n_nationkey, n_name from nation where n_nationkey in (1, 3, 5)")
def requested(spark, d):
    """Unknown names are refused inside the plan, not by a driver-side check."""
    want = spark.createDataFrame([(1,), (3,), (5,)], "n_nationkey int")
    found = want.join(read(spark, d, "nation"), "n_nationkey", "left")
    known = F.when(F.col("n_name").isNotNull(), True).otherwise(F.raise_error(F.lit("unknown key")).cast("boolean"))
    return found.where(known).select("n_nationkey", "n_name")


@query("p22_contiguous_months", "with m as (select o_custkey, year(o_orderdate) * 12 + month(o_orderdate) as m from orders) select o_custkey, count(distinct m) as months, max(m) - min(m) + 1 = count(distinct m) as contiguous from m group by 1")
def contiguous_months(spark, d):
    m = read(spark, d, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).distinct()
    return m.groupBy("o_custkey").agg(F.count("*").alias("months"), (F.max("m") - F.min("m") + 1 == F.count("*")).alias("contiguous"))


@query("f_scalar_functions", """select event_id, (floor(epoch_us(ts) / 3600000000) * 3600000000)::bigint as hour_us, strftime(ts, '%Y-%m') as month, last_day(ts)::varchar as month_end, round(ln(1 + value), 6) as log_value, sha256(event_type || ':' || event_id) as digest, upper(event_type) as name,
  event_type like 's%' as starts, round(1 / (1 + exp(-least(greatest(value, -30), 30))), 6) as logistic from events""")
def scalar_functions(spark, d):
    e = read(spark, d, "events")
    us = F.expr(US.format("ts"))
    return e.select("event_id", B.bucket_start(us, HOUR).alias("hour_us"), F.date_format("ts", "yyyy-MM").alias("month"), F.last_day("ts").cast("string").alias("month_end"), F.round(F.log1p("value"), 6).alias("log_value"), F.sha2(F.concat_ws(":", "event_type", F.col("event_id").cast("string")), 256).alias("digest"), F.upper("event_type").alias("name"), F.col("event_type").startswith("s").alias("starts"), F.round(1 / (1 + F.exp(-F.least(F.greatest(F.col("value"), F.lit(-30.0)), F.lit(30.0)))), 6).alias("logistic"))
