"""Queries over sources, sinks, admission, reconciliation and model pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import bars as B, evaluate as E, islands as I, joins as J, labels as L
from tidemark.plans.bars import segs
from tidemark.plans.base import BARS, DAY, HOUR, SEGMENTS, TICKS, bars, query, read, ticks
from tidemark.session import shared_dir
from tidemark.sources import archives, manifests, wire


@query("k01_publish_reload", f"with {BARS} select symbol, open_us, close, trades from bars")
def publish_reload(spark, d):
    """Bars published with hashes, and accepted again only as what was published."""
    path = manifests.publish(bars(spark, d).select("symbol", "open_us", "close", "trades"), f"{shared_dir(spark)}/published-{uuid.uuid4().hex}", {"table": "bars"}, ["symbol", "open_us"])
    return manifests.reload(spark, path)


@query("s22_dataset", f"with {BARS} select symbol, open_us, close, high from bars")
def dataset(spark, d):
    """Two published caches joined one to one."""
    root, b = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}", bars(spark, d)
    key = ["symbol", "open_us"]
    paths = [manifests.publish(b.select(*key, c), f"{root}/{c}", {"cache": c}, key) for c in ("close", "high")]
    return manifests.load_dataset(spark, *paths, key)


@query("s06_archives", f"with {BARS} select symbol, open_us, open_us + 3599999000 as close_us, round(open, 6) as open, round(close, 6) as close, trades from bars where low > 0")
def zip_archives(spark, d):
    """A ZIP archive for each symbol and day, decoded again; days before 2025 count milliseconds."""
    b = bars(spark, d).where("low > 0")
    day = F.date_format(F.timestamp_micros("open_us"), "yyyy-MM-dd")
    price = lambda c: F.round(c, 6).cast("decimal(18,6)").cast("string").alias(c)
    raw = b.select(F.concat_ws("-", "symbol", F.lit("1m"), F.concat(day, F.lit(".zip"))).alias("archive"), F.expr("open_us div 1000").alias("open_time"), price("open"), price("high"), price("low"), price("close"), price("turnover").alias("volume"), F.expr("(open_us + 3599999000) div 1000").alias("close_time"), price("turnover"), "trades", price("taker").alias("taker_volume"), price("taker"), F.lit("0").alias("ignored"))
    told = archives.decode(archives.encode(raw))
    return told.select("symbol", "open_us", "close_us", F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"), "trades")


@query("s11_by_day", f"with {BARS} select symbol, make_timestamp(open_us)::date::varchar as day, count(*) as n, min(open_us) as first_us, max(open_us) as last_us from bars group by 1, 2")
def reload_by_day(spark, d):
    return archives.by_day(bars(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("s10_timestamp_unit", "select o_orderkey, case when o_orderdate::date + 9900 >= date '2025-01-01' then 'us' else 'ms' end as unit from orders")
def unit(spark, d):
    return read(spark, d, "orders").select("o_orderkey", archives.timestamp_unit(F.date_add(F.to_date("o_orderdate"), 9900)).alias("unit"))


@query("s12_rest_page", "select n_name as symbol, (n_nationkey * 86400000 + i * 60000)::bigint * 1000 as open_us, (1 + i)::double as open, (2 + i)::double as high, (10 * i)::double as turnover, i::bigint as trades from nation, unnest(generate_series(0, 59)) as g(i)")
def rest_page(spark, d):
    row = lambda i: F.array(*[F.concat(x, F.lit("")) for x in ((F.col("start") + i * 60000).cast("string"), (i + 1).cast("string"), (i + 2).cast("string"), F.lit("0.5"), (i + 1).cast("string"), F.lit("3"), F.lit("0"), (i * 10).cast("string"), i.cast("string"), F.lit("1"), F.lit("1"), F.lit("0"))])
    n = read(spark, d, "nation").select(F.col("n_name").alias("symbol"), (F.col("n_nationkey").cast("long") * 86_400_000).alias("start"))
    pages = n.select("symbol", F.col("start").alias("page_start"), F.lit(60).alias("count"), F.to_json(F.transform(F.sequence(F.lit(0), F.lit(59)), row)).alias("payload"))
    out = wire.page_of_bars(pages)
    return out.select("symbol", "open_us", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "turnover")], "trades")


_SYMBOLS = "x as (select replace(n_name, '_', '') || case when n_regionkey < 3 then 'USDT' else 'BTC' end as symbol, case when n_nationkey % 4 = 0 then 'BREAK' else 'TRADING' end as status, replace(n_name, '_', '') as base, case when n_regionkey < 3 then 'USDT' else 'BTC' end as quote, n_nationkey % 3 <> 0 as spot_allowed, n_nationkey as k from nation)"


def exchange(spark, d):
    n = read(spark, d, "nation").withColumn("base", F.replace("n_name", F.lit("_"), F.lit("")))
    quote = F.when(F.col("n_regionkey") < 3, "USDT").otherwise("BTC")
    one = F.struct(
        F.concat("base", quote).alias("symbol"), F.when(F.col("n_nationkey") % 4 == 0, "BREAK").otherwise("TRADING").alias("status"), F.col("base").alias("baseAsset"), quote.alias("quoteAsset"), (F.col("n_nationkey") % 3 != 0).alias("isSpotTradingAllowed"),
        F.array(F.lit("SPOT")).alias("permissions"), F.array(F.array(F.lit("SPOT"), F.lit("MARGIN"))).alias("permissionSets"),
        F.array(F.struct(F.lit("LOT_SIZE").alias("filterType"), F.lit(None).cast("string").alias("tickSize"), F.lit("0.10").alias("stepSize")), F.struct(F.lit("PRICE_FILTER").alias("filterType"), F.concat(F.lit("0.0"), F.col("n_nationkey").cast("string")).alias("tickSize"), F.lit(None).cast("string").alias("stepSize"))).alias("filters"),
    )
    return wire.exchange_symbols(n.select(F.to_json(F.struct(F.array(one).alias("symbols"))).alias("payload")))


@query("s13_exchange_info", f"with {_SYMBOLS} select symbol, status, base, quote, spot_allowed, 'SPOT,MARGIN' as permissions, '0.0' || k as tick_size, '0.10' as step_size, true as supported from x")
def exchange_info(spark, d):
    return exchange(spark, d).withColumn("permissions", F.array_join("permissions", ","))


@query("p10_universe", f"with {_SYMBOLS} select symbol from x where status = 'TRADING' and quote = 'USDT'")
def spot_universe(spark, d):
    return wire.universe(exchange(spark, d)).select("symbol")


@query("p12_alert_universe", f"with {_SYMBOLS} select symbol from x where status = 'TRADING' and quote = 'USDT' and spot_allowed and base not in ('NATION1', 'NATION5') and regexp_full_match(symbol, '[A-Z0-9]{{4,30}}')")
def alert_universe(spark, d):
    return wire.alert_universe(exchange(spark, d), ["NATION1", "NATION5"]).select("symbol")


@query("s15_live_frames", f"with {TICKS} select upper(symbol) as symbol, event_id as trade_id, round(value, 4) as price, us // 1000 * 1000 as trade_us, user_id % 2 = 0 as buyer_is_maker from ticks where symbol <> 'error'")
def live_frames(spark, d):
    """Frames of two streams, told apart by their suffix; trades come out typed."""
    t = ticks(spark, d)
    trade = F.struct(F.lit(1).alias("E"), F.upper("symbol").alias("s"), F.col("event_id").alias("a"), F.round("value", 4).cast("decimal(18,4)").cast("string").alias("p"), F.lit("1").alias("q"), F.col("event_id").alias("f"), F.col("event_id").alias("l"), F.expr("us div 1000").alias("T"), (F.col("user_id") % 2 == 0).alias("m"))
    name = F.concat("symbol", F.when(F.col("symbol") == "error", "@bookTicker").otherwise("@aggTrade"))
    out = wire.live_frames(t.select(F.to_json(F.struct(name.alias("stream"), trade.alias("data"))).alias("value")))["trade"]
    return out.select("symbol", "trade_id", F.col("price").cast("double").alias("price"), "trade_us", "buyer_is_maker")


@query("s16_scan_report", "with x as (select c_nationkey::varchar as symbol, case when c_custkey % 7 = 0 then 'failed' else 'success' end as state from customer) select 'm' as model_id, 5::bigint as decision_us, symbol, case when count(distinct state) > 1 then 'conflict' else min(state) end as state from x group by symbol")
def scan_report(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("symbol"), F.when(F.col("c_custkey") % 7 == 0, "failed").otherwise("success").alias("state"), F.lit(1.0).alias("value"))
    payload = rows.groupBy().agg(F.to_json(F.struct(F.lit("m").alias("model_id"), F.lit(5).cast("long").alias("decision_us"), F.collect_list(F.struct("symbol", "state", "value")).alias("rows"))).alias("payload"))  # a report is one document
    return wire.scan_report(payload).drop("value")


_PREDICTED = """p as (select c_custkey, case when c_custkey % 11 = 0 then 'conflict' when c_custkey % 7 = 0 then 'failed' else 'success' end as state, case when c_custkey % 13 <> 0 then c_acctbal / 100 end as value, c_custkey % 5 * 10 as decision_us, c_custkey % 9 as origin from customer),
f as (select c_custkey, case when c_custkey % 17 = 0 then 'conflict' else 'success' end as state, c_custkey % 4 = 1 as gone, 60 + c_custkey % 6 * 20 as future_us, case when c_custkey % 19 = 0 then -1 else c_custkey % 9 end as origin, 12 - (c_custkey % 23 = 0)::int as bars, c_acctbal / 90 as realized, c_custkey % 29 = 0 as broken from customer where c_custkey % 8 <> 3),
r as (select p.c_custkey, case when p.state = 'conflict' then 'conflict' when p.state <> 'success' then 'unscored' when value is null then 'invalid_prediction' when 120 < decision_us + 100 then 'pending' when f.state = 'conflict' then 'conflict' when f.c_custkey is null or gone then 'missing_source' when future_us > 120 then 'source_after_as_of' when broken then 'invalid_source'
  when bars <> 12 then 'incomplete_horizon' when f.origin <> p.origin then 'conflict' else 'observed' end as outcome, value, realized from p left join f using (c_custkey))"""


def reconciled(spark, d):
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    name = k.cast("string").alias("symbol")
    p = c.select(name, (k % 5 * 10).cast("long").alias("decision_us"), F.when(k % 11 == 0, "conflict").when(k % 7 == 0, "failed").otherwise("success").alias("state"), F.when(k % 13 != 0, F.col("c_acctbal") / 100).alias("value"), (k % 9).alias("origin"))
    f = c.where(k % 8 != 3).select(name, F.when(k % 17 == 0, "conflict").otherwise("success").alias("state"), F.when(k % 4 != 1, "s").alias("source"), (60 + k % 6 * 20).alias("future_us"), F.when(k % 19 == 0, -1).otherwise(k % 9).alias("origin"), F.when(k % 23 == 0, 11).otherwise(12).alias("bars"), F.lit(12).alias("wanted"), (F.col("c_acctbal") / 90).alias("realized"), (k % 29 == 0).alias("broken"))
    return J.reconcile(p, f, 120, 100, 0.9)


@query("j08_nine_states", f"with {_PREDICTED} select c_custkey::varchar as symbol, outcome, case when outcome = 'observed' then round(greatest(0.9 * (realized - value), -0.1 * (realized - value)), 6) end as loss from r")
def nine_states(spark, d):
    return reconciled(spark, d).select("symbol", "outcome", F.round("loss", 6).alias("loss"))


@query("a11_state_counts", f"with {_PREDICTED} select outcome, count(*) as n from r group by 1")
def state_counts(spark, d):
    return E.state_counts(reconciled(spark, d), "outcome")


@query("a27_outcome_summary", f"with {_PREDICTED} select count(*) as members, count(*) filter (where outcome = 'observed') as observed, round(avg(greatest(0.9 * (realized - value), -0.1 * (realized - value))) filter (where outcome = 'observed'), 6) as mean_loss, round(avg((realized <= value)::int) filter (where outcome = 'observed'), 6) as coverage from r")
def outcome_summary(spark, d):
    out = E.outcome_summary(reconciled(spark, d), "outcome")
    return out.withColumns({"mean_loss": F.round("mean_loss", 6), "coverage": F.round("coverage", 6)})


_FACTS = "count(*) as persisted, 340 as expected, count(*) filter (where symbol <> 'signup') as closed, count(*) filter (where value > 70) as conflicts, count(*) filter (where user_id = 3) // 6 as gaps, 0 as schema_mismatches, count(*) filter (where value > 80) as queue_overflows, 0 as unresolved_recoveries, count(distinct user_id) // 140 as unknown_symbols, max(us) % 86400000000 * 1000 + 3600000000000 as metadata_age_ns, case when max(user_id) % 2 = 0 then max(value)::int * 2 end as clock_offset_ms, 0 as negative_latency, max(value) * 8000000 as latency_p95, max(value) * 20000000 as latency_p99, max(value) * 50000000 as kline_latency_p95"


@query("a21_capture_gates", f"with {TICKS}, q as (select us // {DAY} as day, {_FACTS}, us // {DAY} % 3 <> 0 as representative from ticks group by us // {DAY}) select day, concat_ws(',', " + ", ".join(f"case when {rule} then '{code}' end" for code, rule in E.CAPTURE_GATES.items()) + ") as failed from q")
def capture_gates(spark, d):
    """All 17 gates of a day's capture."""
    v, u = F.col("value"), F.col("user_id")
    q = ticks(spark, d).groupBy(F.expr(f"us div {DAY}").alias("day")).agg(
        F.count("*").alias("persisted"), F.lit(340).alias("expected"), F.count_if(F.col("symbol") != "signup").alias("closed"), F.count_if(v > 70).alias("conflicts"), F.expr("count_if(user_id = 3) div 6").alias("gaps"), F.lit(0).alias("schema_mismatches"), F.count_if(v > 80).alias("queue_overflows"), F.lit(0).alias("unresolved_recoveries"),
        F.expr("count(distinct user_id) div 140").alias("unknown_symbols"), (F.max("us") % DAY * 1000 + 3_600_000_000_000).alias("metadata_age_ns"), F.when(F.max(u) % 2 == 0, F.round(F.max(v)).cast("int") * 2).alias("clock_offset_ms"), F.lit(0).alias("negative_latency"), (F.max(v) * 8_000_000).alias("latency_p95"), (F.max(v) * 20_000_000).alias("latency_p99"), (F.max(v) * 50_000_000).alias("kline_latency_p95"),
    ).withColumn("representative", F.col("day") % 3 != 0)
    return q.select("day", F.array_join(E.gates(E.CAPTURE_GATES), ",").alias("failed"))


@query("p04_trade_rules", f"with {TICKS} select event_id, concat_ws(',', case when value <= 1 then 'price_not_positive' end, case when user_id % 5 = 0 then 'quantity_not_positive' end, case when event_id % 7 = 0 then 'id_range' end) as codes from ticks")
def trade_rules(spark, d):
    t = ticks(spark, d).select("event_id", F.when(F.col("value") > 1, F.col("value")).otherwise(0.0).alias("price"), (F.col("user_id") % 5).alias("quantity"), F.when(F.col("event_id") % 7 == 0, 2).otherwise(1).alias("first_id"), F.lit(1).alias("last_id"))
    return t.select("event_id", F.array_join(B.violations(wire.TRADE_RULES), ",").alias("codes"))


@query("p03_kline_rules", f"with {BARS} select symbol, open_us, concat_ws(',', case when high * 0.9 < greatest(open, close) then 'high_below_body' end, case when low > least(open, close) then 'low_above_body' end, case when taker > turnover then 'taker_exceeds_total' end, case when turnover < 0 or taker < 0 or trades < 0 then 'negative' end, case when low <= 0 then 'not_positive' end) as codes from bars")
def kline_rules(spark, d):
    return bars(spark, d).withColumn("high", F.col("high") * 0.9).select("symbol", "open_us", F.array_join(B.violations(wire.KLINE_RULES), ",").alias("codes"))


@query("w26_trade_gaps", f"with {TICKS} select symbol, event_id as trade_id, greatest(0, event_id - lag(event_id) over w - 1) as id_gap, greatest(0, event_id * 2 - (lag(event_id) over w * 2 + 1) - 1) as range_gap from ticks window w as (partition by symbol order by event_id)")
def trade_gaps(spark, d):
    t = ticks(spark, d).select("symbol", F.col("event_id").alias("trade_id"), (F.col("event_id") * 2).alias("first_id"), (F.col("event_id") * 2 + 1).alias("last_id"))
    return wire.trade_gaps(t).select("symbol", "trade_id", *[F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("id_gap", "range_gap")])


@query("p16_decimal_admission", f"with {BARS} select symbol, count(*) filter (where low <= 0) as bad_prices, 0::bigint as collapsed, count(*) filter (where low <= 0) = 0 as admitted from bars group by symbol")
def decimal_admission(spark, d):
    b = bars(spark, d).withColumns({c: F.col(c).cast("decimal(38,18)") for c in ("open", "high", "low", "close")})
    return L.decimal_admission(b, ["open", "high", "low", "close"], "close")


@query("w21_subgrid", f"with {BARS} select symbol, open_us from bars where open_us % 18000000000 = 0")
def subgrid(spark, d):
    return I.subgrid(bars(spark, d), "open_us", 4 * HOUR, HOUR).select("symbol", "open_us")


@query("w14_first_hit_360", f"""with {SEGMENTS}, p as (select *, row_number() over (partition by symbol, segment order by open_us) as k from segs)
select a.symbol, a.open_us, (min(b.k - a.k) filter (where b.high >= a.close * 6))::int as up_step, (min(b.k - a.k) filter (where b.low <= a.close * 0.05))::int as low_step
from p a left join p b on a.symbol = b.symbol and a.segment = b.segment and b.k > a.k and b.k <= a.k + 360 group by a.symbol, a.open_us""")
def first_hit_360(spark, d):
    """The benchmark's longest horizon, over blocks of rows with a halo."""
    rows = segs(spark, d).withColumns({"top": F.col("close") * 6, "floor": F.col("close") * 0.05})
    return L.first_hit_steps(rows, 360, "top", "floor").select("symbol", "open_us", "up_step", "low_step")


_EXITS = f"""with {SEGMENTS}, s0 as (select *, row_number() over w as k, close / lag(close) over w - 1 as ret from segs window w as (partition by symbol, segment order by open_us)),
s1 as (select *, case when count(ret) over v >= 30 then sqrt(avg(ret * ret) over v) end as sigma, lead(open) over w as entry from s0 window w as (partition by symbol, segment order by open_us), v as (partition by symbol, segment order by open_us rows between 59 preceding and current row)),
g as (select h, u, l, h_i * 2 + u_i as barrier_index from (values (30, 0), (120, 1), (360, 2)) as a(h, h_i), (values (2, 1, 0), (3, 2, 1)) as b(u, l, u_i)),
e as (select a.symbol, a.segment, a.open_us, g.barrier_index, g.h, a.sigma, max(b.k - a.k) = g.h as whole, min(b.k - a.k) filter (where b.high >= a.entry * (1 + g.u * a.sigma)) as up, min(b.k - a.k) filter (where b.low <= a.entry * (1 - g.l * a.sigma)) as low
  from s1 a cross join g left join s1 b on a.symbol = b.symbol and a.segment = b.segment and b.k > a.k and b.k <= a.k + g.h group by a.symbol, a.segment, a.open_us, a.sigma, a.entry, g.barrier_index, g.h, g.u, g.l),
x as (select barrier_index, case when sigma is null then 'no_volatility' when sigma = 0 then 'zero_volatility' when not coalesce(whole, false) then 'incomplete_horizon' when low <= coalesce(up, h + 1) then 'lower_barrier' when up is not null then 'upper_barrier' else 'expiry' end as exit from e)"""


@query("a04_default_barriers", _EXITS + " select barrier_index, exit, count(*) as n from x group by all")
def default_barriers(spark, d):
    """Exits of the six default barriers: horizons 30, 120 and 360, with 60 returns of volatility."""
    rows = L.causal_sigma(segs(spark, d), 60, 30).withColumn("eligible", F.lit(True))
    return L.barrier_table(rows).groupBy("barrier_index", "exit").agg(F.count("*").alias("n"))


@query("t03_top_shifts", "with x as (select label < 5 as ref, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as f from embeddings), s as (select f, count(*) filter (where ref) as nr, count(*) filter (where not ref) as nc from x group by f), c as (select f, v, sum(ref::int) over (partition by f order by v range between unbounded preceding and current row) as r, sum((not ref)::int) over (partition by f order by v range between unbounded preceding and current row) as c from x), k as (select f, max(abs(r / nr - c / nc)) as cdf_distance from c join s using (f) group by f) select f::bigint as feature, round(cdf_distance, 6) as cdf_distance from k order by k.cdf_distance desc, f limit 10")
def top_shifts(spark, d):
    rows = read(spark, d, "embeddings").select((F.col("label") < 5).alias("ref"), F.posexplode("embedding").alias("pos", "v")).select("ref", (F.col("pos") + 1).cast("long").alias("feature"), F.col("v").cast("double").alias("v"))
    return E.top_shifts(E.distribution_shift(rows, "feature", "v", "ref"), "feature").select("feature", F.round("cdf_distance", 6).alias("cdf_distance"))


@query("j04_ready_origins", f"with {BARS}, v as (select *, turnover < 60 as valid from bars), a as (select *, case when open_us - lag(open_us) over w = 3600000000 and lag(valid) over w and valid then 0 else 1 end as f from v window w as (partition by symbol order by open_us)), b as (select *, sum(f) over (partition by symbol order by open_us) as s from a), c as (select *, row_number() over (partition by symbol, s order by open_us) as n from b) select symbol, open_us + 3600000000 as decision_us from c where valid and n >= 3 and trades % 2 = 0")
def ready_origins(spark, d):
    b = bars(spark, d).withColumn("valid", F.col("turnover") < 60)
    origins = b.where("trades % 2 = 0").select("symbol", (F.col("open_us") + HOUR).alias("decision_us"))
    return J.ready_origins(origins, b, HOUR, 3)


@query("j11_matched_archives", "select o_orderkey, case when o_custkey % 3 = 0 then 'missing' when o_custkey % 5 = 0 then 'mismatch' else 'verified' end as state from orders")
def matched_archives(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("checksum"))
    m = o.where("o_custkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, "other").otherwise(F.col("checksum")).alias("checksum"))
    return J.matched_archives(o, m, ["o_orderkey"], "checksum").select("o_orderkey", "state")


@query("a10_coverage", f"with {TICKS}, q as (select symbol, strftime(make_timestamp(us), '%Y-%m') as month, us // {DAY} as day, user_id from ticks) select symbol, count(distinct day) as days, sum(user_id)::bigint as missing, array_to_string(list_sort(list(distinct month)), ',') as months from q group by symbol")
def coverage(spark, d):
    q = ticks(spark, d).withColumns({"month": F.date_format(F.timestamp_micros("us"), "yyyy-MM"), "day": F.expr(f"us div {DAY}")})
    m = q.groupBy("symbol", "month", "user_id").agg(F.collect_set("day").alias("days"), F.sum("user_id").alias("missing"))
    return J.symbol_coverage(m).withColumn("months", F.array_join("months", ","))


@query("p14_refusing_request", "select n_nationkey, n_name from nation where n_nationkey in (1, 3, 5)")
def refusing_request(spark, d):
    return J.requested(read(spark, d, "nation"), spark.createDataFrame([(1,), (3,), (5,)], "n_nationkey int"), "n_nationkey").select("n_nationkey", "n_name")


@query("p15_exclusions", "select o_custkey, o_orderkey from orders where not (o_custkey = (select min(o_custkey) from orders) or o_custkey = (select max(o_custkey) from orders))")
def exclusions(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    ends = o.agg(F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b")).select(F.explode(F.array("a", "b")).alias("o_custkey")).distinct()
    return J.excluded(o, ends, ["o_custkey"])


@query("p17_complete_grid", f"with {BARS}, l as (select symbol, open_us - lag(open_us) over (partition by symbol order by open_us) as step from bars) select symbol, count(*) filter (where step <> 3600000000) as breaks, count(*) filter (where step <> 3600000000) = 0 as complete from l group by symbol")
def complete_grid(spark, d):
    return B.grid_breaks(bars(spark, d), HOUR)


@query("p19_latest", f"with {BARS} select symbol, max(open_us) as latest_us, max(open_us) = (select max(open_us) from bars) as fresh from bars group by symbol")
def latest(spark, d):
    b = bars(spark, d)
    newest = b.agg(F.max("open_us")).first()[0]
    return B.latest(b, newest)


@query("p21_complete_rows", f"with {BARS} select symbol, open_us, close from bars where close is not null and close >= 1 and turnover >= 2")
def complete_rows(spark, d):
    b = bars(spark, d).withColumns({"close": F.when(F.col("close") >= 1, F.col("close")), "turnover": F.when(F.col("turnover") >= 2, F.col("turnover"))})
    return B.complete_rows(b, ["close", "turnover"], ["symbol", "open_us"]).select("symbol", "open_us", "close")


@query("m12_design", f"with {TICKS} select event_id, round(value, 6) as s1, round((greatest(value - 2, 0) ** 3 - greatest(value - 30, 0) ** 3) / 28 - (greatest(value - 12, 0) ** 3 - greatest(value - 30, 0) ** 3) / 18, 3) as s2, round((greatest(value - 6, 0) ** 3 - greatest(value - 30, 0) ** 3) / 24 - (greatest(value - 12, 0) ** 3 - greatest(value - 30, 0) ** 3) / 18, 3) as s3, round(sin(us % 86400000000 / 86400000000 * 2 * pi()), 6) as h1, round(cos(us % 86400000000 / 86400000000 * 2 * pi()), 6) as h2, round(sin(us % 86400000000 / 86400000000 * 4 * pi()), 6) as h3, round(cos(us % 86400000000 / 86400000000 * 4 * pi()), 6) as h4 from ticks")
def design(spark, d):
    t = ticks(spark, d)
    spline = E.spline_basis(F.col("value"), [2, 6, 12, 30])
    wave = E.harmonics(F.col("us"), DAY, 2)
    return t.select("event_id", *[F.round(c, 6 if i == 0 else 3).alias(f"s{i + 1}") for i, c in enumerate(spline)], *[F.round(c, 6).alias(f"h{i + 1}") for i, c in enumerate(wave)])


@query("u01_concat", "select 0 as part, c_custkey as k from customer union all select 1, s_suppkey from supplier")
def concat(spark, d):
    """Vertical concatenation; `part` keeps the order of the frames."""
    a, b = read(spark, d, "customer").select(F.lit(0).alias("part"), F.col("c_custkey").alias("k")), read(spark, d, "supplier").select(F.lit(1).alias("part"), F.col("s_suppkey").alias("k"))
    return a.union(b)


@query("u06_distinct_in_order", f"with {TICKS}, f as (select user_id, symbol, min(us) as first_us from ticks group by all) select user_id, string_agg(symbol, ',' order by first_us) as symbols from f group by user_id")
def distinct_in_order(spark, d):
    first = ticks(spark, d).groupBy("user_id", "symbol").agg(F.min("us").alias("us"))  # pre-aggregated: a symbol once
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "symbol"))), lambda x: x["symbol"]), ",").alias("symbols"))


@query("t08_canonical_order", f"with {BARS} select row_number() over (order by symbol, open_us) as place, symbol, open_us from bars")
def canonical_order(spark, d):
    """Place of each bar by symbol and time: starts of symbols from counts, places inside a symbol and day."""
    b = bars(spark, d)
    of_symbol = b.groupBy("symbol").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window as W

    start = of_symbol.select("symbol", F.coalesce(F.sum("_n").over(W.orderBy("symbol").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    inside = F.row_number().over(W.partitionBy("symbol").orderBy("open_us"))
    return b.withColumn("_k", inside).join(start, "symbol").select((F.col("_s") + F.col("_k")).cast("long").alias("place"), "symbol", "open_us")
