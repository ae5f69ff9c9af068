"""JSON of the exchange: pages of bars, symbols, products, live frames, reports. Typed schemas, unknown fields ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FILTER = "struct<filterType: string, tickSize: string, stepSize: string, minNotional: string>"
EXCHANGE = f"struct<symbols: array<struct<symbol: string, status: string, baseAsset: string, quoteAsset: string, isSpotTradingAllowed: boolean, permissions: array<string>, permissionSets: array<array<string>>, filters: array<{FILTER}>>>>"


def refuse(fine: Column, message: str) -> Column:
    """True where fine; raises in the plan otherwise."""
    return F.when(fine, True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def page_of_bars(pages: DataFrame, step_ms: int = 60_000) -> DataFrame:
    """pages: symbol, page_start (ms), count, payload (an array of arrays). Rows on the exact grid, exactly count of them."""
    rows = F.from_json("payload", "array<array<string>>")
    told = pages.withColumn("_r", rows).where(refuse(F.size("_r") == F.col("count"), "a page has another number of bars"))
    told = told.select("symbol", "page_start", F.posexplode("_r").alias("_i", "_v"))
    at = F.col("_v")[0].cast("long")
    told = told.where(refuse((F.size("_v") >= 11) & (at == F.col("page_start") + F.col("_i") * step_ms), "a page is off the grid"))
    number = lambda i: F.col("_v")[i].cast("decimal(38,18)")
    return told.select("symbol", (at * 1000).alias("open_us"), number(1).alias("open"), number(2).alias("high"), number(3).alias("low"), number(4).alias("close"), number(7).alias("turnover"), F.col("_v")[8].cast("long").alias("trades"), number(10).alias("taker"))


def exchange_symbols(payloads: DataFrame) -> DataFrame:
    """payloads: payload. A row a symbol: tick and step of their filters, permissions flattened and distinct in order;
    names beyond ASCII are unsupported."""
    s = payloads.select(F.explode(F.from_json("payload", EXCHANGE)["symbols"]).alias("s"))
    first = lambda kind, field: F.try_element_at(F.filter("s.filters", lambda f: f["filterType"] == kind), F.lit(1))[field]
    permissions = F.array_distinct(F.concat(F.coalesce("s.permissions", F.array().cast("array<string>")), F.flatten(F.coalesce("s.permissionSets", F.array().cast("array<array<string>>")))))
    return s.select(
        F.col("s.symbol").alias("symbol"), F.col("s.status").alias("status"), F.col("s.baseAsset").alias("base"), F.col("s.quoteAsset").alias("quote"), F.coalesce("s.isSpotTradingAllowed", F.lit(False)).alias("spot_allowed"),
        permissions.alias("permissions"), first("PRICE_FILTER", "tickSize").alias("tick_size"), first("LOT_SIZE", "stepSize").alias("step_size"), F.col("s.symbol").rlike(r"^[\x00-\x7F]+$").alias("supported"),
    )


def universe(symbols: DataFrame, observed: DataFrame | None = None, quote: str = "USDT") -> DataFrame:
    """Trading spot symbols of a quote asset; observed: symbol, of those that must be known already."""
    out = symbols.where((F.col("status") == "TRADING") & (F.col("quote") == quote) & F.array_contains("permissions", "SPOT") & F.col("supported"))
    return out.join(observed.select("symbol").distinct(), "symbol", "left_semi") if observed is not None else out


def alert_universe(symbols: DataFrame, excluded_bases: list[str], quote: str = "USDT") -> DataFrame:
    """Symbols for hourly alerts."""
    return symbols.where((F.col("status") == "TRADING") & (F.col("quote") == quote) & F.col("spot_allowed") & ~F.col("base").isin(excluded_bases) & F.col("symbol").rlike("^[A-Z0-9]{4,30}$"))


def live_frames(frames: DataFrame) -> dict[str, DataFrame]:
    """frames: value (JSON with stream and data). One DataFrame for each kind, told by the stream's suffix."""
    stream = F.get_json_object("value", "$.stream")
    data = F.get_json_object("value", "$.data")
    told = frames.withColumns({"_s": stream, "_d": data})
    # field names differ by case only, which typed structs do not tell apart
    text = lambda path: F.get_json_object("_d", path)
    number = lambda path: text(path).cast("long")
    price = lambda path: text(path).cast("decimal(38,18)")
    flag = lambda path: text(path).cast("boolean")
    return {
        "kline": told.where(F.col("_s").rlike("@kline_[0-9]+[mhd]$")).select(text("$.k.s").alias("symbol"), (number("$.E") * 1000).alias("event_us"), (number("$.k.t") * 1000).alias("open_us"), price("$.k.o").alias("open"), price("$.k.h").alias("high"), price("$.k.l").alias("low"), price("$.k.c").alias("close"), price("$.k.q").alias("turnover"), price("$.k.Q").alias("taker"), number("$.k.n").alias("trades"), flag("$.k.x").alias("closed")),
        "trade": told.where(F.col("_s").endswith("@aggTrade")).select(text("$.s").alias("symbol"), number("$.a").alias("trade_id"), price("$.p").alias("price"), price("$.q").alias("quantity"), number("$.f").alias("first_id"), number("$.l").alias("last_id"), (number("$.T") * 1000).alias("trade_us"), flag("$.m").alias("buyer_is_maker")),
        "book": told.where(F.col("_s").endswith("@bookTicker")).select(text("$.s").alias("symbol"), number("$.u").alias("update_id"), price("$.b").alias("bid"), price("$.B").alias("bid_quantity"), price("$.a").alias("ask"), price("$.A").alias("ask_quantity")),
    }


#: Rules of the event variants; a code is a broken rule.
KLINE_RULES = {
    "high_below_body": "high < greatest(open, close)", "low_above_body": "low > least(open, close)", "taker_exceeds_total": "taker > turnover", "negative": "turnover < 0 or taker < 0 or trades < 0", "not_positive": "low <= 0",
}
TRADE_RULES = {"price_not_positive": "price <= 0", "quantity_not_positive": "quantity <= 0", "id_range": "first_id > last_id"}
BOOK_RULES = {"crossed": "bid >= ask", "price_not_positive": "bid <= 0 or ask <= 0", "negative_quantity": "bid_quantity < 0 or ask_quantity < 0"}
QUALITY_RULES = {"state_unknown": "quality_state is null", "complete_but_not_valid": "quality_complete and quality_state <> 'valid'", "valid_but_incomplete": "not quality_complete and quality_state = 'valid'", "bad_code": "exists(diagnostics, c -> not c rlike '^[a-z][a-z0-9_]*$')"}


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("quality_complete and quality_state = 'valid'")


def trade_gaps(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """Trades with id_gap (aggregate ids skipped since the one before) and range_gap (trade ids skipped)."""
    from pyspark.sql import Window as W

    by = W.partitionBy(key).orderBy("trade_id")
    return trades.withColumns({"id_gap": F.greatest(F.lit(0), F.col("trade_id") - F.lag("trade_id").over(by) - 1), "range_gap": F.greatest(F.lit(0), F.col("first_id") - F.lag("last_id").over(by) - 1)})


def scan_report(reports: DataFrame) -> DataFrame:
    """reports: payload with decision_us and rows (symbol, state, value). One row a symbol and report: rows that repeat
    one symbol alike fold, rows that differ are a conflict."""
    schema = "struct<model_id: string, decision_us: bigint, rows: array<struct<symbol: string, state: string, value: double>>>"
    r = reports.select(F.from_json("payload", schema).alias("r")).select("r.model_id", "r.decision_us", F.explode("r.rows").alias("x"))
    told = r.groupBy("model_id", "decision_us", F.col("x.symbol").alias("symbol")).agg(F.countDistinct(F.struct("x.state", F.coalesce("x.value", F.lit(float("nan"))))).alias("n"), F.min("x.state").alias("state"), F.min("x.value").alias("value"))
    return told.select("model_id", "decision_us", "symbol", F.when(F.col("n") > 1, "conflict").otherwise(F.col("state")).alias("state"), F.when(F.col("n") == 1, F.col("value")).alias("value"))
