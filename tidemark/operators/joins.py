"""Point-in-time and reconciling joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def asof(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row at or before its time (nulls if none).

    Both sides go through one shuffle and one sort as a union; right rows stand first on equal times. No range join,
    no broadcast, so neither side's size matters."""
    r = right.select(*key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("_rt"), *values).alias("_v"))
    names = [c for c in left.columns if c not in key]
    l = left.select(*key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_l"))  # noqa: E741
    by = W.partitionBy(*key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    told = both.withColumn("_v", F.last("_v", ignorenulls=True).over(by)).where("_side = 1")
    return told.select(*key, "_l.*", *[F.col(f"_v.{c}").alias(c) for c in values], F.col("_v._rt").alias("asof_time"))


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join that refuses repeated keys and keys of one side only, within the plan of the join itself."""
    l = left.withColumn("_n", F.count("*").over(W.partitionBy(*key))).withColumn("_in_l", F.lit(True))  # noqa: E741
    r = right.withColumn("_m", F.count("*").over(W.partitionBy(*key))).withColumn("_in_r", F.lit(True))
    joined = l.join(r, key, "full")
    fine = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull() & (F.col("_n") == 1) & (F.col("_m") == 1)
    checked = joined.where(F.when(fine, True).otherwise(F.raise_error(F.lit("keys are not one to one")).cast("boolean")))
    return checked.drop("_n", "_m", "_in_l", "_in_r")


def in_interval(points: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, step: int) -> DataFrame:
    """Points inside [start, end] of a span of their key: equi-join on time buckets that a span covers, then the range."""
    p = points.withColumn("_b", F.expr(f"{time} div {step}"))
    s = spans.withColumn("_b", F.explode(F.expr(f"sequence({start} div {step}, {end} div {step})")))
    return p.join(s, [key, "_b"]).where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_b")


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of edges strictly below the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value))


def classify_revisions(rows: DataFrame, identity: list[str], digest: str, order: str) -> DataFrame:
    """FIRST, DUPLICATE (same digest as the first) or CONFLICT of each observation, in order."""
    by = W.partitionBy(*identity).orderBy(order)
    first = F.first(digest).over(by.rowsBetween(W.unboundedPreceding, 0))
    seen = F.row_number().over(by)
    return rows.withColumn("observation", F.when(seen == 1, "FIRST").when(F.col(digest) == first, "DUPLICATE").otherwise("CONFLICT"))


def canonicalize(rows: DataFrame, identity: list[str], digest: str) -> DataFrame:
    """One row an identity: canonical if all digests agree, else every revision is quarantined."""
    found = rows.groupBy(*identity).agg(F.count("*").alias("n_rows"), F.min(digest).alias("_a"), F.max(digest).alias("_b"))
    state = F.when(F.col("_a") != F.col("_b"), "CONFLICT").otherwise("VALID")
    return found.select(*identity, "n_rows", state.alias("state"), F.when(F.col("_a") == F.col("_b"), F.col("n_rows") - 1).otherwise(0).alias("duplicate_rows"), F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias(digest))


def reconcile(predictions: DataFrame, futures: DataFrame, as_of_us: int, horizon_us: int, quantile: float) -> DataFrame:
    """predictions: symbol, decision_us, state, value, origin (a digest of the last bar). futures: symbol, state, source
    (null: none), future_us (its own decision), origin (its digest of the same bar), bars, wanted (bars that it has and
    should have), realized (null if unknown), broken (its read failed). One of nine states, in the order of the ladder,
    with pinball loss where observed."""
    f = futures.select("symbol", F.struct("state", "source", "future_us", "origin", "bars", "wanted", "realized", "broken").alias("_f"))
    d = predictions.join(f, "symbol", "left")
    x = F.col
    bad = x("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    state = (
        F.when(x("state") == "conflict", "conflict").when(x("state") != "success", "unscored").when(bad, "invalid_prediction")
        .when(F.lit(as_of_us) < x("decision_us") + horizon_us, "pending").when(x("_f.state") == "conflict", "conflict")
        .when(x("_f.source").isNull(), "missing_source").when(x("_f.future_us") > as_of_us, "source_after_as_of")
        .when(x("_f.broken"), "invalid_source").when(x("_f.bars") != x("_f.wanted"), "incomplete_horizon")
        .when(x("_f.origin") != x("origin"), "conflict").when(x("_f.realized").isNull() | F.isnan("_f.realized"), "incomplete_horizon").otherwise("observed")
    )
    error = x("_f.realized") - x("value")
    d = d.withColumn("outcome", state)
    seen = x("outcome") == "observed"
    return d.select("symbol", "decision_us", "outcome", F.when(seen, F.greatest(quantile * error, (quantile - 1) * error)).alias("loss"), F.when(seen, x("_f.realized") <= x("value")).alias("below"))


def ready_origins(origins: DataFrame, bars: DataFrame, step: int, history: int, key: str = "symbol") -> DataFrame:
    """Origins (key, decision_us) whose last completed bar exists, is valid and ends a run of `history` valid bars."""
    by = W.partitionBy(key).orderBy("open_us")
    near = (F.col("open_us") - F.lag("open_us").over(by) == step) & F.lag("valid").over(by) & F.col("valid")
    d = bars.withColumn("_s", F.sum(F.when(near, 0).otherwise(1)).over(by)).withColumn("_n", F.row_number().over(W.partitionBy(key, "_s").orderBy("open_us")))
    ready = d.where(F.col("valid") & (F.col("_n") >= history)).select(key, (F.col("open_us") + step).alias("decision_us"))
    return origins.join(ready, [key, "decision_us"], "left_semi")


def matched_archives(probes: DataFrame, manifests: DataFrame, key: list[str], checksum: str) -> DataFrame:
    """probes with state: missing (no manifest), mismatch (another checksum) or verified."""
    m = manifests.select(*key, F.col(checksum).alias("_c"))
    state = F.when(F.col("_c").isNull(), "missing").when(F.col("_c") != F.col(checksum), "mismatch").otherwise("verified")
    return probes.join(m, key, "left").withColumn("state", state).drop("_c")


def requested(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys; a key asked for twice, or unknown, is refused in the plan."""
    counted = wanted.groupBy(key).agg(F.count("*").alias("_asked"))
    found = counted.join(rows.withColumn("_known", F.lit(True)), key, "left")
    fine = F.when((F.col("_asked") == 1) & F.col("_known"), True).otherwise(F.raise_error(F.lit("a key is asked for twice or unknown")).cast("boolean"))
    return found.where(fine).drop("_asked", "_known")


def excluded(rows: DataFrame, exclusions: DataFrame, key: list[str]) -> DataFrame:
    """Rows without the declared exclusions, each of which must exist."""
    known = rows.select(*key).distinct().withColumn("_known", F.lit(True))
    checked = exclusions.join(known, key, "left").where(F.when(F.col("_known"), True).otherwise(F.raise_error(F.lit("an exclusion names nothing")).cast("boolean")))
    return rows.join(checked.select(*key), key, "left_anti")


def symbol_coverage(manifests: DataFrame) -> DataFrame:
    """manifests: symbol, month, days (array), missing. One row a symbol: distinct days, missing bars, months in order."""
    days = manifests.select("symbol", F.explode("days").alias("day")).groupBy("symbol").agg(F.countDistinct("day").alias("days"))
    rest = manifests.groupBy("symbol").agg(F.sum("missing").alias("missing"), F.array_sort(F.collect_set("month")).alias("months"))
    return rest.join(days, "symbol", "left").select("symbol", F.coalesce("days", F.lit(0)).alias("days"), "missing", "months")
