"""Gaps and islands: contiguous segments, day intervals, episodes, clusters, greedy spacing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def segments(rows: DataFrame, step: int, key: str = "symbol", order: str = "open_us", out: str = "segment") -> DataFrame:
    """Numbers runs of rows exactly `step` apart."""
    by = W.partitionBy(key).orderBy(order)
    fresh = F.when(F.col(order) - F.lag(order).over(by) == step, 0).otherwise(1)
    return rows.withColumn("_fresh", fresh).withColumn(out, F.sum("_fresh").over(by)).drop("_fresh")


def day_intervals(days: DataFrame, key: str, day: str) -> DataFrame:
    """Distinct days (as numbers) to inclusive intervals."""
    one = days.select(key, day).distinct()
    at = one.withColumn("_g", F.col(day) - F.row_number().over(W.partitionBy(key).orderBy(day)))
    return at.groupBy(key, "_g").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_days")).drop("_g")


def episodes(rows: DataFrame, key: list[str], start: str, end: str, out: str = "episode") -> DataFrame:
    """A new episode begins where a start is after every earlier end. Exact if end >= start."""
    by = W.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_n", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    return rows.withColumn(out, F.sum("_n").over(by)).drop("_n")


def greedy_spacing(rows: DataFrame, key: str, order: str, horizon: int) -> DataFrame:
    """Keeps a row if it is more than horizon after the last kept one of its key. Keys are dealt and sorted by Spark; the
    fold passes each task's rows once and remembers one time, so a key of any length needs no memory."""
    schema = rows.schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = None, None
        for batch in batches:
            keep = []
            for k, t in zip(batch[key], batch[order]):
                fits = k != own or t > last + horizon
                same = k == own and t == last  # rows of one time share its fate
                if fits:
                    own, last = k, t
                keep.append(fits or same)
            yield batch[keep]

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).sortWithinPartitions(key, order).mapInPandas(fold, schema)


def positions(rows: DataFrame, order: str, bucket: int, out: str = "position") -> DataFrame:
    """Number of each row in the order of a time, from 0, ties in any order. Counts by bucket of time (a small row each)
    give every bucket its start; rows are sorted inside their bucket only."""
    d = rows.withColumn("_b", F.expr(f"{order} div {bucket}"))
    counts = d.groupBy("_b").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_b", start.alias("_start"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy(order)) - 1
    return d.withColumn("_in", inside).join(starts, "_b").withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop("_b", "_in", "_start")


def purged_folds(times: DataFrame, order: str, folds: int, holdout_num: int, holdout_den: int, horizon: int, bucket: int = 86_400_000_000) -> DataFrame:
    """Chronological split: the last ceil(n*num/den) times are the holdout, the rest `folds` runs with bounds i*n//folds;
    rows whose horizon reaches a later part are purged."""
    n = times.count()
    hold = -(-n * holdout_num // holdout_den)
    used = n - hold
    bounds = [i * used // folds for i in range(folds + 1)] + [n]
    ranked = positions(times, order, bucket)
    fold = F.lit(0)
    for b in bounds[1:-1]:
        fold = fold + (F.col("position") >= b).cast("int")
    placed = ranked.withColumn("fold", fold)
    first = placed.groupBy("fold").agg(F.min(order).alias("_s")).select((F.col("fold") - 1).alias("fold"), F.col("_s").alias("next_start"))
    out = placed.join(F.broadcast(first), "fold", "left")  # folds + 1 rows
    return out.withColumn("purged", F.coalesce(F.col(order) + horizon >= F.col("next_start"), F.lit(False))).drop("next_start")


def subgrid(rows: DataFrame, order: str, longest: int, step: int) -> DataFrame:
    """Rows on the fixed UTC grid of (longest // step + 1) steps: windows of `longest` from them do not overlap."""
    return rows.where(F.pmod(F.col(order), F.lit((longest // step + 1) * step)) == 0)


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
