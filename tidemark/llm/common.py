"""Helpers shared by the text operators: tables, lineage cuts, ranks that no single task has to hold."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Words are runs of anything but ASCII white space; this is the contract's pattern.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, and only where that is unset one of our own."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not told:
        told = sc.getCheckpointDir()
    if not told:
        local = sc.master.startswith("local")
        told = f"file://{tempfile.gettempdir()}/tidemark-checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir")
    return told.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read back. Lineage ends there: lost executors cost
    no recomputation before it, and unlike checkpoint() the plan runs once, not twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """stored() without a name."""
    return stored(df, "cut")


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote. Only for tables that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fitted(rows: DataFrame, fit: Callable[[pd.DataFrame], object]) -> bytes:
    """fit(rows) pickled, computed in one executor task: only for rows of a stated bound. Neither the rows nor the
    fitting weigh on the driver, and a lost executor costs one task."""
    names = rows.columns

    def run(batches):
        parts = list(batches)
        yield pd.DataFrame({"model": [pickle.dumps(fit(pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)))]})

    got = rows.repartition(1).mapInPandas(run, "model binary").collect()  # one row
    return bytes(got[0][0]) if got else pickle.dumps(fit(pd.DataFrame(columns=names)))


def hot_keys(counts: DataFrame, n: str, n_rows: int, least: int = 1000, most: int = 10_000) -> DataFrame:
    """Rows of counts with at least max(least, n_rows / most) in column n: never more than `most` of them, so their
    table can be sent to every task."""
    return counts.where(F.col(n) >= max(least, -(-n_rows // most)))


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, values: list[str], hot: DataFrame, spread: Column) -> DataFrame:
    """rows left join keyed (one row a key, not null) on `key`, adding `values`. Keys of `hot` (see hot_keys) are
    looked up in a broadcast table; their rows, and those whose key is null, are dealt by `spread`, so no key holds one
    task up."""
    held = keyed.join(F.broadcast(hot.select(key)), key, "left_semi").select(F.col(key).alias("_hk"), F.struct(F.lit(True).alias("is"), *values).alias("_hv"))
    cold = keyed.select(F.col(key).alias("_ck"), F.struct(*values).alias("_cv"))
    d = rows.join(F.broadcast(held), F.col(key) == F.col("_hk"), "left")
    d = d.withColumn("_jk", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), spread).otherwise(F.col(key)))
    d = d.join(cold, F.col("_jk") == F.col("_ck"), "left")
    return d.withColumns({v: F.when(F.col("_hv.is"), F.col(f"_hv.{v}")).when(F.col("_ck") == F.col(key), F.col(f"_cv.{v}")) for v in values}).drop("_hk", "_hv", "_ck", "_cv", "_jk")


def hex_digits(n_rows: int, rows_per_bucket: int = 2048) -> int:
    """Leading hex digits of a uniform key that deal n_rows into buckets of about rows_per_bucket rows."""
    digits = 1
    while digits < 7 and n_rows > rows_per_bucket * 16**digits:
        digits += 1
    return digits


def order_key(*parts: Column) -> Column:
    """40 hex digits that order rows: 28 from the first part, 12 from the others, which tell rows of equal first part
    apart."""
    rest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts[1:]]))
    return F.concat(F.substring(parts[0], 1, 28), F.substring(rest, 1, 12))


def running_total(df: DataFrame, by: list[str], key: str, size: str, out: str, n_rows: int) -> DataFrame:
    """Adds `out`: the sum of `size` over the rows of the same `by` whose `key` (see order_key) is less.

    The plain form is a window by `by` alone, which puts a hot group into one task. Here the leading digits of the
    key split each group into buckets; sums by bucket (one small row each) give every bucket its start, and windows
    run inside a bucket only. A bucket that repeated keys fill is split again by the last digits; at most 5000 buckets
    can be that full, so their list goes to every task. Rows with equal keys are ordered by whatever the engine meets
    first.
    """
    digits = hex_digits(n_rows)
    df = df.withColumn("_b", F.substring(key, 1, digits))
    full = df.groupBy("_b").agg(F.count("*").alias("_n")).where(F.col("_n") > max(16 * 2048, -(-n_rows // 5000))).select(F.col("_b").alias("_fb"))
    df = df.join(F.broadcast(full), F.col("_b") == F.col("_fb"), "left")
    df = df.withColumn("_b", F.when(F.col("_fb").isNull(), F.col("_b")).otherwise(F.concat(F.substring(key, 1, 28), F.substring(key, 29, digits)))).drop("_fb")
    sums = df.groupBy(*by, "_b").agg(F.sum(size).alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_kb"), start.alias("_start"))
    same = F.col("_b") == F.col("_kb")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = F.coalesce(F.sum(size).over(W.partitionBy(*by, "_b").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = df.withColumn("_in", inside).join(starts, same)
    return told.withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop("_b", "_kb", "_start", "_in", *[f"_k_{c}" for c in by])
