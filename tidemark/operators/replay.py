"""Event-time replay under a processing-clock watermark, as a batch plan; and its faults.

Rows of one stream are numbered in arrival order. The watermark after a row is arrival - lateness; a row is late if its
event time is at or under the watermark before it. The first row of an identity waits until the watermark reaches its
event time and is then authoritative, unless a row of its identity with another digest comes first: then both are
conflicts. Later rows of an identity are duplicates or conflicts. All of it is window arithmetic over the stream key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def replay(rows: DataFrame, stream: str, identity: str, event: str, arrival: str, digest: str, order: str, lateness: int) -> DataFrame:
    """rows with state (VALID, LATE, DUPLICATE, CONFLICT) and authoritative."""
    by = W.partitionBy(stream).orderBy(arrival, order)
    one = W.partitionBy(stream, identity).orderBy(arrival, order)
    d = rows.withColumn("_i", F.row_number().over(by)).withColumn("_wa", F.greatest(F.lit(-1), F.col(arrival) - lateness))
    d = d.withColumn("_wb", F.coalesce(F.lag("_wa").over(by), F.lit(-1)))
    d = d.withColumn("_first", F.first(digest).over(one.rowsBetween(W.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(one))
    other = F.when(F.col(digest) != F.col("_first"), F.col("_i"))
    d = d.withColumn("_c", F.min(other).over(W.partitionBy(stream, identity)))
    # row after which the watermark has reached the event time: arrivals ascend, so it is the first arrival that does
    marks = W.partitionBy(stream).orderBy("_at", "_side", F.col("_i").desc())
    reach = d.select(stream, F.col("_wa").alias("_at"), F.lit(1).alias("_side"), F.col("_i"), F.lit(None).cast("int").alias("_q"))
    asks = d.select(stream, F.col(event).alias("_at"), F.lit(0).alias("_side"), F.col("_i"), F.col("_i").alias("_q"))
    ahead = F.min(F.when(F.col("_side") == 1, F.col("_i"))).over(marks.rowsBetween(0, W.unboundedFollowing))
    due = reach.unionByName(asks).withColumn("_due", ahead).where("_side = 0").select(stream, F.col("_q").alias("_i"), "_due")
    d = d.join(due, [stream, "_i"]).withColumn("_e", F.greatest("_i", F.coalesce("_due", F.lit(2**31 - 1))))
    state = (
        F.when((F.col("_k") > 1) & (F.col("_c") <= F.col("_i")), "CONFLICT")
        .when(F.col("_k") > 1, "DUPLICATE")
        .when(F.col(event) <= F.col("_wb"), "LATE")
        .when(F.col("_c") <= F.col("_e"), "CONFLICT")
        .otherwise("VALID")
    )
    return d.withColumn("state", state).withColumn("authoritative", F.col("state") == "VALID").drop("_i", "_wa", "_wb", "_first", "_k", "_c", "_due", "_e")


def inject(rows: DataFrame, stream: str, arrival: str, order: str, faults: DataFrame) -> DataFrame:
    """Marks rows by the faults (kind, first_index, n) of their arrival index: GAP, DISCONNECT, DUPLICATE or none."""
    by = W.partitionBy(stream).orderBy(arrival, order)
    d = rows.withColumn("index", F.row_number().over(by) - 1)
    spans = faults.select(F.col("kind").alias("fault"), F.explode(F.expr("sequence(first_index, first_index + n - 1)")).alias("index"))
    return d.join(F.broadcast(spans), "index", "left")  # as many rows as the harness names


def replay_with_faults(rows: DataFrame, faults: DataFrame, stream: str, identity: str, event: str, arrival: str, digest: str, order: str, lateness: int) -> DataFrame:
    """replay() under faults. GAP and DISCONNECT rows are not observed (state is the fault) but their arrivals still move
    the watermark; DUPLICATE rows are observed twice in a row (copy 0 and 1)."""
    marked = inject(rows, stream, arrival, order, faults)
    lost = F.coalesce(F.col("fault").isin("GAP", "DISCONNECT"), F.lit(False))
    copies = F.when(F.col("fault") == "DUPLICATE", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = marked.withColumn("copy", F.explode(copies)).withColumn("_lost", lost)
    d = d.withColumn("_at", F.struct(F.col(order).alias("o"), F.col("copy").alias("c")))
    # a lost row is an identity of its own, so that it judges nobody
    d = d.withColumn("_own", F.when(F.col("_lost"), F.concat(F.lit("lost:"), F.col("index").cast("string"))).otherwise(F.concat(F.lit("seen:"), F.col(identity).cast("string"))))
    out = replay(d, stream, "_own", event, arrival, digest, "_at", lateness)
    state = F.when(F.col("_lost"), F.col("fault")).otherwise(F.col("state"))
    return out.withColumns({"state": state, "authoritative": F.col("authoritative") & ~F.col("_lost")}).drop("_lost", "_at", "_own")


def replay_partition(rows: DataFrame, stream: str, identity: str, event: str, digest: str, order: str, lateness: int = 0) -> DataFrame:
    """Replay of a canonical partition: every row arrives at its event time."""
    return replay(rows.withColumn("_arrival", F.col(event)), stream, identity, event, "_arrival", digest, order, lateness).drop("_arrival")


def event_time(kind: str, times: dict[str, str]):
    """Event time of each variant: times maps a kind to the column that holds it."""
    out = None
    for k, c in times.items():
        out = F.when(F.col(kind) == k, F.col(c)) if out is None else out.when(F.col(kind) == k, F.col(c))
    return out
