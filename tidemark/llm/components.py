"""Connected components by minimum labels with pointer jumping, as joins over edges and labels.

Defined cases: an empty edge table gives an empty result; self-loops and repeated edges do no harm; edges with a null
end are no edges; ties cannot be, labels are ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, comp (the least id reachable) of every id that an edge names.

    Labels and edges are partitioned by id; minima are pre-aggregated, so a hub costs its edges once a round. Each
    round's labels are a table and the round before it is deleted. Labels only fall, so the rounds end; jumping to a
    label's label makes their number logarithmic in the longest path.
    """
    one = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = stored(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stored(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["v"]).groupBy("x").agg(F.min("comp").alias("m"))
        lower = labels.join(near, labels["v"] == near["x"]).select("v", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        far = labels.select(F.col("v").alias("w"), F.col("comp").alias("jump"))
        moved = stored(lower.join(far, lower["comp"] == far["w"]).select("v", "old", F.least("comp", "jump").alias("comp")), "labels")
        discard(labels)
        labels = moved
        if not moved.where("old <> comp").count():
            discard(both)
            out = labels.select("v", "comp")
            out.stored_at = labels.stored_at
            return out
