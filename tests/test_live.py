"""Streaming forms give the batch answers, however the input is split into micro-batches."""

import json

import pytest

from tidemark.operators import replay as R
from tidemark.streaming import live


def streamed(spark, tmp_path, rows, schema, cuts, build, name, mode="append"):
    """rows written as one file a part, read one file a micro-batch."""
    names = [f.split()[0] for f in schema.split(", ")]
    source = tmp_path / f"{name}-in"
    source.mkdir()
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        file = source / f"{i}.json"
        file.write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows[a:b]))
        __import__("os").utime(file, (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(x) for x in spark.table(name).collect()]


FRAMES = [("A", 10, 5, 1), ("A", 11, 6, 2), ("A", 12, 8, 3), ("A", 11, 6, 4), ("A", 13, 7, 5), ("A", 14, 8, 6), ("A", 12, 9, 7), ("A", 15, 9, 8)]


@pytest.mark.parametrize("cuts", [(0, 8), (0, 3, 5, 8)])
def test_admission(spark, tmp_path, cuts):
    got = streamed(spark, tmp_path, FRAMES, "symbol string, event_id long, sequence long, arrival long", cuts, live.admit, f"admit{len(cuts)}")
    want = [("A", 10, 5, "FIRST"), ("A", 11, 6, "VALID"), ("A", 12, 8, "GAP"), ("A", 11, 6, "DUPLICATE"), ("A", 13, 7, "REGRESSION"), ("A", 14, 8, "CONFLICT"), ("A", 12, 9, "CONFLICT"), ("A", 15, 9, "VALID")]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("cuts", [(0, 40), (0, 7, 22, 40)])
def test_replay_stream_equals_batch(spark, tmp_path, cuts):
    rows = [("s", i, f"e{(i * 5) % 17}", i - (i * 7) % 9, i, f"d{(i // 17) % 2 if i % 3 else 0}") for i in range(40)]
    schema = "stream string, row long, identity string, event_time long, arrival long, digest string"
    got = {(x[1], x[4], x[5]) for x in streamed(spark, tmp_path, rows, schema, cuts, lambda s: live.replay(s, 3), f"replay{len(cuts)}")}
    df = spark.createDataFrame(rows, schema)
    batch = {(x["row"], x["state"], x["authoritative"]) for x in R.replay(df, "stream", "identity", "event_time", "arrival", "digest", "row", 3).collect()}
    told = {r for r, _, _ in got}
    assert got == {x for x in batch if x[0] in told} and len(told) == len(got) >= 35


@pytest.mark.parametrize("cuts", [(0, 4), (0, 1, 3, 4)])
def test_gap_counts(spark, tmp_path, cuts):
    rows = [("A", 0), ("A", 60), ("A", 240), ("A", 300)]
    got = streamed(spark, tmp_path, rows, "symbol string, open_us long", cuts, lambda s: live.gap_counts(s, 60), f"gaps{len(cuts)}", "update")
    assert max(got)[2] == 2
