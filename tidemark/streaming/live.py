"""Structured Streaming forms: daily windows, deduplication under a watermark, stateful admission and replay."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(stream: DataFrame, time: str, grace: str = "10 minutes", *by: str) -> DataFrame:
    """Tumbling UTC days by receipt time; a day is final once the watermark has left it by `grace`."""
    day = F.window(time, "1 day")
    return stream.withWatermark(time, grace).groupBy(day, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), *by, "n")


def first_of(stream: DataFrame, identity: list[str], time: str, grace: str = "10 minutes") -> DataFrame:
    """One row an identity within the grace."""
    return stream.withWatermark(time, grace).dropDuplicatesWithinWatermark(identity)


ADMISSION = "symbol string, event_id long, sequence long, state string"


def admit(stream: DataFrame, keep: int = 100_000) -> DataFrame:
    """Per symbol, in order of arrival: FIRST, GAP (a sequence number was skipped), DUPLICATE (an id seen before, same
    sequence), CONFLICT (a sequence seen with another id, or an id with another sequence), REGRESSION, VALID.

    stream: symbol, event_id, sequence, arrival (a number that orders arrivals within a micro-batch; earlier
    micro-batches arrived before; without it the sequence orders a micro-batch, which hides regressions inside it). The state is the last sequence and the last `keep` ids with their sequences, oldest
    out first, so it is bounded and the answer does not depend on how the input is split into micro-batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ids, sequences = state.get if state.exists else (None, [], [])
        seen = dict(zip(ids, sequences))
        by_sequence = {s: i for i, s in seen.items()}
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows.sort_values(["arrival" if "arrival" in rows else "sequence", "event_id"], kind="stable")
        out = []
        for i, s in zip(rows["event_id"].tolist(), rows["sequence"].tolist()):
            if i in seen:
                kind = "DUPLICATE" if seen[i] == s else "CONFLICT"
            elif s in by_sequence:
                kind = "CONFLICT"
            elif last is None:
                kind = "FIRST"
            elif s < last:
                kind = "REGRESSION"
            else:
                kind = "VALID" if s == last + 1 else "GAP"
            if i not in seen:
                seen[i] = s
                by_sequence.setdefault(s, i)
                if len(seen) > keep:
                    old = next(iter(seen))
                    if by_sequence.get(seen[old]) == old:
                        del by_sequence[seen[old]]
                    del seen[old]
            if kind in ("FIRST", "VALID", "GAP"):
                last = s
            out.append((key[0], i, s, kind))
        state.update((last, list(seen), list(seen.values())))
        yield pd.DataFrame(out, columns=["symbol", "event_id", "sequence", "state"])

    return stream.groupBy("symbol").applyInPandasWithState(step, ADMISSION, "last long, ids array<long>, sequences array<long>", "append", GroupStateTimeout.NoTimeout)


REPLAYED = "stream string, row long, identity string, event_time long, state string, authoritative boolean"


def replay(stream: DataFrame, lateness: int) -> DataFrame:
    """Event-time replay of streams under a processing-clock watermark (arrival - lateness); the batch twin is
    operators.replay. stream: stream, row, identity, event_time, arrival, digest; rows of a stream arrive in order of
    arrival and row. A row is told when its fate is known: late, duplicate and conflicting rows at once, a first row when
    the watermark reaches its event time or a conflict comes first. Waiting rows are the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, ids, firsts, rows_, times, flags = state.get if state.exists else (-1, [], [], [], [], [])
        known = {i: [d, r, t, f] for i, d, r, t, f in zip(ids, firsts, rows_, times, flags)}  # flag: 0 waits, 1 told, 2 conflicting
        waiting = [(c[2], i) for i, c in known.items() if c[3] == 0]
        heapq.heapify(waiting)
        out = []
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["arrival", "row"], kind="stable")
        for r, i, t, a, d in zip(rows["row"].tolist(), rows["identity"].tolist(), rows["event_time"].tolist(), rows["arrival"].tolist(), rows["digest"].tolist()):
            if i in known:
                first = known[i]
                if d != first[0]:
                    if first[3] == 0:
                        out.append((key[0], first[1], i, first[2], "CONFLICT", False))
                    first[3] = 2
                out.append((key[0], r, i, t, "CONFLICT" if first[3] == 2 else "DUPLICATE", False))
            else:
                late = t <= mark
                known[i] = [d, r, t, 1 if late else 0]
                if late:
                    out.append((key[0], r, i, t, "LATE", False))
                else:
                    heapq.heappush(waiting, (t, i))
            mark = max(mark, a - lateness)
            while waiting and waiting[0][0] <= mark:
                t, j = heapq.heappop(waiting)
                if known[j][3] == 0:
                    known[j][3] = 1
                    out.append((key[0], known[j][1], j, t, "VALID", True))
        cells = list(known.values())
        state.update((mark, list(known), [c[0] for c in cells], [c[1] for c in cells], [c[2] for c in cells], [c[3] for c in cells]))
        yield pd.DataFrame(out, columns=["stream", "row", "identity", "event_time", "state", "authoritative"])

    held = "mark long, ids array<string>, firsts array<string>, rows array<long>, times array<long>, flags array<int>"
    return stream.groupBy("stream").applyInPandasWithState(step, REPLAYED, held, "append", GroupStateTimeout.NoTimeout)


def day_rollover(stream: DataFrame, time: str, lead: str = "30 seconds", grace: str = "10 minutes", *by: str) -> DataFrame:
    """Days whose capture begins `lead` before midnight and drains for `grace` after it: a row counts for its own UTC day,
    and the day is final once the watermark has passed its end by the grace. opened: when the day's capture begins."""
    out = daily_counts(stream, time, grace, *by)
    return out.withColumn("opened", F.col("day") - F.expr(f"interval {lead}"))


def gap_counts(stream: DataFrame, step: int) -> DataFrame:
    """Missing bars of each symbol on a stream of symbol, open_us: what lies between a bar and the greatest before it."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total = state.get if state.exists else (None, 0)
        for t in sorted(t for b in batches for t in b["open_us"].tolist()):
            if last is not None and t > last:
                total += (t - last) // step - 1
            last = t if last is None else max(t, last)
        state.update((last, total))
        yield pd.DataFrame([(key[0], last, total)], columns=["symbol", "last_us", "gaps"])

    return stream.groupBy("symbol").applyInPandasWithState(count, "symbol string, last_us long, gaps long", "last long, total long", "update", GroupStateTimeout.NoTimeout)


def segments_sink(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = 100_000):
    """Capture segments: gzip JSON lines by UTC day of `receipt`, bounded rows a file."""
    out = stream.withColumn("day", F.to_date("receipt")).writeStream.format("json").partitionBy("day")
    return out.option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
