"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sizes are summed by source (one row each; the number of sources is the only thing the driver holds).
2. The total to take is shared by weight; a source whose share is above max_repeats times its size stops there and
   its excess is reshared by weight until none is above.
3. The total is a number of blocks of block_tokens words. Quotients target/(2k-1) rank the blocks of all sources;
   the highest win. The ranking is cut into n_shards equal runs: each output shard has an integer quota of blocks of
   every source (shard_quotas), and a source's blocks go to the shards in their order.
4. A source's documents stand in seeded order (md5 of seed and id, then a hash of the text) and their words are
   numbered; pass p repeats the sequence. Winning blocks are the first ones of that sequence, so a document gives the
   words that lie in them. `shard` is the output shard of the block that holds a document's first taken word.
   Positions are prefix sums over hash buckets: no task holds a whole source.

The driver holds one row a source.

Defined cases: null text has size 0 and takes 0; a null source is a source, sorted last; a source of size 0 has
target 0; rows repeated with one id are separate rows, in the order of their texts, and rows alike in both are
interchangeable; a null id is a key like any other; an empty table gives an empty result. Extra columns stay, those
named as a result are replaced.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import WORD, order_key, running_total


def word_count(text: str = "text"):
    """Number of words, without making an array of them: non-words out, then starts of words counted."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: Fraction, max_repeats: int = 2) -> dict:
    """Shares of total by weight, none above max_repeats * size; the excess goes to the others by weight."""
    open_, left, got = dict(weights), Fraction(total), {}
    while open_:
        whole = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / whole >= max_repeats * sizes[s]]
        if not over:
            return got | {s: left * w / whole for s, w in open_.items()}
        for s in over:
            got[s] = Fraction(max_repeats * sizes[s])
        left -= sum(got[s] for s in over)
        for s in over:
            del open_[s]
    return got


def seats(goals: dict, n: int) -> dict:
    """Sainte-Lague: how many of the n highest quotients goal/(2k-1) each source holds; ties go in key order."""
    live = {s: Fraction(g) for s, g in goals.items() if g > 0}
    out = dict.fromkeys(goals, 0)
    if n <= 0 or not live:
        return out
    won = lambda q: {s: max(0, (int(g / q) + 1) // 2) for s, g in live.items()}  # noqa: E731  odd divisors up to goal/q
    low, high = Fraction(0), 2 * max(live.values())
    while True:  # bisection of the quotient until at most one block of any source lies between
        mid = (low + high) / 2 if low else high / 2
        mid = mid.limit_denominator(10**9) or mid
        if not low < mid < high:
            mid = (low + high) / 2
        have = won(mid)
        if sum(have.values()) == n:
            return out | have
        low, high = (mid, high) if sum(have.values()) > n else (low, mid)
        if low and all(a - b <= 1 for a, b in zip(won(low).values(), won(high).values())):
            break
    base = won(high)
    rest = n - sum(base.values())
    order = {s: i for i, s in enumerate(live)}
    for s in sorted(live, key=lambda s: (-live[s] / (2 * base[s] + 1), order[s]))[:rest]:
        base[s] += 1
    return out | base


def shard_quotas(goals: dict, n: int, n_shards: int) -> list[dict]:
    """The ranking of blocks cut into n_shards equal runs: blocks of each source in each."""
    ends = [seats(goals, n * k // n_shards) for k in range(n_shards + 1)]
    return [{s: b[s] - a[s] for s in goals} for a, b in zip(ends, ends[1:])]


def by_source(docs: DataFrame, source: str = "source") -> dict:
    """Words of each source, in the order of code points with null last; docs has `size`."""
    rows = docs.groupBy(source).agg(F.sum("size").alias("n")).collect()  # one row a source
    return {x[source]: x["n"] for x in sorted(rows, key=lambda x: (x[source] is None, x[source] or ""))}


def mix(docs: DataFrame, weights=(3, 1, 2), share: Fraction = Fraction(3, 2), max_repeats: int = 2, block_tokens: int = 32, n_shards: int = 24, seed: str = "mix", broadcast_sources: int = 100_000, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with size, source_size, target, taken, shard (null if nothing is taken), and first_word: how many words of
    its source stand before it."""
    spark = docs.sparkSession
    sized = docs.drop("size", "source_size", "target", "taken", "shard", "first_word").withColumn("size", word_count(text))
    sizes = by_source(sized, source)
    total = share * sum(sizes.values())
    goal = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(sizes)}, total, max_repeats)
    quotas = shard_quotas(goal, int(total / block_tokens + Fraction(1, 2)), n_shards)
    ends = {s: list(accumulate(q[s] for q in quotas)) for s in sizes}  # blocks of the source up to each shard's end
    plan = spark.createDataFrame(
        [(s, n, float(goal[s]), ends[s][-1] * block_tokens, ends[s]) for s, n in sizes.items()],
        "_m_source string, source_size long, target double, _m_cut long, _m_ends array<long>",
    )
    n_rows = sized.count()
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    keyed = sized.withColumn("_m_key", order_key(drawn, F.xxhash64(text), F.col("size")))
    placed = running_total(keyed, [source], "_m_key", "size", "first_word", n_rows)
    plan = F.broadcast(plan) if len(sizes) <= broadcast_sources else plan
    mixed = placed.join(plan, F.col(source).eqNullSafe(F.col("_m_source")))
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), F.col("_m_cut") - F.col("first_word") - p * F.col("source_size"))) for p in range(max_repeats)), F.lit(0))
    block = F.floor(F.col("first_word") / block_tokens)
    mixed = mixed.withColumn("taken", taken.cast("long"))
    shard = F.when(F.col("taken") > 0, F.size(F.filter("_m_ends", lambda e: e <= block)))
    return mixed.withColumn("shard", shard.cast("int")).drop("_m_key", "_m_source", "_m_cut", "_m_ends")


def emit(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix as rows: a document once for each pass that takes words of it. The one document of a source that the
    last block cuts gives only the words taken; every other text is whole."""
    size, taken = F.col("size"), F.col("taken")
    passes = F.when((size > 0) & (taken > 0), F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = mixed.withColumn("_m_pass", F.explode(passes))
    words = F.least(size, taken - (F.col("_m_pass") - 1) * size)
    part = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.lit(1), words.cast("int")))
    return rows.withColumn(text, F.when(words < size, part).otherwise(F.col(text))).drop("_m_pass")
