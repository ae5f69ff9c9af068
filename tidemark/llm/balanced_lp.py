"""Sharding by balanced label propagation over linked documents.

Links. Equal texts are linked; `links` may name more pairs of documents. A set of linked documents is a class (an equal
text, or one pair), so a group of n copies costs n rows and never its pairs.

Law `rows`: shard counts are at most one apart. Linked documents start in hashed shards. In each iteration the members
of a class are counted by shard (a small row for each class and shard, pre-aggregated), the class's goal is the shard
that holds most of it, a document follows the class of its own with most neighbours there, and moves as far as the
goal's quota allows; the quota is filled by a hash of class and iteration, so classes move whole. A class larger than
nine tenths of a shard gets several goals. Afterwards what is above capacity leaves, and unlinked documents with these
fill every shard to its exact count. The iterations touch only keys and shards, never texts.

Ranks come from prefix sums over hash buckets and classes of many rows are looked up in a broadcast table, so no task
holds a whole shard or group.

Defined cases: null text has size 8, checksum 0 and no links; empty text is a text like any other; repeated rows are
rows of their own, placed alike on every run (rows of one id and text are interchangeable); a null id is a key like any
other; links that name unknown ids do nothing; an empty table gives an empty result; only columns in `keep` are read
beside id and text, and results replace those of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import cut, discard, hot_keys, order_key, running_total, spread_join

RESULT = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _uniform(*cols) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)).cast("double") / float(1 << 30)


def _step(x: Column, ends: list[int]) -> Column:
    """How many of the ascending ends are at most x."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= x)).cast("int")


def cut_links(linked: DataFrame) -> DataFrame:
    """One row: links (pairs of a class, summed over classes) and how many of them cross shards. linked: class, shard."""
    held = linked.groupBy("class", "shard").agg(F.count("*").cast("double").alias("c")).groupBy("class").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return held.agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0)).alias("links"), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2), F.lit(0.0)).alias("cut"))


def propagate(linked: DataFrame, caps: list[int], iterations: int, hot: DataFrame, several: bool) -> DataFrame:
    """linked: rid, class, members, shard; a row for each class of a document. The same with shards after the iterations.
    several: documents may be in several classes."""
    n_shards, cap = len(caps), max(1, min(caps))
    for i in range(iterations):
        counts = linked.groupBy("class", "shard").agg(F.count("*").alias("c"), F.first("members").alias("members"))
        best = counts.groupBy("class").agg(
            F.sort_array(F.collect_list(F.struct("c", F.xxhash64("class", "shard").alias("tie"), "shard")), asc=False).alias("held"),  # n_shards entries at most
            F.first("members").alias("members"),
        )
        width = F.greatest(F.lit(1), F.ceil(F.col("members") / (0.9 * cap)).cast("int"))
        goals = best.select("class", F.slice(F.col("held.shard"), F.lit(1), width).alias("goals"), F.col("held")[0]["c"].alias("most"))
        wished = spread_join(linked, goals, "class", ["goals", "most"], hot, F.xxhash64("rid"))
        wished = wished.withColumn(
            "goal",
            F.when(F.array_contains("goals", F.col("shard")), F.col("shard")).otherwise(
                F.element_at("goals", (F.pmod(F.xxhash64("rid", F.lit(i)), F.size("goals")) + 1).cast("int"))
            ),
        )
        if several:  # the class with most members at its goal decides; rows of one document are few
            votes = wished.groupBy("rid").agg(F.max(F.struct("most", F.xxhash64("class", "goal").alias("tie"), "goal", F.when(F.size("goals") == 1, F.col("class")).alias("whole"))).alias("v"))
            wished = wished.drop("goal").join(votes.select("rid", F.col("v.goal").alias("goal"), F.col("v.whole").alias("whole")), "rid")
        else:
            wished = wished.withColumn("whole", F.when(F.size("goals") == 1, F.col("class")))
        moves = F.col("goal") != F.col("shard")
        load = wished.groupBy("goal").agg(F.count_if(~moves).alias("stay"), F.count_if(moves).alias("come")).collect()  # n_shards rows
        quota = [0.0] * n_shards
        for x in load:
            quota[x["goal"]] = 1.0 if not x["come"] else max(0.0, min(1.0, (caps[x["goal"]] - x["stay"]) / x["come"]))
        draw = F.when(F.col("whole").isNull(), _uniform("rid", F.lit(i))).otherwise(_uniform("whole", F.lit(i)))
        allowed = draw < F.element_at(F.array(*map(F.lit, quota)), F.col("goal") + 1)
        moved = cut(wished.select("rid", "class", "members", F.when(moves & allowed, F.col("goal")).otherwise(F.col("shard")).alias("shard")))
        if i:
            discard(linked)
        linked = moved
    return linked


def assign(docs: DataFrame, n_shards: int = 24, iterations: int = 3, seed: str = "shard", doc_id: str = "doc_id", text: str = "text", links: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns of `keep` for every row. links: a, b."""
    kept = [c for c in keep if c not in RESULT]
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.xxhash64(text).cast("string")))
    keyed = cut(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.when(F.col(text).isNotNull(), F.xxhash64(F.xxhash64(text), F.crc32(raw))).alias("class"),
            drawn.alias("key"),
            F.struct(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *kept).alias("row"),
        )
    )
    # rows of one key have one start and one class; beside them only the number of the row orders them
    place = keyed.select("rid", "class", order_key(F.col("key"), F.col("rid")).alias("key"), F.col("row.doc_id").alias("doc_id"))
    n = keyed.count()
    caps = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    member = place.where("class is not null").select("rid", "class", "key")
    if links is not None:
        ends = links.select(F.explode(F.array("a", "b")).alias("doc_id"), F.xxhash64(F.lit("link"), F.least("a", "b"), F.greatest("a", "b")).alias("class")).distinct()
        member = member.unionByName(place.drop("class").join(ends, "doc_id").select("rid", "class", "key"))
    groups = cut(member.groupBy("class").agg(F.count("*").alias("members")).where("members > 1"))
    hot = hot_keys(groups, "members", n)
    start = F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int").alias("shard")
    linked = cut(spread_join(member, groups, "class", ["members"], hot, F.xxhash64("rid")).where("members is not null").select("rid", "class", "members", start))
    linked = propagate(linked, caps, iterations, hot, links is not None)
    homes = linked.groupBy("rid").agg(F.first("shard").alias("shard")) if links is not None else linked.select("rid", "shard")
    named = place.select("rid", "key", F.coalesce("class", F.lit(0)).alias("class")).join(homes, "rid", "left").withColumn("one", F.lit(1))
    named = cut(named)
    held = running_total(named.where("shard is not null").withColumn("ck", order_key(F.md5(F.col("class").cast("string")), F.col("key"))), ["shard"], "ck", "one", "rank", n)
    fits = F.col("rank") < F.element_at(F.array(*map(F.lit, caps)), F.col("shard") + 1)
    placed = cut(held.select("rid", "key", F.when(fits, F.col("shard")).alias("shard")).unionByName(named.where("shard is null").select("rid", "key", "shard")))
    held_by = {x["shard"]: x["count"] for x in placed.where("shard is not null").groupBy("shard").count().collect()}  # n_shards rows
    free, ends = 0, []
    for s, c in enumerate(caps):
        free += c - held_by.get(s, 0)
        ends.append(free)
    # the lanes, dealt by the number of the row, are filled one after another
    fill = placed.where("shard is null").withColumn("lane", F.pmod(F.xxhash64("key", F.lit("lane")), F.lit(256)).cast("int")).withColumn("one", F.lit(1))
    lanes = sorted((x["lane"], x["count"]) for x in fill.groupBy("lane").count().collect())  # 256 rows at most
    before, starts = 0, {}
    for lane, count in lanes:
        starts[lane] = before
        before += count
    start_of = F.element_at(F.array(*[F.lit(starts.get(i, 0)) for i in range(256)]), F.col("lane") + 1)
    ranked = running_total(fill, ["lane"], "key", "one", "rank", n // 256 + 1)
    filled = ranked.select("rid", "key", _step(start_of + F.col("rank"), ends[:-1]).alias("shard"))
    everyone = cut(placed.where("shard is not null").unionByName(filled)).withColumn("one", F.lit(1))
    slots = running_total(everyone, ["shard"], "key", "one", "slot", max(1, n // n_shards))
    done = slots.select("rid", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")).join(keyed.select("rid", "row"), "rid")
    discard(groups, linked, named, placed)
    return done.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
