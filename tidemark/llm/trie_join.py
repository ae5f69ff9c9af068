"""Self-join of texts on the Jaccard similarity of word n-gram sets, by prefix trees over globally ordered sets.

Classes. A text's set is a sorted array of 64-bit n-gram numbers; its class is a 64-bit number of that array. All work
is done once for a class, whatever ids its texts have: null ids, and ids that occur with different texts, are rows
like any other.

Order. The n-grams that are frequent in the corpus (at most max_heavy of them) come last, in order of frequency; all
others first, by number. Any common order gives the same links; this one keeps frequent n-grams out of the prefixes. A
batch of texts reports the n-grams that it has twice or more, so the list is of likely frequent ones, no exact count.

Candidates. Two sets of similarity >= percent/100 share one of the first n - ceil(percent*n/100) + 1 n-grams of
each. Prefixes are dealt by n-gram; each class meets the least class of each of its prefix n-grams (a star, not
all pairs of a group).

Pruning before texts move: counts of each set's numbers by 256 bins bound an intersection from above.

Verification. The candidates of a query, in blocks of `block`, form a trie of ordered sets. The query walks it once:
candidates with a common path share its partial overlap, and a subtree goes when the overlap so far plus the shorter
remainder stays under what its lengths ask for. Overlaps are exact.

Rounds. Round 1 verifies each class with the centre that it shares most with, round 2 the other centres in
another component. What is left are pairs in one prefix group whose components differ. Of groups with the same members
one is kept. Groups of up to `pairwise` classes give their pairs; larger ones are cut into blocks of classes, which meet
themselves and, where the group's components still differ then, each other, each block as one trie. A block joins
components as it finds links, so it gives fewer links than it has classes and no pair is a row. No link between
components is lost, while links inside one need no check.

Defined cases: null, empty and wordless texts have empty sets and are alone; a text under n words is one n-gram;
repeated rows share a class; an empty table gives an empty result; extra columns stay unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import discard, hot_keys, spread_join, stored
from tidemark.llm.components import components
from tidemark.llm.textnum import chunks, shingle_sets

_TOP = np.uint64(1 << 63)
#: Numbers of a set are counted by their leading bits: the sum of the lesser counts bounds an intersection from above.
BINS, _BIN_SHIFT = 256, np.uint64(56)
#: Classes that a task remembers, so that copies in it are treated once; beyond them it begins anew.
SEEN = 1 << 20


def least_overlap(a, b, percent: int):
    """Smallest intersection with 100*i >= percent*(a+b-i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def class_of(found: np.ndarray) -> int:
    """Number of a set: signed, equal for equal sets, by chance (2^-64 a pair) for others."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_number(text: Column) -> Column:
    """64-bit number of a text; null is like the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ordered(found: np.ndarray, heavy: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A set in the global order: 63-bit numbers, then heavy n-grams by place. heavy is sorted."""
    keys = found & ~_TOP
    if len(heavy) and len(found):
        at = np.searchsorted(heavy, found)
        at[at == len(heavy)] = 0
        is_heavy = heavy[at] == found
        keys[is_heavy] = _TOP | place[at[is_heavy]]
    keys.sort()
    return keys


def trie_links(query: np.ndarray, sets: list[np.ndarray], percent: int, segment: int = 64) -> list[int]:
    """Indices of the sets that are similar to the query."""
    n_q = len(query)
    order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
    out: list[int] = []
    path = np.empty(0, np.uint64)  # the branch that was walked last
    common = np.zeros(1, np.int64)  # query n-grams in its first d, for each depth d that was walked
    for i in order:
        own = sets[i]
        n = len(own)
        need = least_overlap(n_q, n, percent)
        short = min(n, len(common) - 1, len(path))
        differ = np.flatnonzero(own[:short] != path[:short])
        depth = int(differ[0]) if len(differ) else short
        common = common[: depth + 1]
        alive = need <= min(n, n_q)
        while alive and depth < n:
            passed = int(np.searchsorted(query, own[depth - 1], side="right")) if depth else 0
            if common[depth] + min(n - depth, n_q - passed) < need:
                alive = False  # so does every set below this node that is as long
                break
            part = own[depth : depth + segment]
            at = np.searchsorted(query, part)
            at[at == n_q] = 0
            common = np.concatenate([common, common[-1] + np.cumsum(query[at] == part)])
            depth += len(part)
        path = own
        if alive and common[n] >= need:
            out.append(i)
    return out


DESCRIBED = "kind int, id long, node long, n long, cls long, bins array<int>"


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _describe(k: int, least: int):
    """From id, node, text: rows of documents (kind 0: id, node, set size, class), of classes (kind 2: class, bins) and
    of n-grams frequent in a batch (kind 1: n-gram in cls, count in n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = lambda m, t: pa.nulls(m, t)
        bins_type = pa.list_(pa.int32())
        seen: set[int] = set()
        for batch in batches:
            ids, nodes, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            every = [np.empty(0, np.uint64)]
            for lo, hi in chunks(texts):
                sets = list(shingle_sets(texts[lo:hi], k))
                every += sets
                m = len(sets)
                size = pa.array([len(s) for s in sets], pa.int64())
                cls = [class_of(s) for s in sets]
                yield _table(kind=pa.array(np.zeros(m, np.int32)), id=ids.slice(lo, m), node=nodes.slice(lo, m), n=size, cls=pa.array(cls, pa.int64()), bins=nothing(m, bins_type))
                fresh = {c: s for c, s in zip(cls, sets) if len(s) and c not in seen}
                seen = seen | fresh.keys() if len(seen) < SEEN else set(fresh)
                if m := len(fresh):
                    counts = np.concatenate([np.bincount(s >> _BIN_SHIFT, minlength=BINS) for s in fresh.values()]).astype(np.int32)
                    bins = pa.ListArray.from_arrays(pa.array(np.arange(0, m * BINS + 1, BINS, dtype=np.int32)), pa.array(counts))
                    yield _table(kind=pa.array(np.full(m, 2, np.int32)), id=nothing(m, pa.int64()), node=nothing(m, pa.int64()), n=nothing(m, pa.int64()), cls=pa.array(list(fresh), pa.int64()), bins=bins)
                del sets
            grams = np.concatenate(every)
            del every
            grams.sort()  # in place: an n-gram seen `least` times equals the one least - 1 places before it
            later = grams[least - 1 :]
            often = np.unique(later[later == grams[: len(later)]])
            if m := len(often):
                counts = np.searchsorted(grams, often, side="right") - np.searchsorted(grams, often)
                yield _table(kind=pa.array(np.ones(m, np.int32)), id=nothing(m, pa.int64()), node=nothing(m, pa.int64()), n=pa.array(counts), cls=pa.array(often.view(np.int64)), bins=nothing(m, bins_type))

    return run


def _prefixes(k: int, percent: int, order: Broadcast):
    """From text: gram, id (the class) and n of every class that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, place = order.value
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                ids, sizes, parts = [], [], []
                for s in shingle_sets(texts[lo:hi], k):
                    if len(s) and (c := class_of(s)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(c)
                        parts.append(ordered(s, heavy, place)[: prefix_length(len(s), percent)])
                        ids.append(c)
                        sizes.append(len(s))
                if ids:
                    long = [len(p) for p in parts]
                    yield _table(gram=pa.array(np.concatenate(parts).view(np.int64)), id=pa.array(np.repeat(np.array(ids, np.int64), long)), n=pa.array(np.repeat(np.array(sizes, np.int32), long)))

    return run


QUERY, CANDIDATE, BOTH = 0, 1, 2


def _verify(k: int, percent: int, order: Broadcast):
    """Rows (grp, role, id, comp, text) arrive sorted by group and role. Links of each group's queries with its
    candidates, as many as join components (fewer than the group has rows); rows of role BOTH are either."""

    def links(group: list[tuple]) -> Iterator[tuple]:
        up: dict[int, int] = {}

        def root(member: tuple) -> int:
            x = member[2] if member[3] is None else member[3]  # a component is named by one of its ids
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        ends = [g for g in group if g[1] != QUERY]
        for i, own in enumerate(group):
            if own[1] != CANDIDATE:
                mine = root(own)
                open_ = [g for g in (group[i + 1 :] if own[1] == BOTH else ends) if root(g) != mine]
                for j in trie_links(own[4], [g[4] for g in open_], percent):
                    if (other := root(open_[j])) != (mine := root(own)):
                        up[other] = mine
                        yield own[2], open_[j][2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, place = order.value
        told = lambda out: _table(a=pa.array([x[0] for x in out], pa.int64()), b=pa.array([x[1] for x in out], pa.int64()))
        group: list[tuple] = []
        for batch in batches:
            out = []
            grp, role, ids, comp, text = (c.to_pylist() for c in batch.columns)
            for key, r, i, c, s in zip(grp, role, ids, comp, shingle_sets(text, k)):
                if group and group[0][0] != key:
                    out += links(group)
                    group = []
                group.append((key, r, i, c, ordered(s, heavy, place)))
            yield told(out)
        yield told(list(links(group)))

    return run


class StarJoin:
    """Links between texts that share a candidate key. texts_of: gives id (unique), text for a DataFrame of ids."""

    def __init__(self, spark, texts_of: Callable[[DataFrame], DataFrame], k: int, percent: int, order: Broadcast | None = None, block: int = 256, pairwise: int = 32, broadcast_rows: int = 400_000, bins: DataFrame | None = None):
        self.spark, self.texts_of, self.k, self.percent, self.block, self.pairwise = spark, texts_of, k, percent, block, min(pairwise, block)
        self.order = order or spark.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0, np.uint64)))
        self.broadcast_rows, self.bins = broadcast_rows, bins

    def _checked(self, grouped: DataFrame, n: int) -> DataFrame:
        """grouped: grp, role, id, comp, at most n rows. The links that the tries find. Ids are sent to every task only
        if few."""
        with_text = self.texts.join(F.broadcast(grouped) if n <= self.broadcast_rows else grouped, "id").select("grp", "role", "id", "comp", "text")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = with_text.repartition(parts, "grp").sortWithinPartitions("grp", "role", "id")
        return stored(dealt.mapInArrow(_verify(self.k, self.percent, self.order), "a long, b long"), "links")

    def _plausible(self, pairs: DataFrame, n: int) -> DataFrame:
        """pairs without those that the counts by bin rule out: no link goes, and texts of few others are moved."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        held = stored(self.bins.join(F.broadcast(ids) if 2 * n <= self.broadcast_rows else ids, "id").dropDuplicates(["id"]), "bins")
        both = pairs.join(held.selectExpr("id as a", "bins as x"), "a").join(held.selectExpr("id as b", "bins as y"), "b")
        total = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v)
        most = total(F.zip_with("x", "y", lambda u, v: F.least(u, v)))
        out = stored(both.where((100 + self.percent) * most >= self.percent * (total("x") + total("y"))).select("a", "b"), "pairs")
        discard(pairs, held)
        return out

    def _pairs_checked(self, pairs: DataFrame) -> DataFrame:
        """pairs: a, b of classes. Candidates of a in blocks of up to about `block`, dealt by hash."""
        pairs = stored(pairs, "pairs")
        n = pairs.count()
        if not n:
            return pairs
        if self.bins is not None:
            pairs = self._plausible(pairs, n)
        fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / self.block).alias("blocks")).where("blocks > 1")  # n / block rows at most
        dealt = pairs.join(F.broadcast(fan) if n / self.block <= self.broadcast_rows else fan, "a", "left")
        dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).alias("salt"))
        name = F.concat_ws(":", "a", "salt").alias("grp")
        none = F.lit(None).cast("long").alias("comp")
        queries = dealt.select(name, F.lit(QUERY).alias("role"), F.col("a").alias("id"), none).distinct()
        out = self._checked(queries.unionByName(dealt.select(name, F.lit(CANDIDATE).alias("role"), F.col("b").alias("id"), none)), 2 * n)
        discard(pairs)
        return out

    def links(self, active: DataFrame) -> DataFrame:
        """Links a, b that have the components of all links. active: gram, id, n, low, low_n (the least id of the gram)."""
        self.texts = stored(self.texts_of(active.select("id").distinct()), "texts")
        short = f"100 * least(n, low_n) >= {self.percent} * greatest(n, low_n)"
        stars = active.where("id <> low").where(short).groupBy(F.col("id").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("c"))
        stars = stored(stars, "stars")
        best = stored(stars.groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b")), "best")
        # queries are the centres: their candidates share a trie
        first = self._pairs_checked(best.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct())
        label = components(first)
        la, lb = label.selectExpr("v as a", "comp as ca"), label.selectExpr("v as b", "comp as cb")
        apart = stars.join(best, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")
        second = self._pairs_checked(apart.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = first.unionByName(second)
        discard(label)
        label = components(found)
        tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = stored(found.unionByName(self._across(active, label, tried)).distinct(), "found")
        discard(stars, best, first, second, label, self.texts)
        return out

    def _across(self, active: DataFrame, label: DataFrame, tried: DataFrame) -> DataFrame:
        """Round 3: prefix groups that still hold several components."""
        named = active.select("gram", "id", "n").distinct().join(label.withColumnRenamed("v", "id"), "id", "left")
        member = stored(named.select("gram", "id", "n", F.coalesce("comp", "id").alias("comp")), "members")
        of_gram = member.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("who"))
        kept = of_gram.where("x <> y").groupBy("who", "m").agg(F.min("gram").alias("gram"))  # groups with the same members: one
        mixed = stored(member.join(kept.select("gram", "m"), "gram"), "mixed-groups")
        discard(member)
        few = mixed.where(F.col("m") <= self.pairwise)
        left = few.select("gram", F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"))
        right = few.select("gram", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
        short = f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)"
        pairs = left.join(right, "gram").where("a < b and ca <> cb").where(short).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        out = self._pairs_checked(pairs)
        many = mixed.where(F.col("m") > self.pairwise)
        n_many = many.count()
        if not n_many:
            return out
        # blocks of classes of a group: each meets itself, then each later one where the group still holds several components
        n_blocks = F.ceil(F.col("m") / self.block)
        placed = many.withColumn("k", F.pmod(F.xxhash64("id"), n_blocks))
        name = F.concat_ws(":", "gram", "k").alias("grp")
        inside = self._checked(placed.select(name, F.lit(BOTH).alias("role"), "id", "comp"), n_many)
        label = components(label.selectExpr("v as a", "comp as b").unionByName(inside))
        named = placed.drop("comp").join(label.withColumnRenamed("v", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        named = stored(named, "placed")
        discard(label)
        still = named.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("gram")
        left = named.join(still, "gram", "left_semi").withColumn("n_blocks", n_blocks)
        most = left.agg(F.sum("n_blocks")).first()[0]
        if not most:
            return out.unionByName(inside)
        met = left.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).where("j <> k")
        name = F.concat_ws(":", "gram", F.least("k", "j"), F.greatest("k", "j")).alias("grp")
        role = F.when(F.col("k") < F.col("j"), QUERY).otherwise(CANDIDATE).alias("role")
        return out.unionByName(inside).unionByName(self._checked(met.select(name, role, "id", "comp"), most))


class TrieJoin:
    """The join over one table."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", max_heavy: int = 1 << 18, heavy_from: int = 6, block: int = 256, pairwise: int = 32, broadcast_rows: int = 400_000):
        spark = docs.sparkSession
        self.k, self.percent, self.broadcast_rows = k, percent, broadcast_rows
        self.source = docs.select(F.col(doc_id).cast("long").alias("id"), text_number(F.col(text)).alias("node"), F.col(text).alias("text"))
        self.told = stored(self.source.mapInArrow(_describe(k, 2), DESCRIBED), "ngrams")
        often = self.told.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= heavy_from)
        top = often.orderBy(F.desc("n"), "cls").limit(max_heavy).toArrow()  # max_heavy rows of 16 bytes at most
        grams = top.column("cls").to_numpy().view(np.uint64)
        by = np.argsort(grams)
        rank = np.arange(len(grams), dtype=np.uint64)[::-1]  # the most frequent last
        #: Sent once: 16 bytes a heavy n-gram.
        self.order = spark.sparkContext.broadcast((grams[by], rank[by]))
        #: id, node, n, cls of every row.
        self.rows = self.told.where("kind = 0").select("id", "node", "n", "cls")
        bins = self.told.where("kind = 2").select(F.col("cls").alias("id"), "bins")
        self._repeated: bool | None = None
        self.star = StarJoin(spark, self._texts_of, k, percent, self.order, block, pairwise, broadcast_rows, bins)

    def _texts_of(self, ids: DataFrame) -> DataFrame:
        """One text of each class of ids."""
        rep = self.rows.groupBy("cls").agg(F.min(F.struct("node", "id")).alias("r"))
        want = stored(rep.join(ids.select(F.col("id").alias("cls")), "cls", "left_semi").select("cls", F.col("r.node").alias("node"), F.col("r.id").alias("_id")), "wanted")
        few = want.count() <= self.broadcast_rows
        found = self.source.join(F.broadcast(want) if few else want, (self.source["node"] == want["node"]) & self.source["id"].eqNullSafe(F.col("_id")))
        found = found.select(F.col("cls").alias("id"), "text")
        return found.dropDuplicates(["id"]) if self.repeated() else found

    def repeated(self) -> bool:
        """Whether an id occurs twice with one text."""
        if self._repeated is None:
            self._repeated = self.rows.count() > self.rows.select("id", "node").distinct().count()
        return self._repeated

    def links(self) -> DataFrame:
        """a, b: linked classes; their components are those of all links."""
        prefixes = stored(self.source.select("text").mapInArrow(_prefixes(self.k, self.percent, self.order), "gram long, id long, n int"), "prefixes")
        shared = prefixes.groupBy("gram").agg(F.min(F.struct("id", "n")).alias("l"), F.max("id").alias("high")).where("l.id < high")
        active = stored(prefixes.join(shared, "gram").select("gram", "id", "n", F.col("l.id").alias("low"), F.col("l.n").alias("low_n")), "shared-prefixes")
        discard(prefixes)
        out = self.star.links(active)
        discard(active)
        return out

    def documents(self) -> DataFrame:
        """id, node (a number of the text), n, cls (null for empty sets), comp (the least id of its component) and kept
        (whether it is the document that stands for its component, the least by id and text) for every row."""
        label = components(self.links())
        least = F.min(F.struct(F.col("id").isNull(), "id", "node"))
        size = stored(self.rows.where("n > 0").groupBy("cls").agg(least.alias("least"), F.count("*").alias("m")), "classes")
        own = size.join(label.withColumnRenamed("v", "cls"), "cls", "left").where("m > 1 or comp is not null")
        named = stored(own.select("cls", F.coalesce("comp", "cls").alias("comp"), "least", "m"), "linked-classes")
        whole = named.groupBy("comp").agg(F.min("least").alias("first"))
        first = stored(named.join(whole, "comp").select("cls", F.col("first.id").alias("first"), F.col("first.node").alias("first_node"), "m"), "component-ids")
        discard(size, named)
        rows = self.rows.withColumn("cls", F.when(F.col("n") > 0, F.col("cls")))
        found = spread_join(rows, first, "cls", ["first", "first_node"], hot_keys(first, "m", self.rows.count()), F.xxhash64("id", "node"))
        kept = F.col("first_node").isNull() | (F.col("first").eqNullSafe(F.col("id")) & (F.col("first_node") == F.col("node")))
        return found.select("id", "node", "n", "cls", F.coalesce("first", "id").alias("comp"), kept.alias("kept"))
