"""Substring deduplication by MinHash banding of paragraphs.

Paragraphs. Lines of at least min_words words: 5-word shingles, MinHash, bands tuned for recall `recall` at the
threshold. Distinct paragraphs that collide in a band meet (the star and the rounds of trie_join, so no pairs of a group
are all emitted), their exact Jaccard similarity is verified, and connected components are classes. Equal paragraphs
share a 64-bit number of their words (chance of a false match 2^-64 a pair) and meet once.

Runs. Every `exact_from` words in a row, whatever the lines, are a paragraph too. The shingles of such a run are its
exact_from - min_run + 1 windows of min_run words, and its MinHash by one row is the window with the least number:
winnowing, so that all runs of a document give one piece for about 16 words. Equal runs have equal pieces, so recall is 1.
Pieces that collide meet their class's first piece and are verified word by word: both are extended as far as they
agree. Extended pieces that overlap are one row, and rows of fewer than report_from words go. Where a piece's class has
more than two places and its meeting with the first one gave fewer words, all runs of report_from words around it are
numbered and meet their equals, so no passage is lost because a shorter one is common.

Copies. Equal texts are one text in all this; their documents get a row of kind piece from the first to the last word.

Of each class the first unit by id and position stays; the others are removals. Rows of kind piece are whole repeats:
passages that documents share with the class's first one.

Defined cases: null and empty texts have no units; rows repeated with one id and text are one document, one id with
several texts is several; a null id sorts last; a passage repeated inside one document is a duplicate; an empty table
gives an empty result; extra columns stay unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import LOWER, UPPER, WORD, discard, hot_keys, spread_join, stored
from tidemark.llm.components import components
from tidemark.llm.textnum import _BASE, _INVERSE, _power, chunks, mix64, words
from tidemark.llm.trie_join import SEEN, StarJoin, text_number

PARAGRAPH, PIECE, WHOLE = 1, 2, 3
UNITS = "kind int, unit long, id long, node long, at int, start int, end int, words int, link long, next int, keys array<long>"
AROUND = "node long, pos int, side int, near string, edge int, own string"
FRAMES = "frame long, node long, at int, start int, end int"

_WORD = re.compile(WORD)
_FOLD = str.maketrans(UPPER, LOWER)


def tune_bands(threshold: float, recall: float, rows: int = 2) -> tuple[int, int]:
    """Fewest bands of `rows` rows that find a pair at the threshold with chance `recall`."""
    miss, bands = 1 - threshold**rows, 1
    while 1 - miss**bands < recall:
        bands += 1
    return bands, rows


def _spans(number: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each run of words [a, b)."""
    sums = np.zeros(len(number) + 1, np.uint64)
    np.cumsum(number * _power(_BASE, len(number)), out=sums[1:])
    return mix64((sums[b] - sums[a]) * _power(_INVERSE, len(number) + 1)[a] + (b - a).astype(np.uint64))


def _reach(value: np.ndarray, i: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many places, most - 1 at most, value[i] goes on to be the least: before it (step -1) ties count, after it not."""
    out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
    for d in range(1, most):
        other, own = value[i[open_] + step * d], value[i[open_]]
        open_ = open_[other >= own if step < 0 else other > own]
        if not len(open_):
            break
        out[open_] = d
    return out


def winnow(number: np.ndarray, owner: np.ndarray, k: int, window: int) -> np.ndarray:
    """First words of the k-word windows that are the last least one among `window` in a row of their text (among all
    of a text with fewer). Any window + k - 1 words that two texts share give both an equal one. Of equal windows that
    overlap each other the first stays."""
    m = len(number) - k + 1
    if m < 1:
        return np.empty(0, np.int64)
    at = np.arange(m)
    value = np.zeros(m + 2 * window, np.uint64)  # 0 parts texts
    value[window : window + m] = np.where(owner[k - 1 :] == owner[:m], np.maximum(_spans(number, at, at + k), np.uint64(1)), np.uint64(0))
    i = np.flatnonzero(value)
    who = owner[i - window]
    need = np.minimum(window, np.bincount(who, minlength=1))[who] if len(i) else i
    least = _reach(value, i, -1, window) + _reach(value, i, 1, window) + 1 >= need
    i, who = i[least], who[least]
    order = np.lexsort((i, value[i], who))
    i, who = i[order], who[order]
    again = np.zeros(len(i), bool)
    again[1:] = (value[i[1:]] == value[i[:-1]]) & (who[1:] == who[:-1]) & (np.diff(i) < k)
    keep = np.ones(len(i), bool)
    last = -1
    for j in np.flatnonzero(again):
        if not again[j - 1]:
            last = i[j - 1]
        keep[j] = i[j] >= last + k
        last = i[j] if keep[j] else last
    return np.sort(i[keep]) - window


def _places(texts: list, owner: np.ndarray, first: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end character of each word in its text."""
    chars = np.cumsum((data & 0xC0) != 0x80)
    zero = np.concatenate([[0], chars[np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts]) - 1]])
    return chars[first] - 1 - zero[owner], chars[end - 1] - zero[owner]


def described(texts: list, min_words: int, min_run: int, window: int) -> Iterator[tuple]:
    """Chunks of: first text, numbers and owners of words, begin and end character of each word in its text, first and
    end word of the lines of min_words, first words of the pieces."""
    for lo, hi in chunks(texts):
        number, owner, first, end, data = words(texts[lo:hi])
        if not len(number):
            continue
        line = np.searchsorted(np.flatnonzero(data == 10), first)
        opens = np.flatnonzero(np.diff(line, prepend=-1))
        closes = np.append(opens[1:], len(line))
        whole = closes - opens >= min_words
        yield lo, number, owner, *_places(texts[lo:hi], owner, first, end, data), opens[whole], closes[whole], winnow(number, owner, min_run, window)


def _band_keys(number: np.ndarray, a: np.ndarray, b: np.ndarray, factor: np.ndarray, k: int, bands: int, rows: int) -> np.ndarray:
    """Band keys (units, bands) of the runs [a, b) of words."""
    rolled = number.copy()
    for j in range(1, k):
        rolled[: max(0, len(rolled) - j)] = rolled[: max(0, len(rolled) - j)] * np.uint64(_BASE) + number[j:]
    rolled = mix64(rolled)
    n = np.maximum(1, b - a - k + 1)
    ends = np.cumsum(n)
    shingles = rolled[np.arange(ends[-1]) - np.repeat(ends - n - a, n)]
    least = [np.minimum.reduceat(mix64(shingles * f), ends - n) for f in factor]
    out = np.empty((len(a), bands), np.uint64)
    for i in range(bands):
        key = np.full(len(a), i + 1, np.uint64)
        for m in least[i * rows : (i + 1) * rows]:
            key = mix64(key * np.uint64(_BASE) + m)
        out[:, i] = key
    return out.view(np.int64)


def _emit(min_words: int, min_run: int, window: int, k: int, bands: int, rows: int):
    """From id, node, text: paragraphs of every row (band keys with the first of each in a chunk); pieces and the extent
    of the words of every text that a task meets first."""
    draws = np.random.default_rng(7)
    factor = draws.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    names = [f.split()[0] for f in UNITS.split(", ")]
    types = dict(zip(names, [pa.int32(), *[pa.int64()] * 3, *[pa.int32()] * 4, pa.int64(), pa.int32(), pa.list_(pa.int64())]))

    def table(m: int, **columns) -> pa.RecordBatch:
        made = [pa.nulls(m, types[n]) if n not in columns else columns[n] if isinstance(columns[n], pa.Array) else pa.array(np.asarray(columns[n]), types[n]) for n in names]
        return pa.RecordBatch.from_arrays(made, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, nodes, texts = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for lo, number, owner, begins, ends, opens, closes, piece in described(texts, min_words, min_run, window):
                if m := len(opens):
                    unit = _spans(number, opens, closes).view(np.int64)
                    who = owner[opens] + lo
                    _, fresh = np.unique(unit, return_index=True)
                    keys = _band_keys(number, opens[fresh], closes[fresh], factor, k, bands, rows)
                    at = np.full(m, 0)
                    at[fresh] = bands
                    spread = np.argsort(fresh, kind="stable")
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at)]).astype(np.int32)), pa.array(keys[spread].reshape(-1)))
                    yield table(m, kind=np.full(m, PARAGRAPH), unit=unit, id=ids.take(pa.array(who)), node=nodes[who], start=begins[opens], end=ends[closes - 1], words=closes - opens, keys=lists)
                bounds = np.flatnonzero(np.diff(owner, prepend=-1))
                last = np.append(bounds[1:], len(owner)) - 1
                own = nodes[owner[bounds] + lo]
                new = np.zeros(len(own), bool)
                for i, x in enumerate(own.tolist()):
                    if x not in seen:
                        new[i] = True
                        seen.add(x)
                if len(seen) > SEEN:
                    seen.clear()
                bounds, last, own = bounds[new], last[new], own[new]
                if m := len(own):
                    yield table(m, kind=np.full(m, WHOLE), node=own, start=begins[bounds], end=ends[last], words=last - bounds + 1)
                kept = np.zeros(len(texts) + 1, bool)
                kept[owner[bounds]] = True
                piece = piece[kept[owner[piece]]]
                if m := len(piece):
                    who = owner[piece]
                    first_word = np.searchsorted(owner, who)
                    same = np.append(who[1:] == who[:-1], False)
                    step = np.append(np.diff(piece), 0) * same
                    link = np.where(same, _spans(number, piece, piece + step + min_run).view(np.int64), 0)
                    yield table(m, kind=np.full(m, PIECE), unit=_spans(number, piece, piece + min_run).view(np.int64), node=nodes[who + lo], at=piece - first_word, link=link, next=step)

    return run


def _around(min_run: int, window: int):
    """Rows with node, text and asked (structs of pos, side, own): for each piece asked for, the text of up to `window`
    words before (side -1) or after it (1), the character where the piece begins or ends, and the text of `own` words
    from the piece on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, text, asked in zip(batch["node"], batch["text"], batch["asked"]):
                _, _, first, end, data = words([text])
                chars = np.cumsum((data & 0xC0) != 0x80)
                begins, ends = chars[first] - 1, chars[end - 1]
                for x in asked:
                    lo, hi = x["pos"], x["pos"] + min_run
                    if x["side"] < 0:
                        edge = begins[lo]
                        near = text[begins[max(0, lo - window)] : edge]
                    else:
                        edge = ends[hi - 1]
                        near = text[edge : ends[min(hi + window, len(ends)) - 1]]
                    own = text[begins[lo] : ends[lo + x["own"] - 1]] if x["own"] else ""
                    out.append((node, lo, x["side"], near, edge, own))
            yield pd.DataFrame(out, columns=["node", "pos", "side", "near", "edge", "own"])

    return run


def _frames(min_run: int, size: int):
    """Rows with node, a and b (first words of a run's first and last piece, fewer than size - min_run words apart), the
    text before a (`left`), from a on (`own`) and after b's piece (`right`), and the characters where a begins and b's
    piece stops: number, first word and characters of every run of `size` words that holds either piece. One that holds
    a piece between them holds a or b too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [f"{left}{own[: stop - begin]}{right}" for left, own, right, begin, stop in zip(batch["left"], batch["own"], batch["right"], batch["begin"], batch["stop"])]
            for lo, hi in chunks(texts):
                number, owner, first, end, data = words(texts[lo:hi])
                begins, ends = _places(texts[lo:hi], owner, first, end, data)
                opens = np.searchsorted(owner, np.arange(hi - lo + 1))
                for x, o, e in zip(batch.iloc[lo:hi].itertuples(index=False), opens[:-1], opens[1:]):
                    lead = int(np.searchsorted(begins[o:e], len(x.left)))  # words before a
                    at = np.unique(np.concatenate([np.arange(max(0, p + min_run - size), min(p, e - o - size) + 1) for p in (lead, lead + x.b - x.a)]))
                    if len(at):
                        zero = x.begin - len(x.left)
                        yield pd.DataFrame({"frame": _spans(number[o:e], at, at + size).view(np.int64), "node": x.node, "at": at + x.a - lead, "start": begins[o + at] + zero, "end": ends[o + at + size - 1] + zero})

    return run


def _agree(side: int):
    """How many words of two texts agree, from their ends (side -1) or beginnings (1), and how many characters they take in each."""

    def agree(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        out = []
        for pair in zip(one, two):
            found = [list(_WORD.finditer(t))[::side] for t in pair]
            n = 0
            for x, y in zip(*found):
                if x.group().translate(_FOLD) != y.group().translate(_FOLD):
                    break
                n += 1
            out.append((n, *((f[n - 1].end() if side > 0 else len(t) - f[n - 1].start()) if n else 0 for f, t in zip(found, pair))))
        return pd.DataFrame(out, columns=["n", "one", "two"])

    return F.pandas_udf(agree, "n int, one int, two int")


def _merged(spans: DataFrame, begin: str, end: str) -> DataFrame:
    """spans with `run`, the number of those that overlap or touch among those with the same node, first and shift."""
    by = W.partitionBy("node", "first", "shift").orderBy(begin)
    reach = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("_fresh", F.coalesce(F.col(begin) > reach, F.lit(True)).cast("int"))
    return spans.withColumn("run", F.sum("_fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))


class Passages:
    """Repeats of runs of words between distinct texts."""

    def __init__(self, pieces: DataFrame, texts: DataFrame, copies: DataFrame, min_run: int, window: int, report_from: int, repeated: bool):
        """pieces: unit, node, at, link, next; texts: id, node, text; copies: node, least (its least id), m (documents)."""
        self.texts, self.copies, self.min_run, self.window, self.report_from = texts, copies, min_run, window, report_from
        self.repeated = repeated
        place = F.xxhash64("node", "at")
        ends = pieces.groupBy("unit").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x < y").select("unit")
        shared = pieces.join(ends, "unit", "left_semi")
        named = shared.join(copies.where("named"), "node").select("unit", "node", "least", "m", "at", "link", "next").distinct()
        self.members = stored(named, "shared-pieces")

    def _text_of(self, asked: DataFrame) -> DataFrame:
        """node, text, asked of the texts that `asked` (node, least, asked) names. What it asks for grows with the
        texts, so it is broadcast only where the engine finds its bytes few."""
        asked = asked.withColumnsRenamed({"node": "_an", "least": "_al"})
        found = self.texts.join(asked, (F.col("node") == F.col("_an")) & F.col("id").eqNullSafe(F.col("_al"))).select("node", "text", "asked")
        return found.dropDuplicates(["node"]) if self.repeated else found

    def stars(self) -> DataFrame:
        """Runs of pieces that agree with their class's first one without a gap: node, least, first (node), first_id,
        shift, a and b (first words of the first and last piece), places, class_docs."""
        place = F.struct(F.col("least").isNull(), "least", "at", "node", "link")
        by_text = self.members.groupBy("unit", "node").agg(F.min(place).alias("p"), F.first("m").alias("m"), F.count("*").alias("c"))
        classes = by_text.groupBy("unit").agg(F.min("p").alias("p"), F.sum("m").alias("class_docs"), F.sum("c").alias("places"))
        first = classes.select("unit", F.col("p.least").alias("first_id"), F.col("p.node").alias("first"), F.col("p.at").alias("first_at"), F.col("p.link").alias("first_link"), "class_docs", "places")
        met = self.members.join(first, "unit").where("node <> first or at <> first_at").withColumn("shift", F.col("at") - F.col("first_at"))
        by = W.partitionBy("node", "first", "shift").orderBy("at")
        goes_on = (F.lag("next").over(by) > 0) & (F.lag(F.col("at") + F.col("next")).over(by) == F.col("at")) & (F.lag(F.col("link") == F.col("first_link")).over(by))
        met = met.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
        runs = met.groupBy("node", "least", "first", "first_id", "shift", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.max("places").alias("places"), F.max("class_docs").alias("class_docs"))
        return stored(runs.drop("run"), "runs")

    def extended(self, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """runs with the words wa to wb and characters of what agrees: start, end, and first_start, first_end in the text
        that stays. Also the texts around the ends (AROUND), with the own words of runs that may stay short."""
        n = F.col("b") - F.col("a") + self.min_run
        own, none = F.when(n < self.report_from, n).otherwise(0), F.lit(0)
        mine, theirs = ("node", "least"), (F.col("first").alias("node"), F.col("first_id").alias("least"))
        ask = lambda who, pos, side, own: F.struct(*who, pos.alias("pos"), F.lit(side).alias("side"), own.alias("own"))
        ends = F.array(
            ask(mine, F.col("a"), -1, own), ask(mine, F.col("b"), 1, none),
            ask(theirs, F.col("a") - F.col("shift"), -1, none), ask(theirs, F.col("b") - F.col("shift"), 1, none),
        )
        asks = runs.select(F.explode(ends).alias("x")).select("x.*").groupBy("node", "least", "pos", "side").agg(F.max("own").alias("own"))
        asked = stored(asks.groupBy("node", "least").agg(F.collect_list(F.struct("pos", "side", "own")).alias("asked")), "asked")
        told = stored(self._text_of(asked).mapInPandas(_around(self.min_run, self.window), AROUND), "around")
        for pos, side in (("a", -1), ("b", 1)):
            own = told.where(F.col("side") == side)
            mine, theirs = own.select("node", F.col("pos").alias(pos), F.struct("near", "edge").alias("x")), own.select(F.col("node").alias("first"), F.col("pos").alias("_fp"), F.struct("near", "edge").alias("y"))
            runs = runs.join(mine, ["node", pos]).withColumn("_fp", F.col(pos) - F.col("shift")).join(theirs, ["first", "_fp"]).drop("_fp")
            runs = runs.withColumn("more", _agree(side)("x.near", "y.near"))
            runs = runs.withColumns({f"{pos}_own": F.col("x.edge") + side * F.col("more.one"), f"{pos}_first": F.col("y.edge") + side * F.col("more.two"), f"w{pos}": F.col("a") - F.col("more.n") if side < 0 else F.col("b") + self.min_run + F.col("more.n")}).drop("x", "y", "more")
        out = stored(runs, "extended")
        discard(asked)
        return out, told

    def found(self) -> DataFrame:
        """doc_id, start, end, words, class_id, class_docs, removed."""
        runs = self.stars()
        wide, around = self.extended(runs)
        discard(runs)
        whole = _merged(wide, "wa", "wb").groupBy("node", "least", "first", "first_id", "shift", "run")
        whole = whole.agg(F.min("wa").alias("wa"), F.max("wb").alias("wb"), F.min("a_own").alias("start"), F.max("b_own").alias("end"), F.min("a_first").alias("first_start"), F.max("b_first").alias("first_end"), F.max("class_docs").alias("class_docs"), F.max("places").alias("places"), F.collect_set(F.struct("a", "b")).alias("ends"))
        whole = stored(whole.withColumn("words", F.col("wb") - F.col("wa")), "repeats")
        rows = self._rows(whole.where(F.col("words") >= self.report_from))
        short = whole.where((F.col("words") < self.report_from) & (F.col("places") > 2))
        asked = short.select("node", F.explode("ends").alias("x")).select("node", "x.a", "x.b").distinct()
        left = around.where("side = -1").select("node", F.col("pos").alias("a"), F.col("near").alias("left"), "own", F.col("edge").alias("begin"))
        right = around.where("side = 1").select("node", F.col("pos").alias("b"), F.col("near").alias("right"), F.col("edge").alias("stop"))
        frames = asked.join(left, ["node", "a"]).join(right, ["node", "b"]).mapInPandas(_frames(self.min_run, self.report_from), FRAMES)
        frames = stored(frames.dropDuplicates(["node", "at"]).join(self.copies.where("named"), "node"), "frames")
        discard(wide, around)
        place = F.struct(F.col("least").isNull(), "least", "at", "node", "start", "end")
        by_text = frames.groupBy("frame", "node").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.first("m").alias("m"))
        classes = by_text.groupBy("frame").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.sum("m").alias("class_docs")).where("x < y")
        met = frames.join(classes.select("frame", "x", "class_docs"), "frame").where("node <> x.node or at <> x.at")
        met = met.select("node", "least", F.col("x.node").alias("first"), F.col("x.least").alias("first_id"), (F.col("at") - F.col("x.at")).alias("shift"), F.col("at").alias("wa"), (F.col("at") + self.report_from).alias("wb"), "start", "end", F.col("x.start").alias("first_start"), F.col("x.end").alias("first_end"), "class_docs")
        joined = _merged(met, "wa", "wb").groupBy("node", "least", "first", "first_id", "shift", "run")
        joined = joined.agg(F.min("wa").alias("wa"), F.max("wb").alias("wb"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_start").alias("first_start"), F.max("first_end").alias("first_end"), F.max("class_docs").alias("class_docs"))
        return rows.unionByName(self._rows(joined.withColumn("words", F.col("wb") - F.col("wa"))))

    @staticmethod
    def _rows(whole: DataFrame) -> DataFrame:
        went = whole.groupBy(F.col("least").alias("doc_id"), "node", "start", "end", "words").agg(F.min("first_id").alias("class_id"), F.max("class_docs").alias("class_docs")).withColumn("removed", F.lit(True))
        stays = whole.groupBy(F.col("first_id").alias("doc_id"), F.col("first").alias("node"), F.col("first_start").alias("start"), F.col("first_end").alias("end"), "words").agg(F.max("class_docs").alias("class_docs"))
        return went.unionByName(stays.withColumn("class_id", F.col("doc_id")).withColumn("removed", F.lit(False))).drop("node")


def find(docs: DataFrame, threshold: int = 80, k: int = 5, recall: float = 0.999, min_words: int = 20, min_run: int = 20, exact_from: int = 50, report_from: int = 20, broadcast_rows: int = 400_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Units that occur more than once: doc_id, kind, start, end (characters), words, class_id (least id of the
    class), class_docs, removed. Rows have report_from words at least; passages from max(exact_from, report_from) words
    are sure."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_number(F.col(text)).alias("node"), F.col(text).alias("text"))
    bands, rows = tune_bands(threshold / 100, recall)
    told = stored(texts.mapInArrow(_emit(max(min_words, report_from), min_run, exact_from - min_run + 1, k, bands, rows), UNITS), "units")
    names = stored(texts.select("id", "node").distinct(), "documents")
    n_docs = names.count()
    repeated = texts.count() > n_docs
    extent = told.where(F.col("kind") == WHOLE).select("node", "start", "end", "words").distinct()
    copies = names.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("m")).withColumn("named", F.lit(True))
    copies = stored(copies.join(extent, "node"), "texts")

    # paragraphs
    members = told.where(F.col("kind") == PARAGRAPH).select("unit", "id", "node", "start", "end", "words")
    keys = told.where((F.col("kind") == PARAGRAPH) & (F.size("keys") > 0)).select("unit", "keys").dropDuplicates(["unit"])
    collide = stored(keys.select(F.explode("keys").alias("gram"), F.col("unit").alias("id"), F.lit(1).alias("n")), "bands")
    shared = collide.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("gram", "low", F.lit(1).alias("low_n"))
    active = stored(collide.join(shared, "gram"), "shared-bands")
    discard(collide)

    def texts_of(ids: DataFrame) -> DataFrame:
        """One place of each unit, and its text."""
        spot = members.join(ids.withColumnRenamed("id", "unit"), "unit", "left_semi").groupBy("unit").agg(F.min(F.struct("node", "id", "start", "end")).alias("p"))
        spot = stored(spot.select("unit", F.col("p.node").alias("_sn"), F.col("p.id").alias("_si"), "p.start", "p.end"), "spots")
        found = texts.join(F.broadcast(spot) if spot.count() <= broadcast_rows else spot, (F.col("node") == F.col("_sn")) & F.col("id").eqNullSafe(F.col("_si")))
        found = found.select(F.col("unit").alias("id"), F.expr("substring(text, start + 1, end - start)").alias("text"))
        return found.dropDuplicates(["id"]) if repeated else found

    label = components(StarJoin(docs.sparkSession, texts_of, k, threshold, broadcast_rows=broadcast_rows).links(active))
    discard(active)
    # classes: of linked paragraphs, else of equal ones
    place = F.struct(F.col("id").isNull(), "id", "node", "start")
    equal = members.groupBy("unit").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count("*").alias("m"))
    named = equal.join(label, equal["unit"] == label["v"], "left").where("x < y or v is not null")
    named = stored(named.select("unit", F.coalesce("comp", "unit").alias("class"), "m"), "paragraph-classes")
    hits = spread_join(members, named, "unit", ["class"], hot_keys(named, "m", n_docs), F.xxhash64("id", "node", "start")).where("class is not null")
    hits = stored(hits.dropDuplicates(["id", "node", "start"]), "hits")
    by_doc = hits.groupBy("class", "id", "node").agg(F.min(place).alias("x"), F.max(place).alias("y"))
    classes = by_doc.groupBy("class").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.count("*").alias("class_docs")).where("x < y")
    classes = stored(classes.select("class", "x", "class_docs"), "classes")
    lines = spread_join(hits, classes, "class", ["x", "class_docs"], hot_keys(classes, "class_docs", n_docs), F.xxhash64("id", "node", "start")).where("x is not null")
    lines = lines.select(F.col("id").alias("doc_id"), F.lit("paragraph").alias("kind"), "start", "end", "words", F.col("x.id").alias("class_id"), "class_docs", (place != F.col("x")).alias("removed"))

    # copies of whole texts
    many = copies.where((F.col("m") > 1) & (F.col("words") >= report_from)).drop("named")
    whole = spread_join(names, many, "node", ["least", "m", "start", "end", "words"], hot_keys(many, "m", n_docs), F.xxhash64("id")).where("m is not null")
    whole = whole.select(F.col("id").alias("doc_id"), "start", "end", "words", F.col("least").alias("class_id"), F.col("m").alias("class_docs"), (~F.col("id").eqNullSafe(F.col("least"))).alias("removed"))

    # runs
    pieces = told.where(F.col("kind") == PIECE).select("unit", "node", "at", "link", "next")
    runs = Passages(pieces, texts, copies.select("node", "least", "m", "named"), min_run, exact_from - min_run + 1, report_from, repeated)
    discard(told)
    passages = stored(runs.found(), "passages")
    discard(runs.members)
    parts = whole.unionByName(passages).withColumn("kind", F.lit("piece"))
    return lines.unionByName(parts.select(lines.columns))
