"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

Words are maximal runs outside ASCII punctuation and white space, A-Z lower-cased. Normalising maps bytes to bytes of
the same number, so offsets in the normalised text lead back to the original. A window is `width` consecutive words of an
item (all of them if it has fewer). The symbols of the automaton are numbers of the items' words, not characters: a
window costs at most `width` nodes of about 60 bytes, and a text's words outside the items' vocabulary are symbol 0.
Item windows are held in blocks of about block_words item words (50,000 by default: 0.5 million nodes, some 40 MB in a
Python worker); each block is an automaton, built once in a worker, and a pass; the text is carried along, nothing is
shuffled.

Defined cases: null and wordless texts have no words and no hits; items without words have no window; items that
share a window are all reported; repeated rows are judged alike; an empty item table hits nothing. Extra columns
stay; results come in n_words and hits, which replace columns of these names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

#: Fixed by the contract: the bytes between words.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), 0x7B, 0x7C, 0x7D, 0x7E, 0x7F])
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in SEPARATORS else b for b in range(256))

HIT = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("item_id", T.StringType())])


def normalised(text: str) -> bytes:
    """Bytes of the same length with words lower-cased and every separator a space."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def windows(words: list[bytes], width: int) -> list[bytes]:
    n = len(words)
    return [b" ".join(words[i : i + width]) for i in range(max(1, n - width + 1))] if n else []


class Automaton:
    """Windows of items as sequences of word numbers; a match carries its number of words and the items that have it."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        import ahocorasick

        found: dict[bytes, set[str]] = {}
        for item_id, text in items:
            for w in windows(normalised(text or "").split(), width):
                found.setdefault(w, set()).add(item_id)
        self.numbers: dict[bytes, int] = {}
        self.held = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in found.items():
            key = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w.split(b" "))
            self.held.add_word(key, (len(key), tuple(sorted(ids))))
        if found:
            self.held.make_automaton()

    def matches(self, words: list[bytes]) -> list[tuple]:
        """(last word, (number of words, items)) of every occurrence."""
        return list(self.held.iter(tuple(map(self.numbers.get, words, repeat(0))))) if len(self.held) else []


def scan(auto: Automaton, text: str | None) -> tuple[int, list[tuple]]:
    """Number of words, and hits as first word, last word, start and end in characters of the text, item."""
    if not text:
        return 0, []
    flat = normalised(text)
    words = flat.split()
    ends = auto.matches(words)
    if not ends:
        return len(words), []
    raw = np.frombuffer(flat, np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80) - 1  # character that each byte belongs to
    bounds = [m.span() for m in re.finditer(rb"[^ ]+", flat)]
    hits = set()
    for last, (n, ids) in ends:
        first = last - n + 1
        start, end = int(chars[bounds[first][0]]), int(chars[bounds[last][1] - 1]) + 1
        hits.update((first, last, start, end, i) for i in ids)
    return len(words), sorted(hits)


#: The automaton that this worker built last, by broadcast.
_built: dict[str, Automaton] = {}


def _pass(items: Broadcast, width: int, text: str, columns: list[str]):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(items.value, width)
        auto = _built[key]
        for batch in batches:
            got = [scan(auto, t) for t in batch[text]]
            before = batch["hits"] if "hits" in batch else [()] * len(batch)
            batch["n_words"] = np.fromiter((n for n, _ in got), np.int64, len(got))
            batch["hits"] = [[*map(tuple, (x.values() if isinstance(x, dict) else x for x in b)), *h] for b, (_, h) in zip(before, got)]
            yield batch[columns]

    return run


def find(docs: DataFrame, items: DataFrame, width: int = 10, block_words: int = 50_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words and hits."""
    docs = docs.drop("n_words", "hits")
    sc = docs.sparkSession.sparkContext
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    n_blocks = total // block_words + 1
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(HIT))])
    for b in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        held = sorted({(x["i"], x["t"]) for x in block.collect()}, key=str)  # about block_words words
        docs = docs.mapInPandas(_pass(sc.broadcast(held), width, text, schema.names), schema)
    return docs


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit (words inside any hit), n_items, item_ids (sorted as strings) and contaminated."""
    merged = F.aggregate(
        F.array_sort(F.transform("hits", lambda h: F.struct(h["first"].alias("a"), h["last"].alias("b")))),
        F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
        lambda acc, h: F.struct(F.greatest(acc["end"], h["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), h["b"] - F.greatest(acc["end"], h["a"] - 1))).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.withColumn("n_hit", merged).withColumn("item_ids", ids).withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
