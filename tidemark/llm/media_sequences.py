"""Interleaved sequences of text and media: parsed from HTML, payloads resolved by digest.

parse_sequences() turns HTML into an array of structs in page order: position, kind (text or media), text, digest,
caption. A media reference is an <img src="sha256:..."> and its caption the first <figcaption> of its <figure>.
store() keeps payloads as media rows (digest, media) in a Parquet table of the shared folder; a media row is a binary
PPM image of 64 RGB pixels a line, which holds 192 payload bytes a line losslessly. A task stores a payload that it
meets again once. resolve() joins references to what was computed from the stored bytes; it shuffles digests and small
features, never payloads. Each distinct digest has one row on the media side, and references that very many documents
share are looked up in a broadcast table of at most 10,000 digests.

Defined cases: null text or html gives an empty sequence and, as a payload, 192 spaces; an unknown digest resolves to
nulls and keeps its place; a figure without caption has a null caption, an <img> without a digest a null one; images in
comments, scripts and styles are none; nesting of any depth is walked without recursion; repeated rows are resolved
alike; an empty table gives an empty result. Extra columns stay with the sequences, those named as a result are
replaced.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import hot_keys, spread_join, stored
from tidemark.llm.template_html import INLINE, Node, attribute, parse

LINE = 192
ITEM = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())])
_DIGEST = re.compile(r"\s*sha256:([0-9a-f]{64})\s*", re.I)
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: Column) -> Column:
    """UTF-8 bytes and spaces up to a positive multiple of LINE."""
    raw = F.coalesce(text, F.lit(""))
    n = F.octet_length(raw)
    whole = F.greatest(F.lit(LINE), (F.ceil(n / LINE) * LINE).cast("int"))
    return F.concat(raw, F.repeat(F.lit(" "), whole - n)).cast("binary")


def to_media(payload: Column) -> Column:
    """A PPM image whose samples are the payload."""
    lines = (F.octet_length(payload) / LINE).cast("int").cast("string")
    return F.concat(F.concat(F.lit("P6\n64 "), lines, F.lit("\n255\n")).cast("binary"), payload)


def from_media(media: bytes) -> bytes:
    kind, width, height, depth = media[:40].split(None, 4)[:4]
    head = len(kind) + len(width) + len(height) + len(depth) + 4
    if (kind, width, depth) != (b"P6", b"64", b"255") or len(media) != head + LINE * int(height):
        raise ValueError("not a payload image")
    return media[head:]


def feature(payload: bytes) -> str:
    """Counts of samples in 8 ranges of 32 and the sum of samples."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples >> 5, minlength=8)
    return ",".join(map(str, counts.tolist())) + f";{int(samples.sum(dtype=np.int64))}"


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for digest, media in zip(batch["digest"], batch["media"]):
            payload = from_media(media)
            own = hashlib.sha256(payload).hexdigest()
            rows.append((digest, len(payload), own, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in FEATURES.split(", ")])


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest the task has not met yet; of the last million digests."""
    seen: set[str] = set()
    for batch in batches:
        if len(seen) > 1 << 20:
            seen.clear()
        mask = []
        for digest in batch.column(0).to_pylist():
            mask.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(mask))


def store(payloads: DataFrame) -> DataFrame:
    """payloads: digest, payload. The stored table: digest, media."""
    media = payloads.select("digest", to_media(F.col("payload")).alias("media"))
    return stored(media.mapInArrow(_first_of_task, media.schema), "media")


def features(media: DataFrame) -> DataFrame:
    """One row a digest, computed from the stored bytes."""
    return stored(media.mapInPandas(_read_back, FEATURES).dropDuplicates(["digest"]), "media-features")


def sequence(html: str | None) -> list[tuple]:
    """Structs in page order."""
    items: list[list] = []
    buffer: list[str] = []
    captions: list[list] = []  # of the figures that are open: first item, caption

    def flush() -> None:
        if text := " ".join("".join(buffer).split()):
            items.append(["text", text, None, None])
        buffer.clear()

    def close(node: Node, mark: int) -> None:
        if node.tag == "figcaption" and captions:
            flush()
            told = " ".join(i[1] for i in items[mark:] if i[0] == "text")
            items[mark:] = [i for i in items[mark:] if i[0] == "media"]
            captions[-1][1] = captions[-1][1] if captions[-1][1] is not None else told
        elif node.tag == "figure":
            flush()
            first, told = captions.pop()
            for i in items[first:]:
                if i[0] == "media" and i[3] is None:
                    i[3] = told
        elif node.tag not in INLINE:
            flush()

    root = parse(html or "")
    stack = [(root, iter(root.children), 0)]
    while stack:
        node, rest, mark = stack[-1]
        c = next(rest, None)
        if c is None:
            stack.pop()
            close(node, mark)
        elif not isinstance(c, Node):
            buffer.append(c)
        elif c.tag == "img":
            flush()
            found = _DIGEST.fullmatch(attribute(c.attrs, "src") or "")
            items.append(["media", None, found[1].lower() if found else None, None])
        elif c.tag not in ("script", "style", "head", "title", "template", "noscript"):
            if c.tag not in INLINE:
                flush()
            elif c.tag == "br":
                buffer.append(" ")
            if c.tag == "figure":
                captions.append([len(items), None])
            stack.append((c, iter(c.children), len(items)))
    return [(i, *x) for i, x in enumerate(items)]


def parse_sequences(docs: DataFrame, html: str = "html") -> DataFrame:
    """docs with items, without html."""
    kept = [f for f in docs.schema.fields if f.name not in (html, "items")]
    schema = T.StructType([*kept, T.StructField("items", T.ArrayType(ITEM))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["items"] = [sequence(h) for h in batch[html]]
            yield batch[schema.names]

    return docs.mapInPandas(run, schema)


def references(digests: DataFrame, n_rows: int) -> DataFrame:
    """digest: those that very many of the rows have. digests: digest."""
    return hot_keys(digests.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n")), "n", n_rows)


def resolve(sequences: DataFrame, found: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """A row for each item with n_items and what `found` has of its digest; position and caption stay with it. hot: see
    references(); without it the sequences are kept as a table to count theirs."""
    values = [c for c in found.columns if c != "digest"]
    given = [c for c in sequences.columns if c != "items" and c not in [*ITEM.names, *values, "n_items"]]
    flat = sequences.select(*given, F.size("items").alias("n_items"), F.explode("items").alias("_item")).select(*given, "n_items", "_item.*")
    if hot is None:
        flat = stored(flat, "items")
        hot = references(flat.select("digest"), flat.count())
    return spread_join(flat, found, "digest", values, hot, F.concat(F.lit("-"), F.xxhash64(*given, "pos").cast("string")))
