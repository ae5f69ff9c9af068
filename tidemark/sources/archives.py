"""Daily and monthly archives: a ZIP with one CSV member of twelve columns, decoded to bars.

Rows are decoded with their types checked by pattern; whatever does not fit is refused with the archive's name, nothing
is repaired. Archives are read as binaryFile rows, so each is decoded in one task of bounded memory (max_bytes).

Defined cases: a null or broken archive, a second member, another member's name, a row of other than 12 fields or with
a field that is no number raises in the task; an empty member gives no rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed by the archive's format: fields in order, and whether they are counts or decimals.
FIELDS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "turnover", "trades", "taker_volume", "taker", "ignored"]
COUNTS = {"open_time", "close_time", "trades"}
_COUNT, _DECIMAL = re.compile(r"[0-9]+"), re.compile(r"[0-9]+(\.[0-9]+)?")
BARS = "archive string, symbol string, open_us long, close_us long, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18), turnover decimal(38,18), taker decimal(38,18), trades long"
#: From this UTC day archives count microseconds, before it milliseconds.
MICROSECONDS_FROM = "2025-01-01"


def timestamp_unit(day: Column) -> Column:
    return F.when(day >= F.lit(MICROSECONDS_FROM).cast("date"), "us").otherwise("ms")


def to_micros(value: Column, unit: Column) -> Column:
    return F.when(unit == "ms", value * 1000).otherwise(value)


def member(content: bytes, expected: str, max_bytes: int) -> bytes:
    """The one member that an archive may have."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if len(infos) != 1 or infos[0].filename != expected or infos[0].file_size > max_bytes:
            raise ValueError(f"an archive holds {[i.filename for i in infos]}, not {expected} of at most {max_bytes} bytes")
        return z.read(infos[0])


def fields(line: str, name: str) -> list[str]:
    out = line.split(",")
    if len(out) != len(FIELDS):
        raise ValueError(f"{name}: {len(out)} fields")
    for field, value in zip(FIELDS, out):
        if not (_COUNT if field in COUNTS else _DECIMAL).fullmatch(value):
            raise ValueError(f"{name}: {field} is {value!r}")
    return out


def decode(archives: DataFrame, max_bytes: int = 1 << 30) -> DataFrame:
    """archives: path, content, of names SYMBOL-1m-PERIOD.zip. Bars in the order of each archive, times in microseconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                text = member(content, name.removesuffix(".zip") + ".csv", max_bytes).decode("utf-8")
                rows = [fields(line, name) for line in text.splitlines()]
                yield pd.DataFrame({"archive": name, **{f: [r[i] for r in rows] for i, f in enumerate(FIELDS)}}, columns=["archive", *FIELDS])

    raw = archives.select("path", "content").mapInPandas(run, "archive string, " + ", ".join(f"{f} string" for f in FIELDS))
    day = F.to_date(F.regexp_extract("archive", r"([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)\.zip$", 1))
    unit = timestamp_unit(day)
    price = lambda c: F.col(c).cast("decimal(38,18)").alias(c)
    return raw.select(
        "archive", F.regexp_extract("archive", r"^([^-]+)-", 1).alias("symbol"), to_micros(F.col("open_time").cast("long"), unit).alias("open_us"), to_micros(F.col("close_time").cast("long"), unit).alias("close_us"),
        *[price(c) for c in ("open", "high", "low", "close", "turnover", "taker")], F.col("trades").cast("long").alias("trades"),
    )


def encode(bars: DataFrame) -> DataFrame:
    """path, content: archives of the bars of each `archive` name (symbol, times in its unit), for tests and exports.
    bars: archive and the twelve fields."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        name = group["archive"].iloc[0]
        text = "\n".join(",".join(map(str, r)) for r in group.sort_values("open_time")[FIELDS].itertuples(index=False))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name.removesuffix(".zip") + ".csv", text)
        return pd.DataFrame({"path": [name], "content": [out.getvalue()]})

    return bars.groupBy("archive").applyInPandas(pack, "path string, content binary")


def by_day(bars: DataFrame) -> DataFrame:
    """The bars of a monthly archive with their UTC day, and how many each day has."""
    day = F.to_date(F.timestamp_micros("open_us"))
    return bars.withColumn("day", day).groupBy("symbol", "day").agg(F.count("*").alias("n"), F.min("open_us").alias("first_us"), F.max("open_us").alias("last_us"))
