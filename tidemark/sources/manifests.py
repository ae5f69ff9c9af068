"""Published tables: a folder named by the content it holds, with a manifest of hashes, schema and counts.

publish() writes the table into a staging folder, hashes its files in Spark, and renames the folder to its content id;
a folder that is already there must hold the same. reload() accepts a table only if its manifest is canonical JSON, the
folder's name is its id, and files, hashes, schema and row count are those it names. Nothing is repaired.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class ManifestError(ValueError):
    """What is published is not what its manifest says, or is ambiguous."""


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, no escapes but those JSON needs; numbers that JSON lacks are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def content_id(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def file_identities(spark: SparkSession, path: str) -> list[dict]:
    """Name, bytes and SHA-256 of every Parquet file, hashed by the executors."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    rows = found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).collect()  # a row a file
    return [x.asDict() for x in sorted(rows, key=lambda x: x["name"])]


def adopt(spark: SparkSession, staging: str, target: str) -> bool:
    """Renames staging to target; False, with the staging folder gone, if another writer was first."""
    fs, src = _fs(spark, staging)
    _, dst = _fs(spark, target)
    if not fs.exists(dst) and fs.rename(src, dst):
        return True
    fs.delete(src, True)
    if not fs.exists(dst):
        raise ManifestError(f"could not publish {target}")
    return False


def publish(df: DataFrame, root: str, identity: dict, key: list[str] = (), extra: dict | None = None) -> str:
    """Writes df under root and returns the folder. key: columns that must be unique."""
    spark = df.sparkSession
    staging = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{staging}/data")
    written = spark.read.schema(df.schema).parquet(f"{staging}/data")
    n = written.count()
    if key and written.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ManifestError(f"{key} are not unique")
    manifest = {"identity": identity, "rows": n, "schema": json.loads(df.schema.json()), "key": list(key), "files": file_identities(spark, f"{staging}/data"), **(extra or {})}
    name = content_id({k: v for k, v in manifest.items() if k != "files"} | {"content": sorted(f["sha256"] for f in manifest["files"])})
    _write(spark, f"{staging}/manifest.json", canonical_json(manifest | {"content_id": name}))
    target = f"{root.rstrip('/')}/{name.removeprefix('sha256:')}"
    adopt(spark, staging, target)
    return target


def manifest_of(spark: SparkSession, path: str) -> dict:
    text = read_text(spark, f"{path}/manifest.json")
    found = json.loads(text)
    if canonical_json(found) != text:
        raise ManifestError("the manifest is not canonical JSON")
    told = {k: v for k, v in found.items() if k not in ("files", "content_id")} | {"content": sorted(f["sha256"] for f in found["files"])}
    if content_id(told) != found["content_id"] or found["content_id"].removeprefix("sha256:") != path.rstrip("/").rsplit("/", 1)[-1]:
        raise ManifestError("the folder's name is not the manifest's identity")
    return found


def reload(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The published table, checked: hashes of all files, schema, rows, uniqueness of its key."""
    manifest = manifest_of(spark, path)
    if file_identities(spark, f"{path}/data") != manifest["files"]:
        raise ManifestError("files are not those of the manifest")
    declared = T.StructType.fromJson(manifest["schema"])
    if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in declared]:
        raise ManifestError("the schema is not the one asked for")
    df = spark.read.schema(declared).parquet(f"{path}/data")
    if df.count() != manifest["rows"]:
        raise ManifestError("rows are not those of the manifest")
    key = manifest["key"]
    if key and df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ManifestError(f"{key} are not unique")
    return df


def discover(spark: SparkSession, root: str, months: list[str], identity: dict) -> tuple[dict[str, str], list[str]]:
    """Folder of each month whose manifest has the identity, and the months that are missing; a month with two
    different revisions is refused. One row a manifest reaches the driver; months are at most 240."""
    if len(months) > 240:
        raise ManifestError("more than 240 months")
    texts = spark.read.text(f"{root}/*/manifest.json", wholetext=True).select("value", F.input_file_name().alias("at")).collect()
    found: dict[str, set[str]] = {}
    for x in texts:
        m = json.loads(x["value"])
        own = m["identity"]
        if all(own.get(k) == v for k, v in identity.items()) and own.get("month") in months:
            found.setdefault(own["month"], set()).add(x["at"].removesuffix("/manifest.json"))
    if twice := sorted(m for m, at in found.items() if len(at) > 1):
        raise ManifestError(f"several revisions of {', '.join(twice)}")
    return {m: next(iter(at)) for m, at in found.items()}, [m for m in months if m not in found]


def load_dataset(spark: SparkSession, features: str, targets: str, key: list[str]) -> DataFrame:
    """Features and targets of two published caches, joined one to one; keys of one side only are refused in the plan."""
    from tidemark.operators.joins import one_to_one

    return one_to_one(reload(spark, features), reload(spark, targets), key)


def audit_corpus(spark: SparkSession, root: str) -> DataFrame:
    """One row a published partition: folder, rows, bytes and files by its manifest."""
    schema = "rows long, identity map<string, string>, files array<struct<name: string, bytes: long, sha256: string>>"
    found = spark.read.text(f"{root}/*/manifest.json", wholetext=True).select(F.input_file_name().alias("at"), F.from_json("value", schema).alias("m"))
    size = F.aggregate("m.files", F.lit(0).cast("long"), lambda a, f: a + f["bytes"])
    return found.select(F.regexp_extract("at", r"([^/]+)/manifest.json$", 1).alias("partition"), "m.identity", F.col("m.rows").alias("rows"), size.alias("bytes"), F.size("m.files").alias("files"))
