"""Documents through toxicity filter, near-duplicate removal, decontamination, source mixture and sharding.

Defined cases of every stage: an empty table gives an empty one; null and empty texts pass the filters, take no words
of the mixture (and so leave there); extra columns stay with their documents until the mixture and come out of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import balanced_lp, decontam, mixture, toxicity_rnn, trie_join
from tidemark.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it is trained on the labelled ones outside the held-out fold."""
    trains = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    judged = toxicity_rnn.classify(docs, table(spark, sf_dir, "labels"), trains)
    return judged.where("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_rows: int = 400_000) -> DataFrame:
    """Of each component of texts with 80 % of their 5-word n-grams in common, the document with the least id stays (of
    two texts with that id the one with the lesser hash). Rows repeated with one id and text are one document."""
    join = trie_join.TrieJoin(docs)
    gone = stored(join.documents().where("not kept").select(F.col("id").alias("_gi"), F.col("node").alias("_gn")).distinct(), "duplicates")
    few = gone.count() <= broadcast_rows
    marked = docs.withColumn("_node", trie_join.text_number(F.col("text")))
    same = (marked["_node"] == gone["_gn"]) & marked["doc_id"].cast("long").eqNullSafe(gone["_gi"])
    left = marked.join(F.broadcast(gone) if few else gone, same, "left_anti")
    if join.repeated():
        left = left.dropDuplicates(["doc_id", "_node"])
    return left.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontam.judged(decontam.find(docs, table(spark, sf_dir, "benchmark")))
    return found.where(~found["contaminated"]).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; the one that a source's last block cuts gives the words taken."""
    return mixture.emit(mixture.mix(docs)).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents, and for each row its size, checksum, law, shard and place in the shard."""
    return balanced_lp.assign(docs, keep=[c for c in docs.columns if c != "doc_id"])


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixture", mix_sources),
    ("sharding", shard),
]

#: The classifier and the propagation are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what each returns is written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
