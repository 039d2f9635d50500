"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Nulls: a null text has no words; it passes the stages as an empty one and is packed as an end
token.  Rows with a null id are judged by their text; of each near-duplicate class one row
stays, one with an id if it has any.  A null source is a source.  Repeated rows are copies of each
other; ties go by id, then by a hash of the text.  Other columns are carried through to the mix.
Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import mixing, neardup, packing, secret_ledger, toxicity
from strandwork.llm.common import drop_stored, new_path, stored_so_far, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (5-word Jaccard similarity of 0.8 or more) stays.

    Fingerprints of 64 bits can't tell this similarity (README), so the classes come from an exact join of shingle sets.
    """
    return neardup.dedup(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows."""
    clean = secret_ledger.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the mix takes them."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, with sequence and offset."""
    return packing.packed(docs)


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: No stage but mixing can be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; what a stage stored goes once the next one is written."""
    docs, since = table(spark, sf_dir, "documents"), stored_so_far()
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_stored(spark, since, keep=[path])
    return docs
